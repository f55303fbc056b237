"""Indicator, asset, privacy, coverage and timeline queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import cluster as K, coverage as C, graph as G, intel as I, timeline as T
from tidewatch.plans import derived as D
from tidewatch.plans.clustering import HOURLY, hourly
from tidewatch.plans.graphs import GRAPH
from tidewatch.plans.model import AS_OF, events, query, table, with_ne
from tidewatch.schema import ATTACK_TACTICS, PRIORITY_TECHNIQUES
from tidewatch.sources.sinks import append_events, scratch_folder

# ---- indicators --------------------------------------------------------------------------------------

BEST = """best AS (SELECT ip, confidence, actor_tag, ioc_value FROM (
  SELECT ioc_value AS ip, 1 AS r, confidence, actor_tag, ioc_value FROM iocs WHERE ioc_type = 'ip' AND confidence > 0
  UNION ALL SELECT bare_ip, 0, confidence, actor_tag, ioc_value FROM iocs WHERE bare_ip IS NOT NULL AND confidence > 0)
  QUALIFY row_number() OVER (PARTITION BY ip ORDER BY r DESC, confidence DESC, actor_tag DESC, ioc_value DESC) = 1)"""
MATCHED = """matched AS (SELECT n.event_id, n.timestamp, n.hostname, coalesce(s.ip, d.ip) IS NOT NULL AS ioc_matched,
  CASE WHEN s.ip IS NOT NULL THEN s.confidence ELSE d.confidence END AS ioc_confidence, CASE WHEN s.ip IS NOT NULL THEN s.actor_tag ELSE d.actor_tag END AS ioc_actor_tag,
  CASE WHEN s.ip IS NOT NULL THEN s.ioc_value ELSE d.ioc_value END AS ioc_value, coalesce(s.ip, d.ip) AS matched_ip
  FROM ne n LEFT JOIN best s ON s.ip = n.src_ip LEFT JOIN best d ON d.ip = n.dst_ip)"""
STORE = """store AS (SELECT ioc_value, ioc_type, bare_ip, confidence, feed_source, TIMESTAMP '2024-01-01' AS first_seen, TIMESTAMP '2024-01-02' AS last_seen,
  CASE WHEN confidence = 0 THEN 'expired' ELSE 'active' END AS ioc_status FROM iocs),
incoming AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN concat('198.51.', CAST(c_custkey % 250 AS VARCHAR), '.', CAST(c_custkey // 250 AS VARCHAR))
    ELSE concat('198.52.', CAST(c_custkey % 250 AS VARCHAR), '.', CAST(c_custkey // 250 AS VARCHAR)) END AS ioc_value, 'ip' AS ioc_type, CAST(NULL AS VARCHAR) AS bare_ip,
  CAST(50 + c_custkey % 50 AS INT) AS confidence, 'refresh' AS feed_source, TIMESTAMP '2024-02-01' AS first_seen, TIMESTAMP '2024-02-02' AS last_seen, 'active' AS ioc_status FROM customer)"""


def store(spark, sf):
    return D.iocs(spark, sf).drop("actor_tag").withColumns({
        "first_seen": F.lit("2024-01-01").cast("timestamp"), "last_seen": F.lit("2024-01-02").cast("timestamp"),
        "ioc_status": F.when(F.col("confidence") == 0, "expired").otherwise("active")})


def incoming(spark, sf):
    tail = "cast(c_custkey % 250 as string), '.', cast(c_custkey div 250 as string))"
    return table(spark, sf, "customer").selectExpr(
        f"case when c_custkey % 2 = 0 then concat('198.51.', {tail} else concat('198.52.', {tail} end AS ioc_value", "'ip' AS ioc_type",
        "cast(null as string) AS bare_ip", "cast(50 + c_custkey % 50 as int) AS confidence", "'refresh' AS feed_source",
        "timestamp'2024-02-01' AS first_seen", "timestamp'2024-02-02' AS last_seen", "'active' AS ioc_status")


@query("ti1_upsert_iocs", f"""WITH {D.IOCS}, {STORE}
SELECT coalesce(o.ioc_value, n.ioc_value) AS ioc_value, coalesce(o.ioc_type, n.ioc_type) AS ioc_type, coalesce(n.confidence, o.confidence) AS confidence,
  coalesce(o.feed_source, n.feed_source) AS feed_source, coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_seen, o.last_seen) AS last_seen,
  CASE WHEN n.ioc_value IS NOT NULL THEN 'active' ELSE o.ioc_status END AS ioc_status
FROM store o FULL JOIN incoming n ON o.ioc_value = n.ioc_value AND o.ioc_type = n.ioc_type""")
def ti1(spark, sf):
    return I.upsert_iocs(store(spark, sf), incoming(spark, sf)).drop("bare_ip")


@query("ti1_new_iocs", f"WITH {D.IOCS}, {STORE} SELECT ioc_value, confidence FROM incoming WHERE ioc_value NOT IN (SELECT ioc_value FROM store WHERE ioc_type = 'ip')")
def ti1b(spark, sf):
    return I.new_iocs(store(spark, sf), incoming(spark, sf)).select("ioc_value", "confidence")


@query("ti2_event_match", with_ne("SELECT event_id, ioc_matched, ioc_confidence, ioc_actor_tag FROM matched", D.IOCS, BEST, MATCHED))
def ti2(spark, sf):
    return I.match_iocs(events(spark, sf), D.iocs(spark, sf)).select("event_id", "ioc_matched", "ioc_confidence", "ioc_actor_tag")


HITS = "SELECT event_id, timestamp AS event_timestamp, hostname, ioc_value, matched_ip, ioc_confidence AS risk_score FROM matched WHERE ioc_matched"


def hits(spark, sf):
    return I.ioc_hits(I.match_iocs(events(spark, sf), D.iocs(spark, sf)))


@query("ti3_ingest_hits", with_ne(HITS, D.IOCS, BEST, MATCHED))
def ti3(spark, sf):
    return hits(spark, sf).select("event_id", "event_timestamp", "hostname", "ioc_value", "matched_ip", "risk_score")


@query("ti4_retroactive_hits", with_ne(f"""
SELECT event_id, ioc_value, i.confidence AS risk_score FROM ne JOIN iocs i ON coalesce(i.bare_ip, i.ioc_value) IN (ne.src_ip, ne.dst_ip)
WHERE timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY""", D.IOCS))
def ti4(spark, sf):
    return I.retroactive_hits(events(spark, sf), D.iocs(spark, sf), AS_OF, "20 DAYS").select("event_id", "ioc_value", "risk_score")


@query("ti4_marked_events", with_ne(f"""
SELECT event_id, coalesce(max(i.confidence) IS NOT NULL, false) AS ioc_matched, CAST(max(i.confidence) AS BIGINT) AS ioc_confidence FROM ne
LEFT JOIN iocs i ON coalesce(i.bare_ip, i.ioc_value) IN (ne.src_ip, ne.dst_ip) AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY GROUP BY 1""", D.IOCS))
def ti4b(spark, sf):
    """Stored events after the write-back of new indicators."""
    folder = scratch_folder(spark) + "/events"
    append_events(events(spark, sf).withColumns({"ioc_matched": F.lit(None).cast("boolean"), "ioc_confidence": F.lit(None).cast(events(spark, sf).schema["ioc_confidence"].dataType)}), folder)
    I.mark_stored(spark, folder, D.iocs(spark, sf), AS_OF, "20 DAYS")
    return spark.read.parquet(folder).select("event_id", F.coalesce("ioc_matched", F.lit(False)).alias("ioc_matched"), F.col("ioc_confidence").cast("bigint").alias("ioc_confidence"))


@query("ti5_feed_status", f"""WITH {D.IOCS}
SELECT feed, (SELECT count(*) FROM iocs WHERE feed_source = feed) AS ioc_count, status FROM (VALUES ('feodo', 'stale'), ('cisa_kev', 'never'), ('threatfox', 'ok'), ('misp', 'ok')) t(feed, status)""")
def ti5(spark, sf):
    syncs = spark.createDataFrame([("feodo", "2024-01-29 20:00:00"), ("threatfox", "2024-01-29 23:30:00"), ("misp", "2024-01-29 17:00:00")], "feed string, s string") \
        .select("feed", F.col("s").cast("timestamp").alias("last_sync"))
    return I.feed_status(D.iocs(spark, sf), syncs, AS_OF).drop("last_sync")


@query("ti6_list_hits", with_ne(f"SELECT event_id, risk_score FROM ({HITS}) ORDER BY risk_score DESC, event_timestamp DESC, event_id LIMIT 100", D.IOCS, BEST, MATCHED))
def ti6(spark, sf):
    return I.list_hits(hits(spark, sf)).select("event_id", "risk_score")


@query("ti6_list_feed_iocs", f"WITH {D.IOCS} SELECT ioc_value, confidence FROM iocs WHERE feed_source = 'misp' ORDER BY confidence DESC, ioc_value, ioc_type LIMIT 50")
def ti6b(spark, sf):
    return I.list_feed_iocs(D.iocs(spark, sf)).select("ioc_value", "confidence")


@query("ti7_cross_reference", with_ne("""
SELECT event_type, count(*) AS findings, CAST(sum(CASE WHEN dst_ip IN (SELECT ioc_value FROM store WHERE ioc_status = 'active') THEN 1 ELSE 0 END) AS BIGINT) AS hits
FROM ne GROUP BY 1""", D.IOCS, STORE))
def ti7(spark, sf):
    findings = events(spark, sf).select("event_type", F.col("dst_ip").alias("data"))
    return I.finding_counts(I.cross_reference(findings, store(spark, sf)))


CACHE = [("203.0.113.0", True, False, '{"geo": {"latitude": 52.5, "longitude": 13.4, "country_name": "Germany", "country_iso_code": "DE", "city": "Berlin", "org": "AS-A"}}'),
         ("203.0.113.1", False, True, '{"lat": 48.8, "lon": 2.3, "country": "France", "countryCode": "FR", "as": "AS-B"}'),
         ("203.0.113.2", False, False, '{"hosting": true, "geo": {"country": "Spain"}, "asn": "AS-C"}'),
         ("203.0.113.3", False, False, '{"mobile": true, "country": "France"}')]
ENRICHED = """ref(ip, country, country_iso, city, asn, lat, ip_type, ipsum_tier, is_tor) AS (VALUES
  ('203.0.113.0', 'Germany', 'DE', 'Berlin', 'AS-A', 52.5, 'vpn', 3, false), ('203.0.113.1', 'France', 'FR', NULL, 'AS-B', 48.8, 'tor', NULL, true),
  ('203.0.113.2', 'Spain', NULL, NULL, 'AS-C', NULL, 'datacenter', 5, false), ('203.0.113.3', 'France', NULL, NULL, NULL, NULL, 'isp', NULL, false),
  ('203.0.113.4', NULL, NULL, NULL, NULL, NULL, NULL, NULL, false))"""
FLOWS = f"""flows AS (SELECT src_ip, dst_ip, count(*) AS conn_count FROM ne WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1, 2
  ORDER BY conn_count DESC, src_ip, dst_ip LIMIT 500),
pub AS (SELECT ip, CAST(sum(conn_count) AS BIGINT) AS conn_total FROM (SELECT src_ip AS ip, conn_count FROM flows UNION ALL SELECT dst_ip, conn_count FROM flows) WHERE starts_with(ip, '203.') GROUP BY 1)"""


def flows(spark, sf):
    return I.top_flows(events(spark, sf), AS_OF, 604800)


def enriched(spark, sf):
    cache = spark.createDataFrame(CACHE, "ip string, is_proxy boolean, is_datacenter boolean, result_json string")
    ipsum = spark.createDataFrame([("203.0.113.0", 3), ("203.0.113.2", 5), ("9.9.9.9", 1)], "ip string, tier int")
    tor = spark.createDataFrame([("203.0.113.1",), ("8.8.8.8",)], "ip string")
    return I.enrich_ips(I.public_ips(flows(spark, sf)), cache, ipsum, tor)


@query("ti8_ip_enrichment", with_ne("SELECT ip, conn_total, country, country_iso, city, asn, CAST(lat AS DOUBLE) AS lat, ip_type, ipsum_tier, is_tor FROM pub LEFT JOIN ref USING (ip)", FLOWS, ENRICHED))
def ti8(spark, sf):
    return enriched(spark, sf).select("ip", "conn_total", "country", "country_iso", "city", "asn", "lat", "ip_type", "ipsum_tier", "is_tor")


@query("ti9_blocklist_refresh", "SELECT '7.7.7.' || s_suppkey AS ip, CAST(s_suppkey % 9 AS INT) AS tier, '2024-01-30' AS fetched_on FROM supplier")
def ti9(spark, sf):
    """Replaced twice and once with an empty download, which must not wipe the list."""
    folder = scratch_folder(spark) + "/ipsum"
    fresh = table(spark, sf, "supplier").selectExpr("concat('7.7.7.', s_suppkey) AS ip", "cast(s_suppkey % 9 as int) AS tier")
    I.refresh_blocklist(fresh.withColumn("tier", F.lit(0)), folder, "2024-01-30")
    I.refresh_blocklist(fresh, folder, "2024-01-30")
    I.refresh_blocklist(fresh.limit(0), folder, "2024-01-30")
    return spark.read.parquet(folder).select("ip", "tier", F.col("fetched_on").cast("string"))


@query("ti10_top_flows", with_ne("SELECT *, 'outbound' AS direction FROM flows", FLOWS))
def ti10(spark, sf):
    return flows(spark, sf)


@query("ti11_map_stats", with_ne("""
SELECT count(*) AS total_ips, count(*) FILTER (ip_type = 'tor') AS tor_count, count(*) FILTER (ip_type = 'vpn') AS vpn_count, count(*) FILTER (ip_type = 'datacenter') AS datacenter_count,
 (SELECT country FROM pub JOIN ref USING (ip) WHERE country IS NOT NULL GROUP BY 1 ORDER BY sum(conn_total) DESC, country DESC LIMIT 1) AS top_src_country,
 coalesce((SELECT CAST(max(n) AS BIGINT) FROM (SELECT sum(conn_total) AS n FROM pub JOIN ref USING (ip) WHERE country IS NOT NULL GROUP BY country)), 0) AS top_src_country_conn_count,
 (SELECT count(*) FROM flows) AS flow_count FROM pub JOIN ref USING (ip)""", FLOWS, ENRICHED))
def ti11(spark, sf):
    return I.map_stats(enriched(spark, sf), flows(spark, sf))


# ---- assets --------------------------------------------------------------------------------------------

ASSETS = """sides AS (SELECT src_ip AS ip, hostname, timestamp, event_id FROM ne UNION ALL SELECT dst_ip, hostname, timestamp, event_id FROM ne),
assets AS (SELECT ip, min(timestamp) AS first_seen, max(timestamp) AS last_seen, arg_max(hostname, timestamp) AS hostname,
  CASE WHEN starts_with(ip, '203.') THEN 'external' ELSE 'internal' END AS tag FROM sides GROUP BY 1)"""
COUNTS = """counts AS (SELECT ip, count(*) AS alert_count, CAST(least(100, count(*) * 10) AS INT) AS risk_score FROM (
  SELECT DISTINCT detection_id, src_ip AS ip FROM links JOIN ne USING (event_id)) GROUP BY 1)"""


@query("ast1_asset_inventory", with_ne("SELECT * FROM assets", ASSETS))
def ast1(spark, sf):
    return I.asset_inventory(events(spark, sf))


@query("ast2_alert_counts", with_ne("SELECT * FROM counts", D.LINKS, COUNTS))
def ast2(spark, sf):
    return I.alert_counts(D.detection_links(spark, sf), events(spark, sf))


@query("ast2_list_assets", with_ne("""
SELECT ip, last_seen, coalesce(alert_count, 0) AS alert_count, coalesce(risk_score, 0) AS risk_score FROM (SELECT * FROM assets ORDER BY last_seen DESC, ip LIMIT 200) LEFT JOIN counts USING (ip)""",
    D.LINKS, ASSETS, COUNTS))
def ast2b(spark, sf):
    e = events(spark, sf)
    return I.list_assets(I.asset_inventory(e), I.alert_counts(D.detection_links(spark, sf), e)).select("ip", "last_seen", "alert_count", "risk_score")


# ---- privacy ---------------------------------------------------------------------------------------------

IS_TRACKER = "regexp_matches({0}, '(^|\\.)tracker[02]\\.com$')"


def blocklist(spark):
    return spark.createDataFrame([(d,) for d in D.TRACKERS], "domain string")


@query("prv1_cookie_exfil", with_ne(f"""
SELECT event_id, 'privacy-cookie_exfil' AS rule_id, domain AS entity_key, 'Large HTTP request body (' || http_request_body_len || ' bytes) to known tracker ' || domain AS explanation
FROM ne WHERE event_type = 'http' AND http_request_body_len > 4096 AND {IS_TRACKER.format('domain')}"""))
def prv1(spark, sf):
    return I.cookie_exfil(events(spark, sf), blocklist(spark)).select("event_id", "rule_id", "entity_key", "explanation")


@query("prv1_cookie_exfil_last_day", with_ne(f"""
SELECT event_id FROM ne WHERE event_type = 'http' AND http_request_body_len > 4096 AND {IS_TRACKER.format('domain')} AND ingested_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY"""))
def prv1b(spark, sf):
    return I.cookie_exfil(events(spark, sf), blocklist(spark), as_of=AS_OF, lookback="1 DAY").select("event_id")


@query("prv2_tracking_pixels", with_ne(f"""
SELECT event_id, 'Tiny ' || coalesce(http_resp_mime_type, 'unknown') || ' response (' || http_response_body_len || ' bytes) from known tracker ' || domain AS explanation
FROM ne WHERE event_type = 'http' AND http_response_body_len BETWEEN 1 AND 199 AND coalesce(http_resp_mime_type, 'image/gif') = 'image/gif' AND {IS_TRACKER.format('domain')}"""))
def prv2(spark, sf):
    return I.tracking_pixels(events(spark, sf), blocklist(spark)).select("event_id", "explanation")


@query("prv3_dns_trackers", with_ne(f"""
SELECT arg_max(event_id, timestamp) AS event_id, 'DNS query for known tracker domain ' || dns_query || ' from ' || src_ip AS explanation
FROM ne WHERE event_type = 'dns_query' AND {IS_TRACKER.format('dns_query')} GROUP BY src_ip, dns_query"""))
def prv3(spark, sf):
    return I.dns_trackers(events(spark, sf), blocklist(spark)).select("event_id", "explanation")


RECENT = f"""recent AS (SELECT event_id, coalesce({IS_TRACKER.format('domain')}, false) AS is_tracker FROM ne WHERE event_type = 'http' AND domain IS NOT NULL ORDER BY timestamp DESC, event_id DESC LIMIT 200)"""


@query("prv4_recent_http_flagged", with_ne("SELECT * FROM recent", RECENT))
def prv4(spark, sf):
    return I.recent_http_flagged(events(spark, sf), blocklist(spark)).select("event_id", "is_tracker")


@query("prv4_recent_dns_flagged", with_ne(f"""
SELECT event_id, coalesce({IS_TRACKER.format('dns_query')}, false) AS is_tracker FROM ne WHERE event_type = 'dns_query' ORDER BY timestamp DESC, event_id DESC LIMIT 500"""))
def prv4b(spark, sf):
    return I.recent_dns_flagged(events(spark, sf), blocklist(spark)).select("event_id", "is_tracker")


@query("prv4_tracker_count", with_ne("SELECT count(*) AS total, count(*) FILTER (is_tracker) AS tracker_count FROM recent", RECENT))
def prv4c(spark, sf):
    return I.tracker_count(I.recent_http_flagged(events(spark, sf), blocklist(spark)))


DOMAIN_STORE = """hosts AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS domain FROM pages),
dstore AS (SELECT domain, 'disconnect' AS feed, TIMESTAMP '2024-01-01' AS updated_at FROM hosts WHERE length(domain) % 2 = 0),
dnew AS (SELECT domain, 'easyprivacy' AS feed, TIMESTAMP '2024-01-05' AS updated_at FROM hosts WHERE length(domain) % 3 = 0),
merged AS (SELECT domain, arg_max(feed, updated_at) AS feed, max(updated_at) AS updated_at FROM (SELECT * FROM dstore UNION ALL SELECT * FROM dnew) GROUP BY 1)"""


def merged_domains(spark, sf):
    hosts = table(spark, sf, "pages").select(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("domain")).distinct()
    old = hosts.filter("length(domain) % 2 = 0").selectExpr("domain", "'disconnect' AS feed", "timestamp'2024-01-01' AS updated_at")
    new = hosts.filter("length(domain) % 3 = 0").selectExpr("domain", "'easyprivacy' AS feed", "timestamp'2024-01-05' AS updated_at")
    return I.upsert_domains(old, new)


@query("prv5_upsert_domains", f"WITH {DOMAIN_STORE} SELECT * FROM merged")
def prv5(spark, sf):
    return merged_domains(spark, sf)


@query("prv5_domain_feed_status", f"WITH {DOMAIN_STORE} SELECT feed, count(*) AS domains, max(updated_at) AS last_sync FROM merged GROUP BY 1")
def prv5b(spark, sf):
    return I.domain_feed_status(merged_domains(spark, sf))


# ---- coverage ------------------------------------------------------------------------------------------------

PLAYBOOKS = [("T1059.001", "Malware Response"), ("T1059.001", "Intrusion Response"), ("T1110", "Account Response"), ("T1486", "Ransomware"), ("T1566", "Phishing"),
             ("not-a-technique", "Other"), ("T9999", "Unlisted")]
PB_SQL = "pb(technique, playbook) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PLAYBOOKS) + ")"
TACTIC_LIST = "(" + ", ".join(f"'{t}'" for t in ATTACK_TACTICS) + ")"
PRIO_SQL = "prio(technique_id, name, tactic) AS (VALUES " + ", ".join(
    f"('{t}', '{n}', '{tac}')" for tac, items in PRIORITY_TECHNIQUES.items() for t, n in items) + ")"
HEAT = f"""seen AS (SELECT attack_technique AS technique_id, count(*) AS n FROM ne WHERE attack_technique IS NOT NULL AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY GROUP BY 1),
books AS (SELECT technique AS technique_id, string_agg(playbook, ',' ORDER BY playbook) AS playbooks FROM pb WHERE regexp_matches(technique, '^T\\d{{4}}(\\.\\d{{3}})?$') GROUP BY 1),
heat AS (SELECT technique_id, coalesce(name, technique_id) AS name, coalesce(tactic, 'Unknown') AS tactic, name IS NOT NULL AS priority, coalesce(n, 0) AS detected_count, coalesce(playbooks, '') AS playbooks,
  CASE WHEN n > 0 AND playbooks IS NOT NULL THEN 'detected_and_playbooked' WHEN n > 0 THEN 'detected' WHEN playbooks IS NOT NULL THEN 'playbooked_only' ELSE 'gap' END AS status
  FROM prio FULL JOIN seen USING (technique_id) FULL JOIN books USING (technique_id))"""


def playbooks(spark):
    return spark.createDataFrame(PLAYBOOKS, "technique string, playbook string")


def heatmap(spark, sf):
    return C.technique_heatmap(events(spark, sf), playbooks(spark), AS_OF, "10 DAYS")


@query("cov1_attack_matrix", f"""WITH {D.DET}, {PB_SQL},
f AS (SELECT DISTINCT attack_technique AS technique, CASE WHEN lower(attack_tactic) IN {TACTIC_LIST} THEN lower(attack_tactic) ELSE 'other' END AS tactic FROM det WHERE attack_technique IS NOT NULL),
p AS (SELECT DISTINCT technique, coalesce((SELECT min(tactic) FROM f WHERE f.technique = pb.technique), 'other') AS tactic FROM pb WHERE regexp_matches(technique, '^T\\d{{4}}'))
SELECT technique, tactic, concat_ws(',', CASE WHEN f.technique IS NOT NULL THEN 'detected' END, CASE WHEN p.technique IS NOT NULL THEN 'playbook_covered' END) AS sources,
  CASE WHEN f.technique IS NOT NULL THEN 'detected' ELSE 'playbook_covered' END AS status FROM f FULL JOIN p USING (technique, tactic)""")
def cov1(spark, sf):
    return C.attack_matrix(D.detections(spark, sf), playbooks(spark)).withColumn("sources", F.array_join("sources", ","))


@query("cov2_technique_heatmap", with_ne("SELECT * FROM heat", PB_SQL, PRIO_SQL, HEAT))
def cov2(spark, sf):
    return heatmap(spark, sf).drop("playbooked").withColumn("playbooks", F.array_join("playbooks", ","))


@query("cov3_coverage_summary", with_ne("""
SELECT count(*) AS total_priority, count(*) FILTER (detected_count > 0) AS detected, count(*) FILTER (playbooks <> '') AS playbooked, count(*) FILTER (status <> 'gap') AS covered,
  count(*) FILTER (status = 'gap') AS gaps, CAST(round_even(count(*) FILTER (status <> 'gap') / count(*) * 100, 0) AS INT) AS coverage_pct FROM heat WHERE priority""", PB_SQL, PRIO_SQL, HEAT))
def cov3(spark, sf):
    return C.coverage_summary(heatmap(spark, sf))


TECHS = [("T1059", "execution"), ("T1110", "credential-access"), ("T1071", "command-and-control"), ("T1046", "discovery"), ("T1003", "credential-access"), ("T1055", "privilege-escalation"), ("T1486", "impact")]
TECH_SQL = "techs(tech_id, tactic) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TECHS) + ")"


def rule_techniques(spark, sf):
    return D.detections(spark, sf).filter("attack_technique IS NOT NULL").select(
        F.substring_index("attack_technique", ".", 1).alias("tech_id"), F.col("rule_name").alias("rule_title"))


@query("cov4_tactic_coverage", f"""WITH {D.DET}, {TECH_SQL}
SELECT CAST(position AS INT) AS position, t.tactic, count(tech_id) AS total_techniques, count(*) FILTER (tech_id IN (SELECT split_part(attack_technique, '.', 1) FROM det)) AS covered_count
FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(ATTACK_TACTICS))}) t(position, tactic) LEFT JOIN techs ON techs.tactic = t.tactic GROUP BY 1, 2""")
def cov4(spark, sf):
    return C.tactic_coverage(spark.createDataFrame(TECHS, "tech_id string, tactic string"), rule_techniques(spark, sf))


GROUPS = [("g1", "Alpha"), ("g2", "Beta"), ("g3", "Gamma"), ("g4", "Delta")]
GROUP_TECHS = [("g1", "T1059"), ("g1", "T1110"), ("g2", "T1059"), ("g2", "T1486"), ("g2", "T1490"), ("g3", "T1486"), ("g4", "T1046"), ("g4", "T1003"), ("g4", "T1490")]


@query("cov5_actor_matches", f"""WITH {D.DET}, seen AS (SELECT DISTINCT split_part(attack_technique, '.', 1) AS tech_id FROM det WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY),
g(stix_id, name) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in GROUPS)}), gt(stix_id, tech_id) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in GROUP_TECHS)})
SELECT name, count(*) FILTER (tech_id IN (SELECT tech_id FROM seen)) AS matched_count, count(*) AS total_count, round(count(*) FILTER (tech_id IN (SELECT tech_id FROM seen)) / count(*), 4) AS overlap,
  CASE WHEN count(*) FILTER (tech_id IN (SELECT tech_id FROM seen)) / count(*) >= 0.6 THEN 'High' WHEN count(*) FILTER (tech_id IN (SELECT tech_id FROM seen)) / count(*) >= 0.3 THEN 'Medium' ELSE 'Low' END AS confidence
FROM g JOIN gt USING (stix_id) GROUP BY 1 ORDER BY count(*) FILTER (tech_id IN (SELECT tech_id FROM seen)) / count(*) DESC, name LIMIT 3""")
def cov5(spark, sf):
    det = D.detections(spark, sf)
    per_detection = det.filter("attack_technique IS NOT NULL").select(F.col("id").alias("detection_id"), F.substring_index("attack_technique", ".", 1).alias("tech_id"))
    seen = C.recent_technique_ids(per_detection, det, AS_OF)
    out = C.actor_matches(spark.createDataFrame(GROUPS, "stix_id string, name string"), spark.createDataFrame(GROUP_TECHS, "stix_id string, tech_id string"), seen)
    return out.select("name", "matched_count", "total_count", F.round("overlap_pct", 4).alias("overlap"), "confidence")


ATOMICS = [("T1059", 1, "Shell"), ("T1059.001", 1, "PowerShell"), ("T1059.001", 2, "PowerShell"), ("T1110", 1, "Brute Force"), ("T1486", 1, "Encrypt"), ("T1003", 1, "Dump")]


@query("cov6_atomics_coverage", f"""WITH {D.DET}, hit AS (SELECT attack_technique AS t FROM det WHERE attack_technique IS NOT NULL UNION SELECT split_part(attack_technique, '.', 1) FROM det WHERE attack_technique IS NOT NULL)
SELECT technique_id, display_name, count(*) AS tests, CASE WHEN technique_id = 'T1110' THEN 'validated' WHEN technique_id IN (SELECT t FROM hit) THEN 'detected' ELSE 'none' END AS coverage
FROM (VALUES {", ".join(f"('{a}', {b}, '{c}')" for a, b, c in ATOMICS)}) a(technique_id, n, display_name) GROUP BY 1, 2""")
def cov6(spark, sf):
    checks = spark.createDataFrame([("T1110", 1, "pass"), ("T1486", 1, "fail")], "technique_id string, test_number int, verdict string")
    return C.atomics_coverage(spark.createDataFrame(ATOMICS, "technique_id string, test_number int, display_name string"), D.detections(spark, sf), checks)


@query("cov7_validate_tests", with_ne("""
SELECT n.event_id AS request_id, x.id AS detection_id, CASE WHEN x.id IS NULL THEN 'fail' ELSE 'pass' END AS verdict FROM ne n LEFT JOIN (
  SELECT n.event_id, arg_max(d.id, (d.created_at, d.id)) AS id FROM ne n JOIN det d ON split_part(d.attack_technique, '.', 1) = split_part(n.attack_technique, '.', 1)
    AND d.created_at <= n.timestamp AND d.created_at > n.timestamp - INTERVAL 3600 SECOND GROUP BY 1) x USING (event_id) WHERE n.attack_technique IS NOT NULL""", D.DET))
def cov7(spark, sf):
    asked = events(spark, sf).filter("attack_technique IS NOT NULL").select(F.col("event_id").alias("request_id"), F.col("attack_technique").alias("technique_id"), F.col("timestamp").alias("checked_at"))
    return C.validate_tests(asked, D.detections(spark, sf), 3600).select("request_id", "detection_id", "verdict")


# ---- timelines ------------------------------------------------------------------------------------------------

REFS = "concat_ws(' ', 'host:' || lower(hostname), 'user:' || lower(username), 'process:' || process_name, 'ip:' || dst_ip, 'domain:' || lower(domain))"


@query("tim1_case_timeline", with_ne(f"""
SELECT event_id, timestamp, source_type AS event_source, {REFS} AS refs, CAST(CASE WHEN event_id IN (SELECT event_id FROM links JOIN det ON id = detection_id WHERE det.severity = 'critical') THEN 1.0
  WHEN attack_technique IS NOT NULL THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence_score FROM ne WHERE case_id = 'case-3'""", D.DET, D.LINKS))
def tim1(spark, sf):
    critical = D.detections(spark, sf).filter("severity = 'critical'").select(F.col("id").alias("detection_id"))
    links = D.detection_links(spark, sf).join(critical, "detection_id", "left_semi")
    out = T.case_timeline(events(spark, sf), "case-3", links)
    return out.withColumn("refs", F.array_join("entity_references", " ")).drop("entity_references")


@query("tim1_case_timeline_fallback", with_ne("SELECT event_id, 1.0::DOUBLE AS confidence_score FROM ne WHERE event_id IN (SELECT event_id FROM links JOIN det ON id = detection_id WHERE rule_id = 'rule-src5')", D.DET, D.LINKS))
def tim1b(spark, sf):
    alerts = D.detections(spark, sf).filter("rule_id = 'rule-src5'").select(F.col("id").alias("detection_id"))
    links = D.detection_links(spark, sf).join(alerts, "detection_id", "left_semi")
    return T.case_timeline(events(spark, sf), "no-such-case", links).select("event_id", "confidence_score")


@query("tim2_merged_timeline", with_ne("""
SELECT 'ev-' || event_id AS item_id, 'event' AS item_type, timestamp, event_type || ' on ' || hostname || coalesce(' — ' || process_name, '') AS title, severity FROM ne
UNION ALL SELECT 'det-' || id, 'detection', created_at, rule_name, severity FROM det
UNION ALL SELECT 'edge-' || substr(sha256(source_id || '|' || edge_type || '|' || target_id), 1, 16), 'edge', created_at, source_id || ' --[' || edge_type || ']--> ' || target_id, NULL FROM edges
UNION ALL SELECT 'pb-' || run_id, 'playbook', started_at, 'Playbook: ' || playbook_name || ' — ' || status, NULL FROM runs""", *GRAPH, D.DET, D.RUNS))
def tim2(spark, sf):
    e = events(spark, sf)
    return T.merged_timeline(e, D.detections(spark, sf), G.build_graph(e)[1], D.playbook_runs(spark, sf)).select("item_id", "item_type", "timestamp", "title", "severity")


INVESTIGATED = """inv AS (SELECT * FROM ne WHERE event_id IN (SELECT event_id FROM links WHERE detection_id = 'det-3')
  OR event_id IN (SELECT m.event_id FROM member m JOIN big USING (cluster_id) WHERE cluster_id IN (SELECT cluster_id FROM member JOIN links USING (event_id) WHERE detection_id = 'det-3')))"""


def investigated(spark, sf):
    e = events(spark, sf)
    matched = D.detection_links(spark, sf).filter("detection_id = 'det-3'")
    return T.expand_investigation(e, matched, K.cluster_events(e, hourly()))


@query("tim3_attack_chain", with_ne("""
SELECT row_number() OVER (ORDER BY timestamp, event_id) - 1 AS step, event_id, coalesce(process_name, username, hostname) AS entity, event_type AS action,
  event_type || ': ' || coalesce(process_name, '') || ' on ' || hostname AS description FROM inv""", HOURLY, D.DET, D.LINKS, INVESTIGATED, recursive=True))
def tim3(spark, sf):
    return T.attack_chain_steps(investigated(spark, sf)).select("step", "event_id", "entity", "action", "description")


@query("tim3_technique_summary", with_ne("SELECT attack_technique AS technique_id, any_value(attack_tactic) AS tactic, count(*) AS count FROM inv WHERE attack_technique IS NOT NULL GROUP BY 1",
       HOURLY, D.DET, D.LINKS, INVESTIGATED, recursive=True))
def tim3b(spark, sf):
    return T.technique_summary(investigated(spark, sf))


@query("tim3_summary", with_ne("""
SELECT concat('Investigation covers ', count(*), ' events across ', count(DISTINCT hostname), ' host(s). ', count(DISTINCT attack_technique), ' MITRE technique(s) observed. ',
  count(*) FILTER (severity IN ('critical', 'high')), ' high/critical severity events.') AS summary FROM inv""", HOURLY, D.DET, D.LINKS, INVESTIGATED, recursive=True))
def tim3c(spark, sf):
    return T.investigation_summary(investigated(spark, sf))


@query("tim4_entity_profile", with_ne("""
SELECT count(*) AS total, count(DISTINCT dst_ip) AS unique_ips, min(anomaly_score) AS min_score, max(anomaly_score) AS max_score, round(avg(anomaly_score), 6) AS avg_score
FROM ne WHERE hostname = 'host-5.corp.local'"""))
def tim4(spark, sf):
    return T.entity_profile(events(spark, sf), "host-5.corp.local").withColumn("avg_score", F.round("avg_score", 6))


@query("tim4_top_processes", with_ne("SELECT process_name, count(*) AS n FROM ne WHERE hostname = 'host-5.corp.local' AND process_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, process_name LIMIT 5"))
def tim4b(spark, sf):
    return T.top_processes(events(spark, sf), "host-5.corp.local")


@query("tim5_type_breakdown", with_ne("SELECT event_type, count(*) AS cnt FROM ne WHERE hostname = 'host-7.corp.local' AND contains(process_name, 'cmd') GROUP BY 1 ORDER BY cnt DESC, event_type LIMIT 20"))
def tim5(spark, sf):
    return T.type_breakdown(events(spark, sf), hostname="host-7.corp.local", process_name="CMD")


@query("tim6_recent_detections", f"WITH {D.DET} SELECT id, rule_id, created_at FROM det WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR ORDER BY created_at DESC, id DESC LIMIT 10")
def tim6(spark, sf):
    return T.recent_detections(D.detections(spark, sf), AS_OF).select("id", "rule_id", "created_at")


@query("tim6_named_neighbours", with_ne("""
SELECT t.type, t.name, e.edge_type FROM edges e JOIN ents s ON s.id = e.source_id JOIN ents t ON t.id = e.target_id WHERE s.name = 'px.tracker1.com'
ORDER BY e.created_at DESC, e.target_id, e.edge_type LIMIT 10""", *GRAPH))
def tim6b(spark, sf):
    entities, edges = G.build_graph(events(spark, sf))
    return T.named_neighbours(entities, edges, "px.tracker1.com")
