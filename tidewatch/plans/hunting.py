"""Filter, search, hunt and list queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import hunt as H
from tidewatch.plans import derived as D
from tidewatch.plans.model import AS_OF, events, query, table, with_ne
from tidewatch.schema import AUTH_EVENT_TYPES

NEWEST = "ORDER BY timestamp DESC, event_id DESC"
SHOW = ["event_id", "timestamp", "hostname", "event_type", "severity"]
SHOW_SQL = ", ".join(SHOW)
FILTERS = dict(hostname="HOST-1", process_name="exe", severity="MEDIUM", event_type="conn", time_from="2024-01-03 00:00:00", time_to="2024-01-20 00:00:00")
FILTER_SQL = ("contains(lower(hostname), 'host-1') AND contains(lower(process_name), 'exe') AND severity = 'medium' AND contains(event_type, 'conn') "
              "AND timestamp >= TIMESTAMP '2024-01-03' AND timestamp <= TIMESTAMP '2024-01-20'")
AUTH_SQL = "(" + ", ".join(f"'{t}'" for t in AUTH_EVENT_TYPES) + ")"


@query("flt1_list_events_page", with_ne(f"SELECT {SHOW_SQL} FROM ne WHERE {FILTER_SQL} {NEWEST} LIMIT 20 OFFSET 20"))
def flt1(spark, sf):
    return H.list_events(events(spark, sf), page=2, page_size=20, **FILTERS).select(*SHOW)


@query("flt1_list_events_total", with_ne(
    f"SELECT count(*) AS total, 2 AS page, 20 AS page_size, count(*) > 40 AS has_next FROM ne WHERE {FILTER_SQL}"))
def flt1b(spark, sf):
    return H.page_info(events(spark, sf), page=2, page_size=20, **FILTERS)


@query("flt1_filter_case", with_ne("SELECT event_id FROM ne WHERE case_id = 'case-3' AND contains(hostname, 'host-3')"))
def flt1c(spark, sf):
    return H.event_filter(events(spark, sf), case_id="case-3", hostname="host-3").select("event_id")


SEARCH_SQL = " OR ".join(f"coalesce(contains(lower({c}), 'tracker1'), false)" for c in H.SEARCH_COLUMNS)


@query("flt2_search", with_ne(f"SELECT {SHOW_SQL} FROM ne WHERE {SEARCH_SQL}"))
def flt2(spark, sf):
    return H.search(events(spark, sf), "Tracker1").select(*SHOW)


@query("flt3_point_lookup", with_ne(f"SELECT {SHOW_SQL}, domain, dst_port FROM ne WHERE event_id = '517'"))
def flt3(spark, sf):
    return H.get_event(events(spark, sf), "517").select(*SHOW, "domain", "dst_port")


@query("flt4_investigation_query", with_ne(
    f"SELECT {SHOW_SQL} FROM ne WHERE (contains(hostname, '0.113') OR contains(event_type, '0.113') OR contains(src_ip, '0.113') "
    "OR contains(dst_ip, '0.113') OR coalesce(contains(domain, '0.113'), false)) AND severity = 'low' AND contains(lower(attack_technique), 't1059')"))
def flt4(spark, sf):
    return H.investigation_query(events(spark, sf), "0.113", "LOW", "t1059").select(*SHOW)


@query("flt5_entity_lookup", with_ne(
    "SELECT 'ip:192.168.1.3' AS entity_id, count(*) AS event_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ne "
    "WHERE src_ip = '192.168.1.3' OR dst_ip = '192.168.1.3'"))
def flt5(spark, sf):
    return H.entity_summary(events(spark, sf), "ip:192.168.1.3")


@query("flt6_suspicious_ip", with_ne(
    "SELECT DISTINCT hostname, src_ip, dst_ip, timestamp, event_type FROM ne WHERE dst_ip = '203.0.113.2' "
    "ORDER BY timestamp DESC, hostname, src_ip, event_type LIMIT 200"))
def flt6(spark, sf):
    return H.suspicious_ip_comms(events(spark, sf), "203.0.113.2")


@query("flt7_process_children", with_ne(
    f"SELECT event_id, process_name, process_id, command_line FROM ne WHERE contains(lower(parent_process_name), 'winword') {NEWEST} LIMIT 200"))
def flt7(spark, sf):
    return H.powershell_children(events(spark, sf), parent="WINWORD").select("event_id", "process_name", "process_id", "command_line")


@query("flt8_unusual_auth", with_ne(
    f"SELECT hostname, username, count(*) AS cnt, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ne "
    f"WHERE event_type IN {AUTH_SQL} GROUP BY 1, 2 HAVING count(*) > 2 ORDER BY cnt DESC, hostname, username LIMIT 100"))
def flt8(spark, sf):
    return H.unusual_auth(events(spark, sf), 2, AUTH_EVENT_TYPES)


@query("flt9_indicator_search", with_ne(
    f"SELECT {SHOW_SQL} FROM ne WHERE dst_ip = 'tracker0' OR src_ip = 'tracker0' OR coalesce(file_hash_sha256 = 'tracker0', false) "
    f"OR contains(hostname, 'tracker0') OR contains(lower(username), 'tracker0') OR coalesce(contains(domain, 'tracker0'), false) {NEWEST} LIMIT 500"))
def flt9(spark, sf):
    return H.indicator_search(events(spark, sf), "tracker0").select(*SHOW)


PRESET_SQL = {
    "ps_child": "parent_process_name = 'WmiPrvSE.exe' AND false",
    "auth_hours": f"event_type IN {AUTH_SQL} AND (hour(timestamp) < 7 OR hour(timestamp) >= 19)",
    "lolbin": "process_name = 'certutil.exe'",
    "lateral": "parent_process_name = 'WmiPrvSE.exe'",
    "cred_dump": "event_type = 'process_access' OR contains(command_line, 'lsass')",
    "tls_ja3": "tls_ja3 IS NOT NULL",
    "http_ua": "event_type = 'http' AND (http_user_agent IS NULL OR regexp_matches(http_user_agent, 'curl|python-requests|Go-http-client'))",
    "exfil_upload": "http_request_body_len > 1000000",
    "rdp_lateral": "dst_port = 3389",
    "smb_enum": "contains(smb_action, 'TREE_CONNECT') OR smb_path IS NOT NULL",
    "ioc_hits": "ioc_matched",
    "zeek_notice": "zeek_notice_note IS NOT NULL OR zeek_weird_name IS NOT NULL",
    "encoded_cmd": "contains(command_line, '-enc')",
    "schtask_persist": "contains(command_line, 'schtasks')",
    "ntlm_relay": "ntlm_username IS NOT NULL",
    "av_kill": "contains(command_line, 'net stop')",
}
PRESET_NUMBER = {name: i + 1 for i, name in enumerate(
    ["ps_child", "beaconing", "auth_hours", "lolbin", "lateral", "cred_dump", "dns_tunnel", "tls_ja3", "http_ua", "exfil_upload",
     "ssh_brute", "rdp_lateral", "smb_enum", "ioc_hits", "zeek_notice", "encoded_cmd", "schtask_persist", "port_scan", "ntlm_relay", "av_kill"])}


def _register_preset(name: str, test: str) -> None:
    @query(f"flt10_{PRESET_NUMBER[name]:02d}_{name}", with_ne(f"SELECT event_id, timestamp FROM ne WHERE coalesce({test}, false)"))
    def run(spark, sf):
        return H.preset(events(spark, sf), name).select("event_id", "timestamp")


for _name, _test in PRESET_SQL.items():
    if _name not in ("ps_child", "cred_dump"):
        _register_preset(_name, _test)


@query("flt10_01_ps_child", with_ne("SELECT event_id, timestamp FROM ne WHERE parent_process_name = 'explorer.exe' "
                                    "AND coalesce(process_name, '') NOT IN ('powershell.exe', 'conhost.exe', 'pwsh.exe')"))
def flt10_1(spark, sf):
    e = events(spark, sf).withColumn("parent_process_name", F.when(F.col("parent_process_name") == "explorer.exe", "PowerShell.exe"))
    return H.preset(e, "ps_child").select("event_id", "timestamp")


@query("flt10_06_cred_dump", with_ne("SELECT event_id, timestamp FROM ne WHERE k % 4 = 1 OR event_type = 'logon_success'"))
def flt10_6(spark, sf):
    e = events(spark, sf).withColumns({
        "file_path": F.when(F.col("file_path").startswith("/tmp"), F.lit("C:\\Windows\\System32\\config\\SAM")).otherwise(F.col("file_path")),
        "event_type": F.when(F.col("event_type") == "logon_success", "process_access").otherwise(F.col("event_type"))})
    return H.preset(e, "cred_dump").select("event_id", "timestamp")


@query("flt10_02_beaconing", with_ne("""
SELECT src_ip, dst_ip, count(*) AS gaps, round(stddev_pop(gap), 3) AS jitter FROM (
  SELECT src_ip, dst_ip, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY src_ip, dst_ip ORDER BY timestamp, event_id)) / 1e6 AS gap
  FROM ne WHERE starts_with(dst_ip, '203.')) WHERE gap IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3 AND stddev_pop(gap) < 100000"""))
def flt10_2(spark, sf):
    pairs = H.beacon_pairs(events(spark, sf), max_jitter=100000.0, chunk="day")
    return pairs.select("src_ip", "dst_ip", "gaps", F.round("jitter", 3).alias("jitter"))


@query("flt10_07_dns_tunnel", with_ne("""
SELECT event_id, timestamp FROM ne WHERE event_type = 'dns_query' AND (length(dns_query) > 50
  OR src_ip IN (SELECT src_ip FROM ne WHERE event_type = 'dns_query' GROUP BY 1 HAVING count(*) > 40))"""))
def flt10_7(spark, sf):
    return H.dns_tunnel(events(spark, sf), max_queries=40).select("event_id", "timestamp")


@query("flt10_11_ssh_brute", with_ne("""
SELECT src_ip, count(*) AS rows_of_source FROM ne WHERE coalesce(NOT ssh_auth_success, false) OR coalesce(dst_port = 22, false)
GROUP BY 1 HAVING count(*) > 5"""))
def flt10_11(spark, sf):
    return H.ssh_brute(events(spark, sf))


@query("flt10_18_port_scan", with_ne(f"""
SELECT src_ip, count(DISTINCT dst_port) AS ports FROM ne WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY AND timestamp <= TIMESTAMP '{AS_OF}'
GROUP BY 1 HAVING count(DISTINCT dst_port) > 3"""))
def flt10_18(spark, sf):
    return H.port_scan_sources(events(spark, sf), AS_OF, more_than=3, lookback="10 DAYS")


@query("flt11_rank_results", with_ne(
    "SELECT event_id, severity, timestamp FROM ne WHERE contains(command_line, 'net stop') ORDER BY CASE severity WHEN 'critical' THEN 0 "
    "WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, timestamp DESC, event_id DESC LIMIT 300"))
def flt11(spark, sf):
    return H.rank_results(H.preset(events(spark, sf), "av_kill"), 300).select("event_id", "severity", "timestamp")


@query("flt12_keyword_search", with_ne("""
SELECT event_id FROM ne WHERE contains(lower(concat_ws(' ', hostname, username, process_name, command_line, event_type, src_ip, dst_ip, domain)), 'defender conn')"""))
def flt12(spark, sf):
    return H.keyword_search(events(spark, sf), "Defender conn").select("event_id")


@query("flt13_recent_http", with_ne(f"SELECT event_id, src_ip, domain, http_method FROM ne WHERE event_type = 'http' AND domain IS NOT NULL {NEWEST} LIMIT 200"))
def flt13(spark, sf):
    return H.recent_http(events(spark, sf)).select("event_id", "src_ip", "domain", "http_method")


@query("flt13_recent_dns", with_ne(f"SELECT event_id, src_ip, dns_query FROM ne WHERE event_type = 'dns_query' AND dns_query IS NOT NULL {NEWEST} LIMIT 500"))
def flt13b(spark, sf):
    return H.recent_dns(events(spark, sf)).select("event_id", "src_ip", "dns_query")


@query("flt13_recent_tls", with_ne(f"SELECT event_id, dst_ip, tls_version, tls_ja3 FROM ne WHERE event_type = 'conn' {NEWEST} LIMIT 500"))
def flt13c(spark, sf):
    return H.recent_tls(events(spark, sf), types=["conn"]).select("event_id", "dst_ip", "tls_version", "tls_ja3")


@query("flt14_list_detections", f"""WITH {D.DET}, {D.FEEDBACK}
SELECT id, rule_id, severity, verdict, created_at FROM det LEFT JOIN feedback ON detection_id = id WHERE severity = 'high' ORDER BY created_at DESC, id DESC LIMIT 100""")
def flt14(spark, sf):
    return H.list_detections(D.detections(spark, sf), D.feedback(spark, sf), severity="high").select("id", "rule_id", "severity", "verdict", "created_at")


@query("flt14_detections_by_verdict", f"""WITH {D.DET}, {D.FEEDBACK}
SELECT id, verdict FROM det JOIN feedback ON detection_id = id WHERE verdict = 'FP' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10""")
def flt14b(spark, sf):
    return H.list_detections(D.detections(spark, sf), D.feedback(spark, sf), verdict="FP", limit=50, offset=10).select("id", "verdict")


@query("flt15_triage_batch", f"""WITH {D.DET}
SELECT id, 'Rule: ' || rule_name || ' | Severity: ' || severity || ' | Technique: ' || coalesce(attack_technique, '?') || ' | Tactic: ' || coalesce(attack_tactic, '?') AS summary
FROM det WHERE triaged_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 20""")
def flt15(spark, sf):
    return H.triage_batch(D.detections(spark, sf)).select("id", "summary")


@query("flt15_mark_triaged", f"""WITH {D.DET}, b AS (SELECT id FROM det WHERE triaged_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 20)
SELECT det.id, CASE WHEN b.id IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE triaged_at END AS triaged_at FROM det LEFT JOIN b ON b.id = det.id""")
def flt15b(spark, sf):
    d = D.detections(spark, sf)
    return H.mark_triaged(d, H.triage_batch(d), F.lit(AS_OF).cast("timestamp")).select("id", "triaged_at")


@query("flt16_top_threats", f"WITH {D.DET} SELECT id, CAST((doc_id * 7) % 101 AS INT) AS risk_score FROM det ORDER BY risk_score DESC, created_at DESC, id LIMIT 10")
def flt16(spark, sf):
    return H.top_threats(D.detections(spark, sf).withColumn("risk_score", F.expr("cast((doc_id * 7) % 101 as int)"))).select("id", "risk_score")


@query("flt17_high_anomalies", with_ne(
    "SELECT event_id, anomaly_score FROM ne WHERE anomaly_score >= 0.7 ORDER BY anomaly_score DESC, timestamp DESC, event_id LIMIT 50"))
def flt17(spark, sf):
    return H.list_anomalies(events(spark, sf)).select("event_id", "anomaly_score")


@query("flt18_recommendations", f"WITH {D.RECS} SELECT recommendation_id, generated_at FROM recs WHERE status = 'approved' AND case_id = 'case-2' "
       "ORDER BY generated_at DESC, recommendation_id DESC LIMIT 50 OFFSET 50")
def flt18(spark, sf):
    return H.list_recommendations(D.recommendations(spark, sf), status="approved", case_id="case-2", offset=50).select("recommendation_id", "generated_at")


@query("flt18_pending_notifications", f"WITH {D.RECS} SELECT concat('n-', recommendation_id) AS notification_id FROM recs WHERE status = 'draft' "
       "ORDER BY generated_at DESC, concat('n-', recommendation_id) DESC LIMIT 100")
def flt18b(spark, sf):
    notes = D.recommendations(spark, sf).selectExpr(
        "concat('n-', recommendation_id) AS notification_id", "generated_at AS created_at", "case when status = 'draft' then 'pending' else 'sent' end AS status")
    return H.pending_notifications(notes).select("notification_id")


@query("flt19_hunt_sql", with_ne("SELECT hostname, count(*) AS n, max(severity) AS worst FROM ne WHERE dst_port = 22 GROUP BY hostname"))
def flt19(spark, sf):
    return H.hunt_sql(events(spark, sf), "SELECT hostname, count(*) AS n, max(severity) AS worst FROM normalized_events WHERE dst_port = 22 GROUP BY hostname;")


@query("flt20_case_context", with_ne("""
SELECT kind, item, timestamp, title FROM (
  (SELECT 'event' AS kind, event_id AS item, timestamp, event_type AS title FROM ne WHERE case_id = 'case-2' ORDER BY timestamp DESC, event_id DESC LIMIT 50)
  UNION ALL (SELECT 'detection', id, created_at, rule_name FROM det WHERE case_id = 'case-2' ORDER BY created_at DESC, id DESC LIMIT 50))""", D.DET))
def flt20(spark, sf):
    return H.case_context(events(spark, sf), D.detections(spark, sf), "case-2")


@query("flt21_hunt_history", "SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS hunt_id, left(text, 40) AS query FROM conversations WHERE role = 'user' "
       "ORDER BY conv_id * 100 + turn DESC, hunt_id DESC LIMIT 20")
def flt21(spark, sf):
    hunts = table(spark, sf, "conversations").selectExpr(
        "concat(conv_id, '-', turn) AS hunt_id", "role AS analyst_id", "substring(text, 1, 40) AS query", "conv_id * 100 + turn AS created_at")
    return H.hunt_history(hunts, "user").select("hunt_id", "query")
