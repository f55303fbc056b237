"""Threat indicators, address reference data, assets and tracker privacy checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.keyed import cut_lineage, newest_per_key, side_by_side
from tidewatch.functions.scalars import address_tag, domain_suffixes, flow_direction, ip_type, is_private_ip
from tidewatch.operators.hunt import newest_first, recent_dns, recent_http
from tidewatch.schema import DNS_EVENT_TYPES, FEED_STALE_HOURS

IOC_KEY = ["ioc_value", "ioc_type"]

# Joins to indicator and blocklist tables carry no broadcast hint: Spark broadcasts them while they are below
# spark.sql.autoBroadcastJoinThreshold and otherwise shuffles, where adaptive skew handling splits hot addresses.


# ---- indicators ------------------------------------------------------------------------------------

def upsert_iocs(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """New store version: an update keeps first_seen and feed_source and reactivates; a new key is inserted active."""
    fresh = newest_per_key(incoming, IOC_KEY, ["last_seen", "confidence"])
    old, new = store.alias("o"), fresh.alias("n")
    both = old.join(new, IOC_KEY, "full_outer")
    keep_old = ["first_seen", "feed_source", "bare_ip"]
    cells = []
    for c in store.columns:
        if c in IOC_KEY:
            cells.append(F.col(c))
        elif c == "ioc_status":
            cells.append(F.when(F.col("n.confidence").isNotNull(), "active").otherwise(F.col("o.ioc_status")).alias(c))
        elif c in keep_old:
            cells.append(F.when(F.col("o.confidence").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            cells.append(F.when(F.col("n.confidence").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*cells)


def new_iocs(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keys that the store has not seen; these get a retroactive scan."""
    return incoming.join(store.select(*IOC_KEY), IOC_KEY, "left_anti").dropDuplicates(IOC_KEY)


def best_ioc_per_ip(iocs: DataFrame) -> DataFrame:
    """(ip, confidence, actor_tag, ioc_value): exact address entries before bare-address ones, then highest confidence."""
    live = iocs.filter(F.col("confidence") > 0)
    exact = live.filter(F.col("ioc_type") == "ip").select(F.col("ioc_value").alias("ip"), F.lit(1).alias("rank"), "confidence", "actor_tag", "ioc_value")
    bare = live.filter(F.col("bare_ip").isNotNull()).select(F.col("bare_ip").alias("ip"), F.lit(0), "confidence", "actor_tag", "ioc_value")
    best = exact.union(bare).groupBy("ip").agg(
        F.max(F.struct("rank", "confidence", "actor_tag", "ioc_value")).alias("b"))
    return best.select("ip", "b.confidence", "b.actor_tag", "b.ioc_value")


def match_iocs(events: DataFrame, iocs: DataFrame) -> DataFrame:
    """Events with match flag, confidence, actor and the matching value; the source address has priority."""
    best = best_ioc_per_ip(iocs)
    def side(name: str) -> DataFrame:
        return best.select(F.col("ip").alias(f"{name}_ip"), F.struct("confidence", "actor_tag", "ioc_value", F.col("ip").alias("matched_ip")).alias(f"_{name}"))
    joined = events.join(side("src"), "src_ip", "left").join(side("dst"), "dst_ip", "left").withColumn("_hit", F.coalesce("_src", "_dst"))
    keep = [c for c in events.columns if c not in ("ioc_matched", "ioc_confidence", "ioc_actor_tag")]
    return joined.select(*keep, F.col("_hit").isNotNull().alias("ioc_matched"), F.col("_hit.confidence").alias("ioc_confidence"),
                         F.col("_hit.actor_tag").alias("ioc_actor_tag"), F.col("_hit.ioc_value").alias("ioc_value"), F.col("_hit.matched_ip").alias("matched_ip"))


def ioc_hits(matched: DataFrame) -> DataFrame:
    """One hit row per matched event, naming the value that matched."""
    return matched.filter("ioc_matched").select(
        "event_id", F.col("timestamp").alias("event_timestamp"), "hostname", "src_ip", "dst_ip", "ioc_value", "matched_ip",
        F.coalesce("ioc_actor_tag", F.lit("unknown")).alias("ioc_source"), F.col("ioc_confidence").alias("risk_score"))


def retroactive_hits(events: DataFrame, fresh: DataFrame, as_of: str, lookback: str = "30 DAYS") -> DataFrame:
    """All stored events of the lookback that touch any new indicator, one scan for all of them."""
    start = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {lookback}")
    wanted = fresh.select(F.coalesce("bare_ip", "ioc_value").alias("ip"), "ioc_value", "ioc_type", "confidence")
    touched = events.filter(F.col("timestamp") >= start).select(
        "event_id", "timestamp", F.explode(F.array_distinct(F.array_compact(F.array("src_ip", "dst_ip")))).alias("ip"))
    return touched.join(wanted, "ip").select("event_id", "timestamp", "ioc_value", "ioc_type", F.col("confidence").alias("risk_score"))


def mark_stored(spark: SparkSession, folder: str, fresh: DataFrame, as_of: str, lookback: str = "30 DAYS") -> None:
    """Write match flag and confidence of new indicators into the stored events of the lookback.

    Only day partitions with a hit are rewritten, each replaced when the job commits; a rerun gives the same rows. The highest
    confidence wins, and an actor already known stays.
    """
    stored = spark.read.parquet(folder)
    hits = cut_lineage(retroactive_hits(stored, fresh, as_of, lookback).groupBy("event_id").agg(F.max("risk_score").alias("_risk")))
    days = [r[0] for r in stored.join(hits, "event_id", "left_semi").select("event_date").distinct().collect()]     # one row a day
    if not days:
        return
    marked = stored.filter(F.col("event_date").isin(days)).join(hits, "event_id", "left").withColumns({
        "ioc_matched": F.coalesce("ioc_matched", F.lit(False)) | F.col("_risk").isNotNull(),
        "ioc_confidence": F.greatest("ioc_confidence", F.col("_risk").cast(stored.schema["ioc_confidence"].dataType))})
    marked.select(*stored.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(folder)


def feed_status(iocs: DataFrame, syncs: DataFrame, as_of: str) -> DataFrame:
    """Status per known feed from its last sync (feed, last_sync) and its indicator count."""
    spark = iocs.sparkSession
    feeds = spark.createDataFrame(list(FEED_STALE_HOURS.items()), "feed string, stale_hours int")
    counts = iocs.groupBy(F.col("feed_source").alias("feed")).agg(F.count(F.lit(1)).alias("ioc_count"))
    age_hours = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_sync")) / 3600
    return feeds.join(syncs, "feed", "left").join(counts, "feed", "left").select(
        "feed", "last_sync", F.coalesce("ioc_count", F.lit(0)).alias("ioc_count"),
        F.when(F.col("last_sync").isNull(), "never").when(age_hours <= F.col("stale_hours"), "ok").otherwise("stale").alias("status"))


def list_hits(hits: DataFrame, limit: int = 100) -> DataFrame:
    return hits.orderBy(F.col("risk_score").desc(), F.col("event_timestamp").desc(), "event_id").limit(limit)


def list_feed_iocs(iocs: DataFrame, feed: str = "misp", limit: int = 50) -> DataFrame:
    return iocs.filter(F.col("feed_source") == feed).orderBy(F.col("confidence").desc(), "ioc_value", "ioc_type").limit(limit)


def cross_reference(findings: DataFrame, iocs: DataFrame) -> DataFrame:
    """Findings (event_type, data) flagged when an active indicator has the same value."""
    live = iocs.filter(F.col("ioc_status") == "active").groupBy(F.col("ioc_value").alias("data")).agg(F.min("feed_source").alias("feed_source"))
    return findings.join(live, "data", "left").withColumn("misp_hit", F.col("feed_source").isNotNull().cast("int"))


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("event_type").agg(F.count(F.lit(1)).alias("findings"), F.sum("misp_hit").alias("hits"))


# ---- address reference and flows -----------------------------------------------------------------------

def _json_first(body: str, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(body, p) for p in paths])


def enrich_ips(ips: DataFrame, cache: DataFrame, ipsum: DataFrame, tor: DataFrame) -> DataFrame:
    """Reference data of each address; unknown addresses keep nulls and false flags.

    ``cache``: (ip, is_proxy, is_datacenter, result_json); ``ipsum``: (ip, tier); ``tor``: (ip).
    """
    joined = ips.join(cache, "ip", "left").join(ipsum.withColumnRenamed("tier", "ipsum_tier"), "ip", "left") \
                .join(tor.select("ip").distinct().withColumn("is_tor", F.lit(True)), "ip", "left")
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_tor", "is_proxy", "is_datacenter")}
    j = "result_json"
    return joined.withColumns(flags).select(
        *ips.columns,
        _json_first(j, "$.geo.latitude", "$.geo.lat", "$.lat").cast("double").alias("lat"),
        _json_first(j, "$.geo.longitude", "$.geo.lon", "$.lon").cast("double").alias("lon"),
        _json_first(j, "$.geo.country_name", "$.geo.country", "$.country").alias("country"),
        _json_first(j, "$.geo.country_iso_code", "$.geo.countryCode", "$.countryCode").alias("country_iso"),
        _json_first(j, "$.geo.city", "$.city").alias("city"),
        _json_first(j, "$.geo.autonomous_system_organization", "$.geo.org", "$.as", "$.asn").alias("asn"),
        ip_type(F.col("is_tor"), F.col("is_proxy"), F.col("is_datacenter"), F.col(j)).alias("ip_type"),
        "ipsum_tier", "is_tor", "is_proxy", "is_datacenter")


def top_flows(events: DataFrame, as_of: str, window_seconds: int = 86400, limit: int = 500) -> DataFrame:
    """Busiest (source, target) pairs of the window with their direction."""
    start = F.lit(as_of).cast("timestamp") - F.make_interval(secs=F.lit(window_seconds))
    return (events.filter((F.col("timestamp") > start) & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
            .groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("conn_count"))
            .orderBy(F.col("conn_count").desc(), "src_ip", "dst_ip").limit(limit)
            .withColumn("direction", flow_direction(F.col("src_ip"), F.col("dst_ip"))))


def public_ips(flows: DataFrame) -> DataFrame:
    """(ip, conn_total) of the public addresses in a flow table."""
    return (flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"), "conn_count").filter(~is_private_ip(F.col("ip")))
            .groupBy("ip").agg(F.sum("conn_count").alias("conn_total")))


def map_stats(enriched: DataFrame, flows: DataFrame) -> DataFrame:
    by_country = enriched.filter("country IS NOT NULL").groupBy("country").agg(F.sum("conn_total").alias("n"))
    top = by_country.agg(F.max_by("country", F.struct("n", "country")).alias("top_src_country"), F.coalesce(F.max("n"), F.lit(0)).alias("top_src_country_conn_count"))
    kinds = enriched.agg(
        F.count(F.lit(1)).alias("total_ips"), F.count_if(F.col("ip_type") == "tor").alias("tor_count"),
        F.count_if(F.col("ip_type") == "vpn").alias("vpn_count"), F.count_if(F.col("ip_type") == "datacenter").alias("datacenter_count"))
    return side_by_side(kinds, top, flows.agg(F.count(F.lit(1)).alias("flow_count")))


def refresh_blocklist(fresh: DataFrame, folder: str, fetched_on: str) -> bool:
    """Replace the day's partition of a blocklist; an empty download leaves the stored list alone."""
    if fresh.isEmpty():
        return False
    fresh.withColumn("fetched_on", F.lit(fetched_on).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
         .partitionBy("fetched_on").parquet(folder)
    return True


def upsert_domains(store: DataFrame, incoming: DataFrame) -> DataFrame:
    return newest_per_key(store.unionByName(incoming), ["domain"], ["updated_at", "feed"])


def domain_feed_status(store: DataFrame) -> DataFrame:
    return store.groupBy("feed").agg(F.count(F.lit(1)).alias("domains"), F.max("updated_at").alias("last_sync"))


# ---- assets ------------------------------------------------------------------------------------------------

def asset_mentions(events: DataFrame) -> DataFrame:
    """Per address: first and last event time and the latest row with a hostname; mentions of several batches can be merged."""
    sides = events.select(F.explode(F.array_compact(F.array("src_ip", "dst_ip"))).alias("ip"), "hostname", "timestamp", "event_id").filter("ip <> ''")
    return sides.groupBy("ip").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.max(F.when(F.col("hostname").isNotNull(), F.struct("timestamp", "event_id", "hostname"))).alias("named"))


def merge_assets(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("ip").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("named")["hostname"].alias("hostname")) \
                   .withColumn("tag", address_tag(F.col("ip")))


def asset_inventory(events: DataFrame) -> DataFrame:
    """Per address: first and last event time, latest known hostname, internal or external."""
    return merge_assets(asset_mentions(events))


def alert_counts(links: DataFrame, events: DataFrame) -> DataFrame:
    """Detections per source address, each detection once per address, and the capped risk score."""
    pairs = links.join(events.filter("src_ip IS NOT NULL").select("event_id", "src_ip"), "event_id").select("detection_id", F.col("src_ip").alias("ip")).distinct()
    return pairs.groupBy("ip").agg(F.count(F.lit(1)).alias("alert_count")) \
                .withColumn("risk_score", F.least(F.lit(100), F.col("alert_count") * 10).cast("int"))


def list_assets(assets: DataFrame, counts: DataFrame, limit: int = 200) -> DataFrame:
    newest = assets.orderBy(F.col("last_seen").desc(), "ip").limit(limit)
    return newest.join(counts, "ip", "left").na.fill(0, ["alert_count", "risk_score"])


# ---- privacy -----------------------------------------------------------------------------------------------

PIXEL_TYPES = ["image/gif", "image/png", "image/jpeg", "image/webp"]


def tracker_domains(names: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Distinct names (column ``name``) that are on the blocklist or below a listed domain."""
    unique = names.select("name").filter("name IS NOT NULL").distinct()
    candidates = unique.select("name", F.explode(domain_suffixes(F.col("name"))).alias("domain"))
    return candidates.join(blocklist.select("domain"), "domain", "left_semi").select("name").distinct()


def _only_trackers(rows: DataFrame, column: str, blocklist: DataFrame) -> DataFrame:
    trackers = tracker_domains(rows.select(F.col(column).alias("name")), blocklist)
    return rows.join(trackers, F.col(column) == F.col("name"), "left_semi")


def _since_ingest(events: DataFrame, as_of: str | None, lookback: str) -> DataFrame:
    if as_of is None:
        return events
    return events.filter(F.col("ingested_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {lookback}"))


def _privacy_rows(rows: DataFrame, kind: str, label: str, domain: str, explanation: Column) -> DataFrame:
    return rows.select(
        "event_id", "timestamp", F.lit(f"privacy-{kind}").alias("rule_id"), F.lit(f"Privacy: {label}").alias("rule_name"),
        F.lit("medium").alias("severity"), F.col(domain).alias("entity_key"), explanation.alias("explanation"))


def cookie_exfil(events: DataFrame, blocklist: DataFrame, min_body: int = 4096, as_of: str | None = None, lookback: str = "1 HOUR") -> DataFrame:
    rows = _since_ingest(events, as_of, lookback).filter((F.col("event_type") == "http") & (F.col("http_request_body_len") > min_body)) \
        .withColumn("domain", F.lower("domain"))
    return _privacy_rows(_only_trackers(rows, "domain", blocklist), "cookie_exfil", "Cookie Exfiltration", "domain",
                         F.format_string("Large HTTP request body (%d bytes) to known tracker %s", "http_request_body_len", "domain"))


def tracking_pixels(events: DataFrame, blocklist: DataFrame, max_body: int = 200, as_of: str | None = None, lookback: str = "1 HOUR") -> DataFrame:
    mime = F.col("http_resp_mime_type")
    rows = _since_ingest(events, as_of, lookback).filter(
        (F.col("event_type") == "http") & (F.col("http_response_body_len") > 0) & (F.col("http_response_body_len") < max_body)
        & (mime.isNull() | mime.isin(PIXEL_TYPES))).withColumn("domain", F.lower("domain"))
    return _privacy_rows(_only_trackers(rows, "domain", blocklist), "tracking_pixel", "Tracking Pixel", "domain",
                         F.format_string("Tiny %s response (%d bytes) from known tracker %s", F.coalesce(mime, F.lit("unknown")), "http_response_body_len", "domain"))


def dns_trackers(events: DataFrame, blocklist: DataFrame, as_of: str | None = None, lookback: str = "1 HOUR") -> DataFrame:
    """One row per (source, query): its latest event."""
    rows = _since_ingest(events, as_of, lookback).filter(F.col("event_type").isin(DNS_EVENT_TYPES) & F.col("dns_query").isNotNull()) \
        .select("event_id", "timestamp", F.coalesce("src_ip", F.lit("unknown")).alias("src_ip"), F.rtrim(F.lower("dns_query"), F.lit(".")).alias("query"))
    latest = newest_per_key(_only_trackers(rows, "query", blocklist), ["src_ip", "query"], ["timestamp", "event_id"])
    return _privacy_rows(latest, "dns_tracker", "Tracker DNS Query", "query",
                         F.format_string("DNS query for known tracker domain %s from %s", "query", "src_ip"))


def flag_trackers(rows: DataFrame, column: str, blocklist: DataFrame) -> DataFrame:
    trackers = tracker_domains(rows.select(F.lower(column).alias("name")), blocklist).withColumn("_t", F.lit(True))
    return rows.join(trackers, F.lower(column) == F.col("name"), "left").withColumn("is_tracker", F.coalesce("_t", F.lit(False))).drop("name", "_t")


def recent_http_flagged(events: DataFrame, blocklist: DataFrame, limit: int = 200) -> DataFrame:
    return flag_trackers(recent_http(events, limit), "domain", blocklist)


def recent_dns_flagged(events: DataFrame, blocklist: DataFrame, limit: int = 500) -> DataFrame:
    return flag_trackers(recent_dns(events, limit), "dns_query", blocklist)


def tracker_count(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_tracker").alias("tracker_count"))
