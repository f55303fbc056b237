"""Timelines, investigation expansion and entity profiles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.keyed import with_position
from tidewatch.functions.scalars import describe_event
from tidewatch.operators.hunt import newest_first


def entity_references() -> Column:
    def ref(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(kind + ":"), value))
    return F.array_compact(F.array(
        ref("host", F.lower("hostname")), ref("user", F.lower("username")), ref("process", F.col("process_name")),
        ref("ip", F.col("dst_ip")), ref("domain", F.lower("domain"))))


def _timeline_rows(events: DataFrame, alert_events: DataFrame) -> DataFrame:
    linked = alert_events.select("event_id").distinct().withColumn("_alert", F.lit(True))
    return events.join(linked, "event_id", "left").select(
        "event_id", "timestamp", F.coalesce("source_type", F.lit("unknown")).alias("event_source"), entity_references().alias("entity_references"),
        F.when(F.col("_alert"), 1.0).when(F.col("attack_technique").isNotNull() & (F.col("attack_technique") != ""), 0.8).otherwise(0.5).alias("confidence_score"))


def case_timeline(events: DataFrame, case_id: str, alert_links: DataFrame) -> DataFrame:
    """Events of a case in time order; when the case has none, the events of its linked alerts instead.

    ``alert_links``: (detection_id, event_id) of the case's alerts.
    """
    own = events.filter(F.col("case_id") == case_id)
    if own.isEmpty():
        own = events.join(alert_links.select("event_id").distinct(), "event_id", "left_semi")
    return _timeline_rows(own, alert_links).orderBy("timestamp", "event_id")


def merged_timeline(events: DataFrame, detections: DataFrame, edges: DataFrame, runs: DataFrame) -> DataFrame:
    """Events, detections, edges and playbook runs in one list ordered by (time, item id)."""
    none = F.lit(None).cast("string")
    def t(c, default):
        return F.coalesce(F.col(c), F.lit(default))
    ev = events.select(
        F.concat(F.lit("ev-"), "event_id").alias("item_id"), F.lit("event").alias("item_type"), "timestamp",
        F.concat(t("event_type", "Event"), F.lit(" on "), t("hostname", "unknown"),
                 F.when(F.col("process_name").isNotNull(), F.concat(F.lit(" — "), "process_name")).otherwise("")).alias("title"),
        "severity", "attack_technique", "attack_tactic", F.array_compact(F.array("hostname", "process_name")).alias("entity_labels"))
    nobody = F.array().cast("array<string>")
    det = detections.select(F.concat(F.lit("det-"), "id"), F.lit("detection"), "created_at", t("rule_name", "Detection"),
                            "severity", "attack_technique", "attack_tactic", nobody)
    edge = edges.select(
        F.concat_ws("", F.lit("edge-"), F.substring(F.sha2(F.concat_ws("|", "source_id", "edge_type", "target_id"), 256), 1, 16)), F.lit("edge"), "created_at",
        F.concat("source_id", F.lit(" --["), "edge_type", F.lit("]--> "), "target_id"), none, none, none, F.array("source_id", "target_id"))
    run = runs.select(F.concat(F.lit("pb-"), "run_id"), F.lit("playbook"), "started_at",
                      F.concat(F.lit("Playbook: "), t("playbook_name", "Unknown Playbook"), F.lit(" — "), t("status", "unknown")), none, none, none, nobody)
    return ev.union(det).union(edge).union(run).orderBy("timestamp", "item_id")


def expand_investigation(events: DataFrame, matched: DataFrame, clustered: DataFrame) -> DataFrame:
    """Matched events plus all events of clusters that contain one of them."""
    touched = clustered.join(matched.select("event_id"), "event_id", "left_semi").select("cluster_id").distinct()
    more = clustered.join(touched, "cluster_id", "left_semi").select("event_id")
    wanted = matched.select("event_id").union(more).distinct()
    return events.join(wanted, "event_id", "left_semi")


def attack_chain_steps(investigated: DataFrame) -> DataFrame:
    """Zero-based steps of one investigation in time order, with a sentence each."""
    numbered = with_position(investigated.withColumn("_case", F.lit(1)), ["_case"], "timestamp", "event_id", "step")
    return numbered.select(
        "step", "timestamp", "event_id", "hostname", F.coalesce("process_name", "username", "hostname").alias("entity"),
        F.col("event_type").alias("action"), describe_event(F.col).alias("description"), F.col("attack_technique").alias("technique"), "severity")


def technique_summary(investigated: DataFrame) -> DataFrame:
    return investigated.filter("attack_technique IS NOT NULL").groupBy(F.col("attack_technique").alias("technique_id")).agg(
        F.min_by("attack_tactic", F.struct("timestamp", "event_id")).alias("tactic"), F.count(F.lit(1)).alias("count"))


def investigation_summary(investigated: DataFrame) -> DataFrame:
    return investigated.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("hostname").alias("h"), F.count_distinct("attack_technique").alias("t"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("c")
    ).select(F.format_string(
        "Investigation covers %d events across %d host(s). %d MITRE technique(s) observed. %d high/critical severity events.", "n", "h", "t", "c").alias("summary"))


def entity_profile(events: DataFrame, hostname: str | None = None, username: str | None = None) -> DataFrame:
    scope = events
    if hostname:
        scope = scope.filter(F.col("hostname") == hostname)
    if username:
        scope = scope.filter(F.col("username") == username)
    return scope.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("dst_ip").alias("unique_ips"), F.min("anomaly_score").alias("min_score"),
                     F.max("anomaly_score").alias("max_score"), F.avg("anomaly_score").alias("avg_score"))


def top_processes(events: DataFrame, hostname: str, limit: int = 5) -> DataFrame:
    return events.filter((F.col("hostname") == hostname) & F.col("process_name").isNotNull()).groupBy("process_name") \
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "process_name").limit(limit)


def type_breakdown(events: DataFrame, hostname=None, process_name=None, event_type=None, limit: int = 20) -> DataFrame:
    if hostname:
        events = events.filter(F.col("hostname") == hostname)
    if process_name:
        events = events.filter(F.contains(F.lower("process_name"), F.lit(process_name.lower())))
    if event_type:
        events = events.filter(F.col("event_type") == event_type)
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), "event_type").limit(min(limit, 50))


def recent_detections(detections: DataFrame, as_of: str, hours: int = 24, limit: int = 10) -> DataFrame:
    end = F.lit(as_of).cast("timestamp")
    return newest_first(detections.filter(F.col("created_at") >= end - F.make_interval(hours=F.lit(hours))), limit, 0, "created_at", "id")


def named_neighbours(entities: DataFrame, edges: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Targets of an entity looked up by name, newest edges first."""
    me = entities.filter(F.col("name") == name).select(F.col("id").alias("source_id"))
    hits = edges.select("source_id", "target_id", "edge_type", F.col("created_at").alias("linked_at")).join(me, "source_id", "left_semi")
    return hits.join(entities.select(F.col("id").alias("target_id"), "type", "name"), "target_id") \
        .orderBy(F.col("linked_at").desc(), "target_id", "edge_type").limit(limit).select("type", "name", "edge_type")
