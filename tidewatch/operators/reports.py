"""Report data: telemetry, executive, session log, bulletin, compliance, case records, provenance."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.keyed import side_by_side
from tidewatch.functions.scalars import is_private_ip
from tidewatch.operators.hunt import newest_first


def _within(ts: str, start: str, end: str) -> Column:
    return (F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) <= F.lit(end).cast("timestamp"))


def _last_day(ts: str, as_of: str) -> Column:
    return F.col(ts) > F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 DAY")


def _top(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), *keys)
    return counted.limit(limit) if limit else counted


def telemetry_types(events: DataFrame, as_of: str) -> DataFrame:
    return _top(events.filter(_last_day("timestamp", as_of)).withColumn("event_type", F.coalesce("event_type", F.lit("unknown"))), ["event_type"])


def telemetry_totals(events: DataFrame, detections: DataFrame, assets: DataFrame, as_of: str) -> DataFrame:
    day = events.filter(_last_day("timestamp", as_of))
    return side_by_side(day.agg(F.count(F.lit(1)).alias("total_events"), F.count_if("ioc_matched").alias("ioc_matches")),
                        detections.agg(F.count_if(_last_day("created_at", as_of)).alias("total_detections")),
                        assets.agg(F.count(F.lit(1)).alias("assets_count")))


def telemetry_top_rules(detections: DataFrame, as_of: str, limit: int = 5) -> DataFrame:
    return _top(detections.filter(_last_day("created_at", as_of)), ["rule_name", "severity"], limit)


def executive_breakdown(events: DataFrame, start: str, end: str, top: int = 10) -> DataFrame:
    """(section, key, cnt): severities, busiest hosts, event types and external sources of a period."""
    period = events.filter(_within("timestamp", start, end))
    parts = {
        "severity": _top(period.withColumn("severity", F.coalesce("severity", F.lit("unknown"))), ["severity"]),
        "hostname": _top(period.filter("hostname IS NOT NULL"), ["hostname"], top),
        "event_type": _top(period.filter("event_type IS NOT NULL"), ["event_type"], top),
        "src_ip": _top(period.filter(F.col("src_ip").isNotNull() & ~is_private_ip(F.col("src_ip"))), ["src_ip"], top),
    }
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("section"), F.col(name).alias("key"), "cnt")
        out = rows if out is None else out.union(rows)
    return out


def executive_totals(events: DataFrame, detections: DataFrame, cases: DataFrame, start: str, end: str) -> DataFrame:
    return side_by_side(events.agg(F.count_if(_within("timestamp", start, end)).alias("total_events")),
                        detections.agg(F.count_if(_within("created_at", start, end)).alias("detection_count")),
                        cases.agg(F.count_if(_within("created_at", start, end)).alias("investigation_count")))


def session_log(events: DataFrame, as_of: str) -> DataFrame:
    """(section, key, cnt) of the last day: top 20 event types and all sources."""
    start = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    day = events.filter((F.col("timestamp") >= start) & (F.col("timestamp") <= F.lit(as_of).cast("timestamp")))
    types = _top(day.filter("event_type IS NOT NULL"), ["event_type"], 20).select(F.lit("event_type").alias("section"), F.col("event_type").alias("key"), "cnt")
    return types.union(_top(day.filter("source_type IS NOT NULL"), ["source_type"]).select(F.lit("source_type"), "source_type", "cnt"))


# ---- threat bulletin ---------------------------------------------------------------------------------

def bulletin_actor(groups: DataFrame, name: str) -> DataFrame:
    """The group with exactly this name, else the first whose name starts with it."""
    exact = F.col("name") == name
    near = groups.filter(exact | F.lower("name").startswith(name.lower()))
    return near.orderBy(exact.desc(), "name").limit(1)


def bulletin_techniques(actor: DataFrame, group_techniques: DataFrame, techniques: DataFrame) -> DataFrame:
    mine = group_techniques.join(actor.select("stix_id"), "stix_id", "left_semi").select("tech_id").distinct()
    return techniques.join(mine, "tech_id", "left_semi").select("tech_id", "name", "tactic")


def bulletin_iocs(iocs: DataFrame, name: str, limit: int = 100) -> DataFrame:
    return iocs.filter(F.lower("actor_tag").startswith(name.lower()) & (F.col("ioc_status") == "active")) \
        .orderBy(F.col("confidence").desc(), "ioc_value", "ioc_type").limit(limit)


def bulletin_assets(assets: DataFrame, limit: int = 20) -> DataFrame:
    return assets.orderBy(F.col("risk_score").desc(), "ip").limit(limit)


# ---- compliance -----------------------------------------------------------------------------------------

def csf_evidence(detections: DataFrame, cases: DataFrame, runs: DataFrame, snapshots: DataFrame) -> dict[str, DataFrame]:
    """Evidence sets of the six framework functions."""
    done = runs.filter(F.col("status") == "completed")
    return {
        "GOVERN": snapshots.orderBy(F.col("snapshot_date").desc()).limit(90), "IDENTIFY": detections, "PROTECT": done, "DETECT": detections,
        "RESPOND": cases, "RECOVER": cases.filter(F.col("status").isin("resolved", "closed")),
    }


def csf_counts(evidence: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, frame in evidence.items():
        row = frame.agg(F.lit(name).alias("csf_function"), F.count(F.lit(1)).alias("items"))
        out = row if out is None else out.union(row)
    return out


def write_evidence(evidence: dict[str, DataFrame], folder: str) -> None:
    for name, frame in evidence.items():
        frame.write.mode("overwrite").json(f"{folder}/{name}")


CASE_SEVERITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def case_payloads(detections: DataFrame) -> DataFrame:
    """(id, payload, observables): one external case record per detection as JSON."""
    level = F.lower(F.coalesce("severity", F.lit("medium")))
    def t(c, default="N/A"):
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))
    number = F.when(level == "low", 1).when(level == "high", 3).when(level == "critical", 4).otherwise(2)
    rule = F.coalesce("rule_name", F.lit("Unknown Rule"))
    text = F.concat(F.lit("**Rule:** "), rule, F.lit("\n**Detection ID:** "), "id", F.lit("\n**ATT&CK:** "), t("attack_technique"),
                    F.lit(" — "), t("attack_tactic"), F.lit("\n**Source:** auto-case"))
    payload = F.struct(
        F.concat(F.lit("["), F.upper(level), F.lit("] "), rule, F.lit(" — "), t("src_ip")).alias("title"), text.alias("description"),
        number.alias("severity"), F.filter(F.array_compact(F.array("attack_technique", "attack_tactic")), lambda x: x != "").alias("tags"),
        F.lit(2).alias("tlp"), F.lit(2).alias("pap"), F.lit("New").alias("status"))

    def seen(kind, column, message, ioc=False):
        return F.struct(F.lit(kind).alias("dataType"), F.nullif(F.col(column), F.lit("")).alias("data"), F.lit(ioc).alias("ioc"), F.lit(message).alias("message"))
    observables = F.filter(F.array(
        seen("ip", "src_ip", "Source IP from detection"), seen("other", "rule_name", "Rule name"),
        seen("other", "attack_technique", "ATT&CK technique"), seen("other", "ioc_actor_tag", "Actor tag", True)), lambda o: o["data"].isNotNull())
    return detections.select("id", payload.alias("payload"), observables.alias("observables")) \
        .select("id", F.to_json("payload").alias("payload"), F.to_json("observables").alias("observables"), F.size("observables").alias("n_observables"))


def sync_closures(detections: DataFrame, resolved: DataFrame) -> DataFrame:
    """External resolution written onto detections; ``resolved``: (external_case_id, resolution, assignee, end_ms)."""
    r = resolved.filter("external_case_id IS NOT NULL AND external_case_id <> ''").select(
        "external_case_id", F.coalesce("resolution", F.lit("Indeterminate")).alias("_status"), F.timestamp_millis("end_ms").alias("_closed"), F.col("assignee").alias("_who"))
    return detections.join(r, "external_case_id", "left").withColumns({
        "external_status": F.coalesce("_status", "external_status"), "external_closed_at": F.coalesce("_closed", "external_closed_at"),
        "external_analyst": F.coalesce("_who", "external_analyst")}).drop("_status", "_closed", "_who")


# ---- provenance -------------------------------------------------------------------------------------------

def ingest_provenance(files: DataFrame, junction: DataFrame, event_ids: DataFrame) -> DataFrame:
    """Which ingest file each event came from: ``files`` (prov_id, source_file, ...) via ``junction`` (prov_id, event_id)."""
    return event_ids.join(junction, "event_id").join(files, "prov_id")


def provenance_list(kinds: dict[str, DataFrame], limit: int = 50) -> DataFrame:
    """Newest records over all provenance kinds; each frame has (record_id, label, created_at)."""
    out = None
    for kind, frame in kinds.items():
        rows = newest_first(frame.select("record_id", "label", "created_at"), limit, 0, "created_at", "record_id").withColumn("record_type", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.col("created_at").desc(), "record_type", F.col("record_id").desc()).limit(limit)


def incident_techniques(detections: DataFrame, case_id: str, detection_techniques: DataFrame, techniques: DataFrame) -> DataFrame:
    mine = detections.filter(F.col("case_id") == case_id).select(F.col("id").alias("detection_id"))
    ids = detection_techniques.join(mine, "detection_id", "left_semi").select("tech_id").distinct()
    return techniques.join(ids, "tech_id", "left_semi")


def incident_detections(detections: DataFrame, case_id: str, limit: int = 50) -> DataFrame:
    return newest_first(detections.filter(F.col("case_id") == case_id), limit, 0, "created_at", "id")


def incident_hits(hits: DataFrame, limit: int = 30) -> DataFrame:
    return newest_first(hits, limit, 0, "event_timestamp", "event_id")


def incident_runs(runs: DataFrame, case_id: str) -> DataFrame:
    return runs.filter(F.col("case_id") == case_id).orderBy(F.col("started_at").desc(), "run_id")
