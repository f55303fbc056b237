"""Operational KPIs, quality metrics and trends."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.keyed import newest_per_key, side_by_side


def _minutes(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 60e6


def _at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def mttd_first(detections: DataFrame, events: DataFrame) -> DataFrame:
    """Minutes from the earliest event to the earliest detection, not below zero."""
    both = side_by_side(detections.agg(F.min("created_at").alias("d")), events.agg(F.min("timestamp").alias("e")))
    return both.select(F.coalesce(F.round(F.greatest(F.lit(0.0), _minutes(F.col("d"), F.col("e"))), 2), F.lit(0.0)).alias("mttd_first"))


def mttd_mean(detections: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Mean over detections of (detection time - its earliest event)."""
    first = links.join(events.select("event_id", "timestamp"), "event_id").groupBy("detection_id").agg(F.min("timestamp").alias("t"))
    gaps = detections.join(first, F.col("id") == F.col("detection_id")).select(F.greatest(F.lit(0.0), _minutes(F.col("created_at"), F.col("t"))).alias("m"))
    return gaps.agg(F.coalesce(F.round(F.avg("m"), 2), F.lit(0.0)).alias("mttd_mean"))


def response_times(cases: DataFrame, as_of: str) -> DataFrame:
    """MTTR over non-active and MTTC over closed cases, minutes from creation to ``as_of``."""
    age = F.greatest(F.lit(0.0), _minutes(_at(as_of), F.col("created_at")))
    return cases.agg(F.coalesce(F.round(F.avg(F.when(F.col("status") != "active", age)), 2), F.lit(0.0)).alias("mttr"),
                     F.coalesce(F.round(F.avg(F.when(F.col("status") == "closed", age)), 2), F.lit(0.0)).alias("mttc"))


def false_positive_rate(detections: DataFrame) -> DataFrame:
    weak = F.count_if((F.col("severity") == "low") & F.col("case_id").isNull())
    return detections.agg(F.coalesce(F.round(F.try_divide(weak, F.count(F.lit(1))), 4), F.lit(0.0)).alias("false_positive_rate"))


def volume_counts(detections: DataFrame, cases: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Alerts of the last day, rules that fired, open cases, assets and log sources: one pass per table."""
    day = F.col("created_at") >= _at(as_of) - F.expr("INTERVAL 24 HOURS")
    return side_by_side(
        detections.agg(F.count_if(day).alias("alert_volume"), F.count_distinct("rule_id").alias("active_rules")),
        cases.agg(F.count_if(F.col("status") == "active").alias("open_cases")),
        events.agg(F.count_distinct("hostname").alias("assets"), F.count_distinct("source_type").alias("log_sources")))


def all_kpis(detections: DataFrame, links: DataFrame, events: DataFrame, cases: DataFrame, as_of: str) -> DataFrame:
    return side_by_side(mttd_first(detections, events), mttd_mean(detections, links, events), response_times(cases, as_of),
                        false_positive_rate(detections), volume_counts(detections, cases, events, as_of))


def model_call_stats(calls: DataFrame) -> DataFrame:
    """Mean latency, calls and error rate per model."""
    bad = F.count_if(~F.col("success"))
    return calls.groupBy("model").agg(F.round(F.avg("latency_ms"), 1).alias("avg_latency"), F.count(F.lit(1)).alias("calls"),
                                      F.round(bad / F.count(F.lit(1)), 4).alias("error_rate"))


SNAPSHOT_METRICS = {"mttd": "mttd_minutes", "mttr": "mttr_minutes", "mttc": "mttc_minutes", "alert_volume": "alert_volume",
                    "false_positives": "false_positive_count", "investigations": "investigation_count", "detections": "detection_count"}


def upsert_snapshots(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Daily rows; a recomputed day replaces the stored one."""
    return newest_per_key(stored.unionByName(computed), ["snapshot_date"], ["computed_at"])


def write_snapshots(computed: DataFrame, folder: str) -> None:
    """Overwrite only the days present in ``computed``."""
    computed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(folder)


def kpi_trends(snapshots: DataFrame, metrics: list[str], as_of: str, days: int = 30) -> DataFrame:
    """(metric, date, value) series of the chosen metrics."""
    unknown = [m for m in metrics if m not in SNAPSHOT_METRICS]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    since = F.date_sub(F.lit(as_of).cast("date"), min(days, 365))
    wide = snapshots.filter(F.col("snapshot_date") >= since).select(
        F.col("snapshot_date").alias("date"), *[F.col(SNAPSHOT_METRICS[m]).cast("double").alias(m) for m in metrics])
    return wide.unpivot("date", metrics, "metric", "value")


def upsert_feedback(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    valid = incoming.filter(F.col("verdict").isin("TP", "FP"))
    return newest_per_key(stored.unionByName(valid), ["detection_id"], ["updated_at"])


def feedback_stats(feedback: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    def rate(v):
        return F.coalesce(F.try_divide(F.count_if(F.col("verdict") == v), n), F.lit(0.0))
    return feedback.agg(n.alias("verdicts_given"), rate("TP").alias("tp_rate"), rate("FP").alias("fp_rate"))


def rule_quality(detections: DataFrame, feedback: DataFrame) -> DataFrame:
    """Hits, last hit, reviews and TP/FP rates per rule."""
    joined = detections.filter("rule_id IS NOT NULL").join(feedback.select(F.col("detection_id").alias("id"), "verdict"), "id", "left")
    reviewed = F.count("verdict")
    def of(v):
        return F.count_if(F.col("verdict") == v)
    def rate(v):
        return F.coalesce(F.round(F.try_divide(of(v), reviewed), 4), F.lit(0.0))
    return joined.groupBy("rule_id", "rule_name").agg(
        F.count(F.lit(1)).alias("total_hits"), F.max("created_at").alias("last_hit"), reviewed.alias("analyst_reviewed"),
        of("TP").alias("confirmed_tp"), of("FP").alias("confirmed_fp"), rate("TP").alias("tp_rate"), rate("FP").alias("fp_rate"))


def quality_summary(detections: DataFrame, feedback: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    def rate(v):
        return F.coalesce(F.round(F.try_divide(F.count_if(F.col("verdict") == v), n), 4), F.lit(0.0))
    judged = feedback.join(detections.filter("rule_id IS NOT NULL").select(F.col("id").alias("detection_id"), "rule_id"), "detection_id")
    return side_by_side(
        detections.agg(F.count(F.lit(1)).alias("total_detections"), F.count_distinct("rule_id").alias("total_rules_fired"),
                       F.count_distinct("attack_technique").alias("technique_count"), F.count_distinct("attack_tactic").alias("tactic_count")),
        feedback.agg(rate("TP").alias("overall_tp_rate"), rate("FP").alias("overall_fp_rate"), F.count_distinct("detection_id").alias("analyst_reviewed")),
        judged.agg(F.count_distinct("rule_id").alias("rules_with_feedback")))


# ---- playbook durations ------------------------------------------------------------------------------

def run_durations(runs: DataFrame) -> DataFrame:
    """Seconds of finished runs; negative durations are dropped."""
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    return runs.filter(F.col("status").isin("completed", "failed")).select(
        "run_id", "playbook_id", "playbook_name", "case_id", seconds.alias("seconds")).filter("seconds >= 0")


def playbook_mttr(runs: DataFrame) -> DataFrame:
    return run_durations(runs).groupBy("playbook_id", "playbook_name").agg(F.avg("seconds").alias("mttr_seconds"), F.count(F.lit(1)).alias("sample_size"))


def nearest_rank(values: DataFrame, key: str, percents: list[float], groups: list[str] = (), bits: int = 16) -> DataFrame:
    """(groups, percent, value): exact nearest-rank percentiles (index = half-even round of p(n-1)) of a 64-bit integer column.

    Digits of ``bits`` are fixed from the top, all groups and percentiles in one scan a digit, so a scan count of 64 / bits
    whatever is asked. A scan counts rows per digit below the prefixes chosen so far: at most 2^bits rows a prefix, added up before
    the shuffle; no task sorts or holds values. Null keys are left out, a null group is a group, one without values has no row.
    """
    rows = values.filter(F.col(key).isNotNull()).select(F.struct(*(groups or [F.lit(0).alias("all")])).alias("_g"), F.col(key).cast("bigint").alias("_k"))
    order = Window.partitionBy("_g", "_above").orderBy("_p")
    chosen = None
    for shift in range(64 - bits, -1, -bits):
        digit = F.shiftright("_k", shift).alias("_p")      # arithmetic shifts keep the order of signed numbers
        if chosen is None:
            counts = rows.groupBy("_g", F.lit(0).alias("_above"), digit).agg(F.count(F.lit(1)).alias("_c"))
            n = F.sum("_c").over(Window.partitionBy("_g"))
            asks = F.array(*[F.struct(F.lit(float(p)).alias("percent"), F.bround(F.lit(p / 100.0) * (n - 1), 0).cast("bigint").alias("rank")) for p in percents])
            counts = counts.withColumn("_asks", asks)
        else:
            above = rows.withColumn("_above", F.shiftright("_k", shift + bits))
            counts = above.join(chosen, ["_g", "_above"]).groupBy("_g", "_above", digit).agg(F.count(F.lit(1)).alias("_c"), F.any_value("_asks").alias("_asks"))
        placed = counts.withColumn("_upto", F.sum("_c").over(order)).select("_g", "_p", "_upto", "_c", F.explode("_asks").alias("_a"))
        before = F.col("_upto") - F.col("_c")
        hit = placed.filter((F.col("_a.rank") >= before) & (F.col("_a.rank") < F.col("_upto")))
        chosen = hit.groupBy("_g", F.col("_p").alias("_above")).agg(
            F.collect_list(F.struct(F.col("_a.percent").alias("percent"), (F.col("_a.rank") - before).alias("rank"))).alias("_asks"))
    return chosen.select(*[F.col("_g")[g].alias(g) for g in groups], F.explode("_asks").alias("_a"), F.col("_above").alias("value")) \
        .select(*groups, F.col("_a.percent").alias("percent"), "value")


def _percentile_columns(runs: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, p50_seconds, p95_seconds) of finished runs, exact to the microsecond."""
    micros = run_durations(runs).withColumn("_micros", F.round(F.col("seconds") * 1e6).cast("bigint"))
    def at(p):
        return (F.max(F.when(F.col("percent") == p, F.col("value"))) / 1e6).alias(f"p{p}_seconds")
    return nearest_rank(micros, "_micros", [50, 95], groups).groupBy(*groups).agg(at(50), at(95))


def playbook_percentiles(runs: DataFrame) -> DataFrame:
    """Nearest-rank p50 and p95 of the durations of every playbook."""
    return _percentile_columns(runs, ["playbook_id"])


def playbook_overall(runs: DataFrame) -> DataFrame:
    """Mean, p50, p95 and number of finished runs in one row; without any, no mean and zeros."""
    return side_by_side(run_durations(runs).agg(F.avg("seconds").alias("mttr_seconds"), F.count(F.lit(1)).alias("sample_size")),
                        _percentile_columns(runs, [])).na.fill(0.0, ["p50_seconds", "p95_seconds"])
