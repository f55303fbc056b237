"""Technique coverage, actor matching and test validation."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.functions.scalars import is_technique, parent_technique
from tidewatch.schema import ATTACK_TACTICS, PRIORITY_TECHNIQUES


def attack_matrix(detections: DataFrame, playbook_techniques: DataFrame) -> DataFrame:
    """(tactic, technique, sources, status): detections joined with playbook triggers; detected outranks playbook cover.

    Unknown or missing tactics fall under ``other``; a playbook technique takes the tactic its detections use.
    """
    raw = F.lower(F.trim("attack_tactic"))
    found = detections.filter("attack_technique IS NOT NULL").select(
        F.col("attack_technique").alias("technique"), F.when(raw.isin(ATTACK_TACTICS), raw).otherwise("other").alias("tactic")).distinct()
    home = found.groupBy("technique").agg(F.min("tactic").alias("home"))
    planned = playbook_techniques.filter(F.col("technique").rlike(r"^T\d{4}")).select("technique").distinct() \
        .join(home, "technique", "left").select("technique", F.coalesce("home", F.lit("other")).alias("tactic"))
    both = found.withColumn("d", F.lit("detected")).join(planned.withColumn("p", F.lit("playbook_covered")), ["technique", "tactic"], "full_outer")
    return both.select("tactic", "technique", F.array_compact(F.array("d", "p")).alias("sources"), F.coalesce("d", "p").alias("status"))


def priority_table(spark) -> DataFrame:
    rows = [(tech, name, tactic) for tactic, items in PRIORITY_TECHNIQUES.items() for tech, name in items]
    return spark.createDataFrame(rows, "technique_id string, name string, tactic string")


def technique_counts(events: DataFrame, as_of: str, lookback: str = "30 DAYS") -> DataFrame:
    """Events per technique; comma lists are split after the first aggregation, so the explode sees few rows."""
    end = F.lit(as_of).cast("timestamp")
    grouped = events.filter(F.col("attack_technique").isNotNull() & (F.col("timestamp") >= end - F.expr(f"INTERVAL {lookback}"))) \
        .groupBy("attack_technique").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.explode(F.split(F.upper("attack_technique"), ",")).alias("t"), "n").select(F.trim("t").alias("technique_id"), "n") \
        .filter(is_technique(F.col("technique_id"))).groupBy("technique_id").agg(F.sum("n").alias("detected_count"))


def technique_heatmap(events: DataFrame, playbook_techniques: DataFrame, as_of: str, lookback: str = "30 DAYS") -> DataFrame:
    """Detected, playbooked, both or gap for every priority, detected or playbooked technique."""
    books = playbook_techniques.filter(is_technique(F.col("technique"))).groupBy(F.col("technique").alias("technique_id")) \
        .agg(F.sort_array(F.collect_set("playbook")).alias("playbooks"))
    seen = technique_counts(events, as_of, lookback)
    joined = priority_table(events.sparkSession).withColumn("priority", F.lit(True)) \
        .join(seen, "technique_id", "full_outer").join(books, "technique_id", "full_outer")
    hit, plan = F.coalesce("detected_count", F.lit(0)) > 0, F.coalesce(F.size("playbooks"), F.lit(0)) > 0
    return joined.select(
        "technique_id", F.coalesce("name", "technique_id").alias("name"), F.coalesce("tactic", F.lit("Unknown")).alias("tactic"),
        F.coalesce("priority", F.lit(False)).alias("priority"), F.coalesce("detected_count", F.lit(0)).alias("detected_count"),
        plan.alias("playbooked"), F.coalesce("playbooks", F.array().cast("array<string>")).alias("playbooks"),
        F.when(hit & plan, "detected_and_playbooked").when(hit, "detected").when(plan, "playbooked_only").otherwise("gap").alias("status"))


def coverage_summary(heatmap: DataFrame) -> DataFrame:
    p = heatmap.filter("priority")
    covered = F.count_if(F.col("status") != "gap")
    total = F.count(F.lit(1))
    return p.agg(total.alias("total_priority"), F.count_if(F.col("detected_count") > 0).alias("detected"), F.count_if("playbooked").alias("playbooked"),
                 covered.alias("covered"), F.count_if(F.col("status") == "gap").alias("gaps"),
                 F.coalesce(F.bround(F.try_divide(covered, total) * 100).cast("int"), F.lit(0)).alias("coverage_pct"))


def tactic_coverage(techniques: DataFrame, rule_techniques: DataFrame) -> DataFrame:
    """Techniques with at least one rule, per tactic in matrix order."""
    ruled = rule_techniques.groupBy("tech_id").agg(F.count_distinct("rule_title").alias("n_rules"))
    order = techniques.sparkSession.createDataFrame(list(enumerate(ATTACK_TACTICS)), "position int, tactic string")
    per = techniques.join(ruled, "tech_id", "left").groupBy("tactic").agg(
        F.count(F.lit(1)).alias("total_techniques"), F.count_if(F.col("n_rules") > 0).alias("covered_count"))
    return order.join(per, "tactic", "left").na.fill(0, ["total_techniques", "covered_count"]).select("position", "tactic", "total_techniques", "covered_count")


def recent_technique_ids(detection_techniques: DataFrame, detections: DataFrame, as_of: str, lookback: str = "30 DAYS") -> DataFrame:
    recent = detections.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {lookback}")).select(F.col("id").alias("detection_id"))
    return detection_techniques.join(recent, "detection_id", "left_semi").select("tech_id").distinct()


def actor_matches(groups: DataFrame, group_techniques: DataFrame, tech_ids: DataFrame, top: int = 3) -> DataFrame:
    """Groups whose technique sets overlap most with the observed techniques."""
    seen = tech_ids.select("tech_id").distinct().withColumn("hit", F.lit(1))
    overlap = group_techniques.select("stix_id", "tech_id").distinct().join(seen, "tech_id", "left").groupBy("stix_id").agg(
        F.coalesce(F.sum("hit"), F.lit(0)).alias("matched_count"), F.count(F.lit(1)).alias("total_count"))
    pct = F.col("matched_count") / F.col("total_count")
    return groups.join(overlap, "stix_id").withColumn("overlap_pct", pct).withColumn(
        "confidence", F.when(pct >= 0.60, "High").when(pct >= 0.30, "Medium").otherwise("Low")) \
        .orderBy(F.col("overlap_pct").desc(), "name").limit(top)


def atomics_coverage(atomics: DataFrame, detections: DataFrame, validations: DataFrame) -> DataFrame:
    """validated > detected (also through a sub-technique) > none for every technique with tests."""
    hit = detections.filter("attack_technique IS NOT NULL AND attack_technique <> ''").select("attack_technique").distinct() \
        .select(F.explode(F.array("attack_technique", F.substring_index("attack_technique", ".", 1))).alias("technique_id")).distinct().withColumn("d", F.lit(True))
    passed = validations.filter(F.col("verdict") == "pass").select("technique_id").distinct().withColumn("v", F.lit(True))
    tests = atomics.groupBy("technique_id").agg(F.min("display_name").alias("display_name"), F.count(F.lit(1)).alias("tests"))
    return tests.join(hit, "technique_id", "left").join(passed, "technique_id", "left").select(
        "technique_id", "display_name", "tests", F.when(F.col("v"), "validated").when(F.col("d"), "detected").otherwise("none").alias("coverage"))


def validate_tests(requests: DataFrame, detections: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Latest detection of the technique, its parent or a sibling in the seconds before each request.

    Rows are dealt by technique and time slot, a detection to its own slot and the next; inside a slot the last detection before a
    request is carried along in order of time, so that no request meets detections one by one.
    """
    slot = lambda c: F.floor(F.unix_micros(c) / (window_seconds * 1_000_000))
    asked = requests.select("request_id", F.lit(None).cast("string").alias("detection_id"), F.col("checked_at").alias("_at"), F.lit(1).alias("_asked"),
                            parent_technique(F.col("technique_id")).alias("_parent"), slot("checked_at").alias("_slot"))
    found = detections.filter("attack_technique IS NOT NULL AND created_at IS NOT NULL").select(
        F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), F.col("id").cast("string").alias("detection_id"), F.col("created_at").alias("_at"), F.lit(0).alias("_asked"),
        parent_technique(F.col("attack_technique")).alias("_parent"), F.explode(F.array(slot("created_at"), slot("created_at") + 1)).alias("_slot"))
    order = Window.partitionBy("_parent", "_slot").orderBy("_at", "_asked", "detection_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_asked") == 0, F.struct(F.col("_at").alias("detected_at"), "detection_id")), ignorenulls=True).over(order)
    near = asked.unionByName(found).withColumn("_last", last).filter("_asked = 1").select("request_id", "_at", "_last.*") \
        .filter(F.col("detected_at") > F.col("_at") - F.make_interval(secs=F.lit(window_seconds)))
    latest = near.groupBy("request_id").agg(F.max_by("detection_id", F.struct("detected_at", "detection_id")).alias("detection_id"))
    return requests.join(latest, "request_id", "left").withColumn("verdict", F.when(F.col("detection_id").isNotNull(), "pass").otherwise("fail"))
