"""Writers: idempotent append, replace, export, bundles, backup, retention, evidence archive."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.keyed import newest_per_key, oldest_per_key, scratch_folder, side_by_side
from tidewatch.operators.hunt import event_filter, newest_first
from tidewatch.operators.graph import induced_edges
from tidewatch.operators.kpi import run_durations
from tidewatch.sources.runs import Folder


# ---- event table -------------------------------------------------------------------------------------

def new_events(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Rows of the batch to insert: first per id, ids already stored under any date left out. ``stored`` is None for a new table.

    Of the stored table only the id column is read. It is first reduced to the ids of the batch, which Spark broadcasts while the
    batch is small, so the table's ids are scanned but not shuffled.
    """
    first = oldest_per_key(batch, ["event_id"], ["ingested_at", "timestamp"])
    if stored is None:
        return first
    known = stored.select("event_id").join(batch.select("event_id").distinct(), "event_id", "left_semi")
    return first.join(known, "event_id", "left_anti").select(*batch.columns)


def stored_table(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table in a folder, or None if no file of it was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path) or not any(s.isDirectory() or s.getPath().getName().endswith(".parquet") for s in files.listStatus(path)):
        return None
    return spark.read.parquet(folder)


def append_events(events: DataFrame, folder: str) -> None:
    """Append by day, rows sorted by time inside files so min/max statistics prune.

    The rebalance hint lets adaptive execution split a hot day over many tasks and keep quiet days in one file.
    """
    events.withColumn("event_date", F.to_date("timestamp")).hint("rebalance", "event_date") \
          .sortWithinPartitions("event_date", "timestamp").write.mode("append").partitionBy("event_date").parquet(folder)


def replace_events(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest version per id wins."""
    versions = stored.withColumn("_v", F.lit(0)).unionByName(incoming.withColumn("_v", F.lit(1)))
    return newest_per_key(versions, ["event_id"], ["_v", "ingested_at"]).drop("_v")


def export_rows(events: DataFrame, limit: int = 100_000, **filters) -> DataFrame:
    return newest_first(event_filter(events, **filters), limit)


def export_events(events: DataFrame, folder: str, fmt: str = "csv", limit: int = 100_000, **filters) -> None:
    rows = export_rows(events, limit, **filters)
    writer = rows.write.mode("overwrite")
    writer.option("header", True).csv(folder) if fmt == "csv" else writer.json(folder)


# ---- cases ----------------------------------------------------------------------------------------------

def case_bundle(cases: DataFrame, events: DataFrame, detections: DataFrame, entities: DataFrame, edges: DataFrame, case_id: str) -> dict[str, DataFrame]:
    nodes = entities.filter(F.col("case_id") == case_id)
    return {"case": cases.filter(F.col("case_id") == case_id), "entities": nodes, "edges": induced_edges(edges, nodes),
            "detections": detections.filter(F.col("case_id") == case_id), "events": events.filter(F.col("case_id") == case_id)}


def bundle_counts(bundle: dict[str, DataFrame]) -> DataFrame:
    return side_by_side(*[frame.agg(F.count(F.lit(1)).alias(f"{name}_count")) for name, frame in bundle.items()])


def write_bundle(bundle: dict[str, DataFrame], folder: str) -> None:
    for name, frame in bundle.items():
        frame.write.mode("overwrite").json(f"{folder}/{name}")


def notebook_events(detections: DataFrame, links: DataFrame, events: DataFrame, case_id: str, limit: int = 50) -> DataFrame:
    """Newest events matched by the detections of a case."""
    mine = detections.filter(F.col("case_id") == case_id).select(F.col("id").alias("detection_id"))
    ids = links.join(mine, "detection_id", "left_semi").select("event_id").distinct()
    return newest_first(events.join(ids, "event_id", "left_semi"), limit)


def notebook_runs(runs: DataFrame, case_id: str) -> DataFrame:
    """Run count and mean duration of a case's finished playbook runs."""
    return run_durations(runs.filter(F.col("case_id") == case_id)).agg(F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("mttr_seconds"))


# ---- maintenance ------------------------------------------------------------------------------------------

def daily_backup(events: DataFrame, folder: str, day: str) -> str:
    target = f"{folder}/events_{day}"
    events.write.mode("overwrite").parquet(target)
    return target


def keep_from(as_of: str, retention_days: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(retention_days))


def keep_recent(events: DataFrame, as_of: str, retention_days: int = 90) -> DataFrame:
    return events.filter(F.col("timestamp") >= keep_from(as_of, retention_days))


def purge_old(spark: SparkSession, folder: str, as_of: str, retention_days: int = 90) -> None:
    """Drop expired day folders; of the day the cut-off falls into the kept rows are written anew.

    Kept rows are staged, a plan of the change is written, and only then files move: new ones in first, old ones out after. A purge
    that stops half way never loses a kept row; the next one finishes it before its own. Files that come into the border day
    meanwhile stay.
    """
    disk = Folder(spark, folder)
    finish_purge(disk)
    cut = keep_from(as_of, retention_days)
    border = str(spark.range(1).select(F.to_date(cut).cast("string")).first()[0])
    days = [n.removeprefix("event_date=") for n in disk.names() if n.startswith("event_date=")]
    plan = {"border": border, "expired": [d for d in days if d < border], "old": [n for n in disk.names(f"event_date={border}") if not n.startswith(("_", "."))]}
    if plan["old"]:
        kept = keep_recent(spark.read.parquet(folder).filter(F.col("event_date") == F.lit(border).cast("date")), as_of, retention_days)
        kept.drop("event_date").write.mode("overwrite").parquet(f"{folder}/_purge/rows")
    disk.write("_purge/plan", json.dumps(plan))
    finish_purge(disk)


def finish_purge(disk: Folder) -> None:
    """Carries out the plan of a purge, from wherever it stopped."""
    if disk.exists("_purge/plan"):
        plan = json.loads(disk.read("_purge/plan"))
        for name in disk.names("_purge/rows"):
            if name.startswith("part-"):
                disk.move(f"_purge/rows/{name}", f"event_date={plan['border']}/{name}")
        for name in plan["old"]:
            disk.delete(f"event_date={plan['border']}/{name}")
        for day in plan["expired"]:
            disk.delete(f"event_date={day}")
        disk.delete("_purge/plan")
    disk.delete("_purge")


def archive_lines(lines: DataFrame, folder: str) -> None:
    """Raw evidence (value, source, received_at) as gzip text per day and source."""
    lines.select("value", "source", F.to_date("received_at").alias("day")).write.mode("append").partitionBy("day", "source") \
         .option("compression", "gzip").text(folder)


def archive_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256, size and path of every archived file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
