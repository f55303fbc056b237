"""Periodic jobs on the clock of a stream: triage, KPI snapshots, daily maintenance.

Time is cut into slots of a job's interval. A tick runs every job whose slot is newer than the last one it finished, once however many
slots were missed, and then notes the slot. A replayed tick finds it noted and does nothing; a job that stopped before its note runs
again for the same slot, so jobs write by slot and read only what earlier slots wrote.
"""
from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.scalars import daily_decay
from tidewatch.operators.hunt import triage_batch
from tidewatch.operators.kpi import write_snapshots
from tidewatch.sources.runs import Folder
from tidewatch.sources.sinks import daily_backup, purge_old, stored_table

MINUTE, DAY = 60, 86_400


@dataclass
class Job:
    name: str
    interval: int                                      # seconds
    run: Callable[[int, datetime], None]               # (slot, now)


class Runner:
    def __init__(self, spark: SparkSession, folder: str, jobs: list[Job]):
        self.jobs, self.notes = jobs, Folder(spark, f"{folder}/slots")

    def tick(self, now: datetime) -> list[str]:
        """Runs the jobs that are due at ``now`` (UTC) and returns their names."""
        ran = []
        for job in self.jobs:
            slot = int(now.timestamp()) // job.interval
            if not self.notes.exists(job.name) or int(self.notes.read(job.name)) < slot:
                job.run(slot, now)
                self.notes.write(job.name, str(slot))
                ran.append(job.name)
        return ran


def on_event_time(events: DataFrame, runner: Runner, checkpoint: str, before: Callable[[DataFrame, int], None] | None = None,
                  available_now: bool = True, interval: str = "60 seconds") -> StreamingQuery:
    """Ticks at the newest event time of each micro-batch; ``before`` handles the batch's rows first and must bear a replay."""
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        if before is not None:
            before(batch, batch_id)
        newest = batch.agg(F.unix_micros(F.max("timestamp"))).first()[0]
        if newest is not None:
            runner.tick(datetime.fromtimestamp(newest / 1e6, timezone.utc))

    writer = events.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def _moment(now: datetime):
    return F.timestamp_micros(F.lit(round(now.timestamp() * 1_000_000)))


def triage_job(spark: SparkSession, detections: Callable[[], DataFrame], folder: str, limit: int = 20, interval: int = MINUTE) -> Job:
    """The newest ``limit`` detections up to now that no earlier slot took, with their summary line."""
    def run(slot: int, now: datetime) -> None:
        waiting = detections().filter(F.col("created_at") <= _moment(now))
        done = stored_table(spark, folder)
        if done is not None:
            waiting = waiting.join(done.filter(F.col("slot") < slot).select("id"), "id", "left_anti")
        rows = triage_batch(waiting, limit).select("id", "summary", _moment(now).alias("taken_at"), F.lit(slot).cast("long").alias("slot"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(folder)
    return Job("triage", interval, run)


def snapshot_job(compute: Callable[[datetime], DataFrame], folder: str, interval: int = MINUTE) -> Job:
    """Writes the day's row anew; ``compute`` gives it with ``snapshot_date``."""
    return Job("kpi_snapshot", interval, lambda slot, now: write_snapshots(compute(now), folder))


def daily_job(spark: SparkSession, events: str, backups: str, indicators: str, retention_days: int = 90) -> Job:
    """Indicator confidence one lower, expired events purged, the rest backed up under the day's name.

    Indicators are kept by day of their last decay (``day``), so a repeated run starts from the same earlier version.
    """
    def run(slot: int, now: datetime) -> None:
        day = now.date().isoformat()
        versions = spark.read.parquet(indicators)
        last = versions.filter(F.col("day") < F.lit(day).cast("date")).agg(F.max("day")).first()[0]
        if last is not None:
            versions.filter(F.col("day") == F.lit(last)).withColumn("confidence", daily_decay(F.col("confidence"))).withColumn("day", F.lit(day).cast("date")) \
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(indicators)
        purge_old(spark, events, now.strftime("%Y-%m-%d %H:%M:%S.%f"), retention_days)
        daily_backup(spark.read.parquet(events), backups, day)
    return Job("daily", DAY, run)
