"""Per-key sequence helpers that never put one key's whole history into one task.

A plain ``Window.partitionBy(key).orderBy(ts)`` sends every row of a key to one task.
These helpers split each key by time chunk, work inside the chunk, and stitch chunks with
a small per-(key, chunk) summary, so a key that holds a third of all rows is spread over
as many tasks as it has chunks.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _chunk(ts: str, chunk: str) -> Column:
    return F.date_trunc(chunk, F.col(ts))


def _summary(per_chunk: DataFrame, keys: list[str], value: str) -> DataFrame:
    return per_chunk.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
                            F.col("_chunk").alias("_at"), value)


def _same_chunk(keys: list[str]) -> Column:
    cond = F.col("_chunk") == F.col("_at")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return cond


def with_previous(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column,
                  out: str, chunk: str = "hour") -> DataFrame:
    """``lag(value)`` per key in (ts, tie) order, exact across chunk borders."""
    chunked = df.withColumn("_chunk", _chunk(ts, chunk)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(ts, tie)
    lagged = chunked.withColumn("_prev", F.lag("_value").over(inside)) \
                    .withColumn("_first", F.row_number().over(inside) == 1)
    last = chunked.groupBy(*keys, "_chunk").agg(
        F.max_by("_value", F.struct(ts, tie)).alias("_last"))
    border = _summary(last.withColumn(
        "_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))), keys, "_carry")
    return lagged.join(border, _same_chunk(keys), "left").select(
        *df.columns, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")).alias(out))


def with_position(df: DataFrame, keys: list[str], ts: str, tie: str,
                  out: str, chunk: str = "hour") -> DataFrame:
    """Zero-based ``row_number`` per key in (ts, tie) order from chunk counts plus an in-chunk rank."""
    chunked = df.withColumn("_chunk", _chunk(ts, chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(ts, tie)
    ranked = chunked.withColumn("_rank", F.row_number().over(inside))
    counts = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = _summary(counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))), keys, "_base")
    return ranked.join(base, _same_chunk(keys), "left").select(
        *df.columns, (F.col("_base") + F.col("_rank") - 1).alias(out))


def newest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key as a ``max_by`` aggregate: combined map-side, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def oldest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key, same shape as :func:`newest_per_key`."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Columns of several one-row aggregates in one row: a union and a final aggregate, no cross join."""
    names = [c for frame in one_row for c in frame.columns]
    stacked = one_row[0]
    for frame in one_row[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one the cluster names; machine-local only for a local master with none set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        return tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written as a table in the folder the cluster names and read back: survives executor loss, and unlike a reliable checkpoint
    the rows are computed once."""
    folder = f"{scratch_folder(df.sparkSession)}/rows"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
