"""Log-structured tables of micro-batch jobs: one run a batch, merged into larger runs as they pile up.

A run is the Parquet folder ``run=<level>-<first>-<last>`` of a range of batches, cut by a hash bucket of its key. Only runs that
Spark has marked as whole are read, and of a run inside a larger one only the larger; so a crash between writing a merged run and
deleting its parts changes nothing. A batch that is replayed writes its own run anew. Merging is done before a batch, over batches
before it, whose runs are final: each row is rewritten once a level, so a batch costs the same however many there were.
"""
from __future__ import annotations

import re
from typing import Callable, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidewatch.functions import bloom
from tidewatch.functions.keyed import cut_lineage

_NAME = re.compile(r"run=(\d)-(\d{12})-(\d{12})")
PARTITIONS = [StructField("run", StringType()), StructField("bucket", IntegerType())]


class Run(NamedTuple):
    level: int
    first: int
    last: int

    @property
    def name(self) -> str:
        return f"{self.level}-{self.first:012d}-{self.last:012d}"


class Folder:
    """The few file operations that a run table needs, on any file system Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.root = self.path("")
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str = "") -> list[str]:
        at = self.path(name)
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.files.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), True)

    def move(self, name: str, to: str) -> None:
        self.files.mkdirs(self.path(to).getParent())
        self.files.rename(self.path(name), self.path(to))

    def write(self, name: str, text: str) -> None:
        """A small file, there whole or not at all."""
        out = self.files.create(self.path(f"{name}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.files.delete(self.path(name), False)
        self.files.rename(self.path(f"{name}.new"), self.path(name))

    def read(self, name: str) -> str:
        return "".join(r[0] for r in self.spark.read.text(f"{self.folder}/{name}").collect())        # one short line


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int") if keys else F.lit(0)


class RunTable:
    """Rows of all batches below ``keys``' buckets. ``merge`` turns rows of several runs, with the last batch of each as ``_version``,
    into those of one; it must give the same whatever runs are merged first."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], schema: StructType | None = None, buckets: int = 16, fan_in: int = 8):
        self.spark, self.folder, self.keys, self.merge, self.schema, self.buckets, self.fan_in = spark, folder, keys, merge, schema, buckets, fan_in
        self.disk = Folder(spark, folder)

    def runs(self, before: int | None = None) -> list[Run]:
        found = [Run(*map(int, m.groups())) for n in self.disk.names() if (m := _NAME.fullmatch(n)) and self.disk.exists(f"{n}/_SUCCESS")]
        found = [r for r in found if before is None or r.last < before]
        return sorted((r for r in found if not any(o.level > r.level and o.first <= r.first and r.last <= o.last for o in found)), key=lambda r: r.first)

    def read_runs(self, runs: list[Run]) -> DataFrame:
        reader = self.spark.read.option("basePath", self.folder)
        if self.schema is not None:
            reader = reader.schema(StructType([*self.schema.fields, *PARTITIONS]))
        rows = reader.parquet(*[f"{self.folder}/run={r.name}" for r in runs])
        return rows.withColumn("_version", F.substring(F.col("run").cast("string"), 16, 12).cast("long"))

    def rows(self, before: int | None = None, touched: DataFrame | None = None) -> DataFrame | None:
        """Merged rows of all runs below ``before``, None if there are none. With ``touched`` (rows of key values) only the buckets
        that they fall into are opened, and only their rows come back."""
        runs = self.runs(before)
        if not runs:
            return None
        rows = self.read_runs(runs)
        if touched is not None:
            opened = [r[0] for r in touched.select(bucket_of(self.keys, self.buckets).alias("b")).distinct().collect()]          # at most ``buckets`` rows
            same = touched.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
            rows = rows.filter(F.col("bucket").isin(opened)).join(same, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys], "left_semi")
        return self.merge(rows.drop("run", "bucket"))

    def write(self, batch: int, rows: DataFrame, run: Run | None = None) -> None:
        placed = rows.withColumn("bucket", bucket_of(self.keys, self.buckets)).hint("rebalance", "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/run={(run or Run(0, batch, batch)).name}")

    def compact(self, before: int) -> None:
        """Merges ``fan_in`` runs of one level that follow one another, until no level has so many."""
        while True:
            runs = self.runs(before)
            full = next((some for level in range(9) if len(some := [r for r in runs if r.level == level]) >= self.fan_in), None)
            if full is None:
                break
            some = full[:self.fan_in]
            merged = Run(some[0].level + 1, some[0].first, some[-1].last)
            self.write_merged(merged, some)
            for run in some:
                self.disk.delete(f"run={run.name}")
        for run in self.leftovers():
            self.disk.delete(f"run={run.name}")

    def write_merged(self, merged: Run, parts: list[Run]) -> None:
        self.write(0, self.merge(self.read_runs(parts).drop("run", "bucket")), merged)

    def leftovers(self) -> list[Run]:
        """Runs inside a larger whole one that a crash left behind."""
        live = set(self.runs())
        return [r for n in self.disk.names() if (m := _NAME.fullmatch(n)) and self.disk.exists(f"{n}/_SUCCESS") and (r := Run(*map(int, m.groups()))) not in live]


# ---- merges ------------------------------------------------------------------------------------------

def newest_version(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """All rows that the last batch wrote for a key."""
    def merge(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*keys).agg(F.max("_version").alias("_last")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_last")
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return rows.join(last, [*same, F.col("_version") == F.col("_last")], "left_semi").drop("_version")
    return merge


def added_up(keys: list[str], total: list[str], least: list[str] = (), most: list[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """Sums, minima and maxima by key."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in total], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])
    return merge


# ---- ids ---------------------------------------------------------------------------------------------

class IdIndex:
    """The ids that a table holds, whatever their day, with which a batch finds its known ids without a look at the table.

    Ids are kept in runs, a run in up to MAX_PARTS parts by hash. Beside each run stand Bloom filters, one for each of GRANULES ranges of the
    hash that it has ids of. Ids of a batch are dealt by granule to its filters (two bytes an id of the index are read); only parts for
    which a filter says "maybe" are opened, and there an equi-join decides.

    Batches are numbered over all queries that ever wrote: ``number`` gives the number of a query's batch. ``begin`` and ``finish``
    bracket the write of a batch, so a replay knows whether the rows are stored, may be, or are not.
    """

    GRANULES, PART_IDS, MAX_PARTS = 1024, 1 << 20, 256

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = 8):
        self.spark, self.disk = spark, Folder(spark, folder)
        self.ids = _IdRuns(spark, f"{folder}/ids", fan_in)

    def number(self, query_id: str, batch_id: int) -> int:
        """Number of a batch: a query seen for the first time counts on from the last run."""
        if not self.disk.exists(f"origins/{query_id}"):
            runs = self.ids.runs()
            self.disk.write(f"origins/{query_id}", str(runs[-1].last + 1 if runs else 0))
        return int(self.disk.read(f"origins/{query_id}")) + batch_id

    def cover(self, table: DataFrame | None) -> None:
        """Enters a table that was written without an index, once."""
        if table is not None and not self.ids.runs():
            self.ids.record(0, table.select("event_id").distinct())
            self.finish(0)

    def known(self, ids: DataFrame, before: int | None = None) -> DataFrame:
        """(event_id) of those that runs below ``before`` hold."""
        places = self.ids.candidates(ids.select("event_id").distinct(), before)
        return self.ids.confirmed(places)

    def status(self, number: int) -> str:
        """``new``, ``begun`` (its rows may be stored) or ``done``."""
        if self.disk.exists(f"done/{number:012d}") or any(r.first <= number <= r.last and r.level for r in self.ids.runs()):
            return "done"
        return "begun" if self.ids.disk.exists(f"run={Run(0, number, number).name}/_SUCCESS") else "new"

    def begin(self, number: int, ids: DataFrame) -> None:
        """Writes the run of a batch, before its rows are stored."""
        self.ids.record(number, ids)

    def finish(self, number: int) -> None:
        self.disk.write(f"done/{number:012d}", "")
        for name in self.disk.names("done"):
            if name.isdigit() and int(name) < number:
                self.disk.delete(f"done/{name}")

    def compact(self, before: int) -> None:
        self.ids.compact(before)


class _IdRuns(RunTable):
    FILTERS = "run string, granule int, parts int, bits binary"

    def __init__(self, spark: SparkSession, folder: str, fan_in: int):
        super().__init__(spark, folder, ["event_id"], lambda rows: rows.drop("_version"), StructType([StructField("event_id", StringType())]), 1, fan_in)

    def filters(self, name: str) -> str:
        return f"{self.folder}/filters/run={name}"

    def record(self, number: int, ids: DataFrame, run: Run | None = None) -> None:
        name = (run or Run(0, number, number)).name
        ids = ids.select("event_id")
        need = -(-ids.count() // IdIndex.PART_IDS)
        parts = 1 << min(max(0, need - 1).bit_length(), IdIndex.MAX_PARTS.bit_length() - 1)
        hashed = ids.select("event_id", F.xxhash64("event_id").alias("h")).withColumn("granule", _granule(F.col("h")))

        def build(batches):
            granule, held = None, []

            def emit():
                return pa.RecordBatch.from_arrays([pa.array([granule], pa.int32()), pa.array([parts], pa.int32()), pa.array([bloom.build(np.concatenate(held))], pa.binary())], ["granule", "parts", "bits"])
            for batch in batches:
                granules, h = batch.column("granule").to_numpy(), batch.column("h").to_numpy()
                for g in np.unique(granules).tolist():
                    if held and g != granule:
                        yield emit()
                        held = []
                    granule = g
                    held.append(h[granules == g])
            if held:
                yield emit()

        # Filters first: a whole run of ids has all of its filters.
        made = hashed.select("granule", "h").repartition("granule").sortWithinPartitions("granule").mapInArrow(build, "granule int, parts int, bits binary")
        made.write.mode("overwrite").parquet(self.filters(name))
        hashed.select("event_id", F.floor(F.col("granule") * parts / IdIndex.GRANULES).cast("int").alias("bucket")).hint("rebalance", "bucket") \
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/run={name}")

    def write_merged(self, merged: Run, parts: list[Run]) -> None:
        self.record(0, self.read_runs(parts), merged)

    def compact(self, before: int) -> None:
        super().compact(before)
        live = {f"run={r.name}" for r in self.runs()}
        for name in self.disk.names("filters"):
            if name not in live and (m := _NAME.fullmatch(name)) and int(m[3]) < before:
                self.disk.delete(f"filters/{name}")

    def candidates(self, ids: DataFrame, before: int | None = None) -> DataFrame | None:
        """(event_id, run, bucket): where an id may be, by the filters; None without runs. Computed once and kept."""
        runs = self.runs(before)
        if not runs:
            return None
        filters = self.spark.read.option("basePath", f"{self.folder}/filters").schema(self.FILTERS).parquet(*[self.filters(r.name) for r in runs])
        asked = ids.select("event_id", F.xxhash64("event_id").alias("h")).withColumn("granule", _granule(F.col("h")))
        both = filters.select("granule", F.lit(0).alias("kind"), "run", "parts", "bits", F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("long").alias("h")).unionByName(
            asked.select("granule", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("run"), F.lit(None).cast("int").alias("parts"), F.lit(None).cast("binary").alias("bits"), "event_id", "h"))
        parts_in = IdIndex.GRANULES

        def probe(batches):
            granule, held = None, []
            for batch in batches:
                granules, kinds = batch.column("granule").to_numpy(), batch.column("kind").to_numpy()
                for g in np.unique(granules).tolist():
                    if g != granule:
                        granule, held = g, []
                    mine = granules == g
                    tables = batch.filter(pa.array(mine & (kinds == 0)))
                    held += list(zip(*(tables.column(c).to_pylist() for c in ("run", "parts", "bits"))))
                    asked = batch.filter(pa.array(mine & (kinds == 1)))
                    h = asked.column("h").to_numpy()
                    for run, parts, bits in held:
                        at = np.flatnonzero(bloom.holds(bits, h)) if len(h) else h
                        if len(at):
                            yield pa.RecordBatch.from_arrays([asked.column("event_id").take(pa.array(at)), pa.array([run] * len(at)), pa.array([g * parts // parts_in] * len(at), pa.int32())], ["event_id", "run", "bucket"])

        return cut_lineage(both.repartition("granule").sortWithinPartitions("granule", "kind").mapInArrow(probe, "event_id string, run string, bucket int"))

    def confirmed(self, places: DataFrame | None) -> DataFrame:
        """The ids that are where they may be; only those parts are opened."""
        opened = [] if places is None else [f"{self.folder}/run={r['run']}/bucket={r['bucket']}" for r in places.select("run", "bucket").distinct().collect()]     # one row a part
        if not opened:
            return self.spark.createDataFrame([], "event_id string")
        return self.spark.read.schema("event_id string").parquet(*opened).join(places.select("event_id").distinct(), "event_id", "left_semi").select("event_id").distinct()


def _granule(h: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(IdIndex.GRANULES)).cast("int")
