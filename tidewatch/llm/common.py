"""Helpers shared by the operators: tables in the shared folder, batches of text as arrays, distributed ranks."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tidewatch.sources.sinks import scratch_folder

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2^64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MAX_BROADCAST_IDS = 1_000_000
BATCH_BYTES = 1 << 19              # text that one array step handles at once, apart from a single longer text
ARROW_ROWS, ARROW_BYTES = 1024, 1 << 22         # of a batch that a task sends to its Python worker


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends batches of at most ARROW_ROWS rows to Python workers, and begins another after ARROW_BYTES. A batch
    stands in the task's buffers, which double as they grow, and again in the worker; Spark's own 10 000 whole texts come to tens of MB each."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def stored(df: DataFrame) -> DataFrame:
    """Write to a fresh folder below spark.checkpoint.dir and read back: cuts lineage and survives lost executors."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def with_ids(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows with a wanted id; ``wanted`` is stored. Up to MAX_BROADCAST_IDS ids (8 MB) are broadcast, so that texts stay where they
    are; more are joined by a shuffle."""
    return docs.join(F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_IDS else wanted, key, "left_semi")


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; a row without id belongs to it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def text_batches(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) in runs of about BATCH_BYTES; null counts as empty."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        if run and size + len(data) > BATCH_BYTES:
            yield first, run
            first, run, size = i, [], 0
        run.append(data)
        size += len(data)
    if run:
        yield first, run


def byte_table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Avalanche step for 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, 0 to n."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, BATCH_BYTES + 65536)
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _POWERS[name] = np.cumprod(step, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Words:
    """Words of a run of texts: offsets in the joined lower-case bytes, the text each belongs to, 64-bit hashes."""

    def __init__(self, run: list[bytes], word_bytes: np.ndarray):
        self.joined = LOWER[np.frombuffer(b" ".join(run) + b" ", dtype=np.uint8)]
        edges = np.flatnonzero(np.diff(word_bytes[self.joined].view(np.int8), prepend=0))
        self.start, self.end = edges[0::2], edges[1::2]
        sizes = np.fromiter((len(x) + 1 for x in run), dtype=np.int64, count=len(run))
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))
        self.bounds = np.searchsorted(self.start, self.text_start)   # words of text i: bounds[i] to bounds[i + 1]
        self.text = np.repeat(np.arange(len(run)), np.diff(self.bounds))
        up, down = powers(len(self.joined))
        total = np.zeros(len(self.joined) + 1, dtype=np.uint64)
        np.cumsum((self.joined.astype(np.uint64) + np.uint64(1)) * up[:len(self.joined)], out=total[1:])
        self.hash = mixed((total[self.end] - total[self.start]) * down[self.start])

    def bytes_of(self, first: int, count: int) -> list[bytes]:
        return [self.joined[self.start[k]:self.end[k]].tobytes() for k in range(first, first + count)]


def sequence_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + words[k:len(words) - n + 1 + k]
    return mixed(out)


def running_total(df: DataFrame, order: list[str], amount: str, name: str, parts: int) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over all rows before this one in ``order``.

    Rows are range-partitioned and stored, so the part of a row is fixed; each part sums its own rows, and the totals of the
    parts (one row a part) are summed on top. Rows that tie in all of ``order`` get arbitrary but distinct places.
    """
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(amount).alias("_sum")).orderBy("_part").collect()   # one row a part
    before, sums = 0, {}
    for row in totals:
        sums[row["_part"]] = before
        before += row["_sum"] or 0
    offsets = df.sparkSession.createDataFrame(sorted(sums.items()) or [(0, 0)], "_part int, _offset long")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(offsets, "_part")
            .withColumn(name, F.col("_offset") + F.col("_inside")).drop("_part", "_inside", "_offset"))
