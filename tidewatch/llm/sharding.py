"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts form one indivisible group. A partial partition is a set of ``n_shards`` sums. Differencing takes
the two partial partitions with the largest spread and unites them in opposite order, largest sum with smallest, until one is
left. Buckets of groups are differenced in parallel, each to one partial partition; these are differenced again, ``FAN_IN`` at a
time, in rounds until one is left, so no task sees more than a bucket and the driver sees none.
"""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import stored

BUCKET, FAN_IN, SLOT_ROWS = 3_000, 256, 50_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unite the rows of ``sums`` (partial partitions, one column a set).

    Returns the sums of the last partial partition and, per input row and set, the set of the result it went to.
    """
    n, k = sums.shape
    parts = {i: np.asarray(sums[i], dtype=np.int64) for i in range(n)}
    heap = [(-int(p.max() - p.min()), i) for i, p in parts.items()]
    heapq.heapify(heap)
    children: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        left, right = parts.pop(a), parts.pop(b)
        up, down = np.argsort(left, kind="stable"), np.argsort(-right, kind="stable")
        to_left, to_right = np.empty(k, dtype=np.uint16), np.empty(k, dtype=np.uint16)
        to_left[up] = to_right[down] = np.arange(k)
        total = left[up] + right[down]
        made = n + len(children)
        children.append((a, b, to_left, to_right))
        parts[made] = total
        heapq.heappush(heap, (-int(total.max() - total.min()), made))
    last = n + len(children) - 1
    place = {last: np.arange(k, dtype=np.uint16)}
    out = np.tile(np.arange(k, dtype=np.uint16), (n, 1))
    for made in range(last, n - 1, -1):                      # from the result back to what it was made of
        a, b, to_left, to_right = children[made - n]
        where = place.pop(made)
        for child, to in ((a, to_left), (b, to_right)):
            if child < n:
                out[child] = where[to]
            else:
                place[child] = where[to]
    return parts[last], out


def difference_groups(frame: pd.DataFrame, n_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and set of each row for single groups: each begins as a partial partition with all of its bytes in set 0."""
    sums = np.zeros((len(frame), n_shards), dtype=np.int64)
    sums[:, 0] = frame["bytes"]
    total, where = difference(sums)
    return total, where[:, 0]


def group_shards(groups: DataFrame, n_shards: int) -> DataFrame:
    """(digest, shard) from (digest, bytes)."""
    n = groups.count()
    n_buckets = max(1, -(-n // BUCKET))
    bucketed = groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("long"))

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "digest"], ascending=[False, True])
        total, where = difference_groups(frame, n_shards)
        rows = pd.DataFrame({"digest": frame["digest"].array, "bucket": frame["bucket"].iloc[0], "part": where.astype("int32"), "sums": None})
        return pd.concat([rows, pd.DataFrame({"digest": [None], "bucket": [frame["bucket"].iloc[0]], "part": [0], "sums": [total.tolist()]})])

    first = stored(bucketed.groupBy("bucket").applyInPandas(split, "digest string, bucket long, part int, sums array<long>"))
    rows, level = first.filter("sums is null").drop("sums"), first.filter("sums is not null").select("bucket", "sums")

    def unite(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bucket")
        total, where = difference(np.array(frame["sums"].tolist()))
        return pd.DataFrame({"bucket": frame["bucket"].array, "above": frame["above"].array, "moves": [w.tolist() for w in where], "sums": [total.tolist()] + [None] * (len(frame) - 1)})

    while n_buckets > 1:
        united = stored(level.withColumn("above", F.floor(F.col("bucket") / FAN_IN).cast("long")).groupBy("above")
                        .applyInPandas(unite, "bucket long, above long, moves array<int>, sums array<long>"))
        rows = rows.join(united.select("bucket", "above", "moves"), "bucket").select("digest", F.col("above").alias("bucket"), F.element_at("moves", F.col("part") + 1).alias("part"))
        level = united.filter("sums is not null").select(F.col("above").alias("bucket"), "sums")
        n_buckets = -(-n_buckets // FAN_IN)
    return rows.select("digest", F.col("part").alias("shard"))


def shard_by_bytes(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every document in one of ``n_shards`` shards of nearly equal bytes.

    size is the UTF-8 length plus 1 (null texts have no bytes). Documents with equal texts share a shard; null and empty texts
    are one group each. A group of more than its share of all bytes stays whole, the others are balanced around it. slot numbers
    the rows of a shard from 0 by hash chunk and id, whatever rows repeat. text_crc32 is that of the empty text for null.
    Extra columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                              F.coalesce(F.sha2("text", 256), F.lit("null")).alias("digest")))
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    placed = rows.join(group_shards(groups, n_shards), "digest")
    n_chunks = max(1, -(-rows.count() // (n_shards * SLOT_ROWS)))
    placed = stored(placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(n_chunks)).cast("int")))
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    order = Window.partitionBy("shard", "chunk").orderBy("doc_id", "digest")
    numbered = placed.withColumn("inside", F.row_number().over(order)).join(before, ["shard", "chunk"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
