"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of the benchmark: 10 consecutive words of an item, or all words of a shorter item. Per pattern
length the search keeps a shift table over blocks of two words (one for patterns of one word), buckets of patterns by the hash
of their last block, and the words themselves. Many segments of text advance in step: the block that ends at each pointer is
looked up, its shift moves the pointer over positions where no pattern can end, a shift of zero selects a bucket, and each
pattern of the bucket with the same first block is compared word by word.
"""
from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import Words, byte_table, mixed, stored, text_batches

WINDOW = 10
SEGMENT = 256                # words a pointer walks over
BLOCK_BYTES = 32 << 20       # benchmark text that one pattern block holds; more is searched block by block
WORD_BYTES = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)   # after lower-casing
SCHEMA = "doc_id long, text_key long, n_words long, n_hit long, items array<string>, hits array<struct<first:int,last:int>>"
HITS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def blocks_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the block of ``size`` words that ends at each word; the first size - 1 entries have none and are zero."""
    if size == 1:
        return hashes
    out = np.zeros(len(hashes), dtype=np.uint64)
    out[1:] = mixed(hashes[:-1] * np.uint64(3) + hashes[1:])
    return out


class WuManber:
    """Patterns of one length in words."""

    def __init__(self, length: int, patterns: list[tuple[bytes, ...]], hashes: np.ndarray):
        self.length, self.size, self.patterns = length, min(2, length), patterns
        ends = np.stack([blocks_of(row, self.size) for row in hashes])[:, self.size - 1:]   # blocks of each pattern, in order
        places = ends.shape[1]
        block = ends.ravel()
        shift = np.tile(np.arange(places - 1, -1, -1), len(ends))
        order = np.lexsort((shift, block))
        self.blocks, at = np.unique(block[order], return_index=True)
        self.shift = shift[order][at]                       # the smallest over all patterns
        self.default = places                               # a block of no pattern
        self.bits = 1 << max(10, int(len(self.blocks)).bit_length() + 4)
        self.maybe = np.zeros(self.bits, dtype=bool)        # cheap first look before the sorted table
        self.maybe[(self.blocks & np.uint64(self.bits - 1)).astype(np.int64)] = True
        by_last = np.argsort(ends[:, -1], kind="stable")
        self.last, self.first, self.ids = ends[by_last, -1], ends[by_last, 0], by_last

    def shifts(self, block: np.ndarray) -> np.ndarray:
        out = np.full(len(block), self.default, dtype=np.int64)
        some = np.flatnonzero(self.maybe[(block & np.uint64(self.bits - 1)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.blocks, block[some]), len(self.blocks) - 1)
            found = self.blocks[at] == block[some]
            out[some[found]] = self.shift[at[found]]
        return out

    def search(self, words: Words) -> list[tuple[int, int]]:
        """(pattern, first word) of every occurrence inside one text."""
        n, m = len(words.hash), self.length
        if n < m:
            return []
        block = blocks_of(words.hash, self.size)
        pointer = np.arange(m - 1, n, SEGMENT)              # each pointer owns the pattern ends in its segment
        limit = np.minimum(pointer + SEGMENT, n)
        selected = []
        while len(pointer):
            step = self.shifts(block[pointer])
            stop = step == 0
            if stop.any():
                selected.append(pointer[stop])
            pointer = pointer + np.maximum(step, 1)
            alive = pointer < limit
            pointer, limit = pointer[alive], limit[alive]
        if not selected:
            return []
        end = np.concatenate(selected)
        end = end[words.text[end] == words.text[end - m + 1]]
        low = np.searchsorted(self.last, block[end], "left")
        high = np.searchsorted(self.last, block[end], "right")
        out = []
        while len(end):                                     # one pattern of each bucket at a time
            more = low < high
            end, low, high = end[more], low[more], high[more]
            same = self.first[low] == block[end - m + self.size]
            for e, pattern in zip(end[same].tolist(), self.ids[low[same]].tolist()):
                if words.bytes_of(e - m + 1, m) == list(self.patterns[pattern]):
                    out.append((pattern, e - m + 1))
            low = low + 1
        return out


def benchmark_patterns(rows: list[tuple], window: int = WINDOW) -> list[tuple[WuManber, list[list[str]]]]:
    """Per pattern length: the search tables, and for each pattern the items that have it."""
    owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    hashes: dict[tuple[bytes, ...], np.ndarray] = {}
    for item, text in rows:
        words = Words([(text or "").encode("utf-8", "replace")], WORD_BYTES)
        n = len(words.hash)
        parts = words.bytes_of(0, n)
        for at in range(max(1, n - window + 1) if n else 0):
            key = tuple(parts[at:at + window])
            owners[key].add(str(item))
            hashes[key] = words.hash[at:at + window]
    by_length = defaultdict(list)
    for key in sorted(owners):
        by_length[len(key)].append(key)
    return [(WuManber(length, keys, np.stack([hashes[k] for k in keys])), [sorted(owners[k]) for k in keys]) for length, keys in sorted(by_length.items())]


def spans_union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(x) for x in out]


def search_documents(docs: DataFrame, rows: list[tuple], window: int) -> DataFrame:
    """One row a document for one block of benchmark items."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)     # at most BLOCK_BYTES of text; tables are built once a worker
    built: list = []

    def scan(batches):
        if not built:
            built.append(benchmark_patterns(shared.value, window))
        for batch in batches:
            for first, run in text_batches(batch.column("text").to_pylist()):
                words = Words(run, WORD_BYTES)
                spans, items = defaultdict(list), defaultdict(set)
                for tables, owners in built[0]:
                    for pattern, at in tables.search(words):
                        text = int(words.text[at])
                        offset = at - int(words.bounds[text])
                        spans[text].append((offset, offset + tables.length))
                        items[text].update(owners[pattern])
                merged = [spans_union(spans[k]) if k in spans else [] for k in range(len(run))]
                same = batch.slice(first, len(run))
                yield pa.RecordBatch.from_arrays([
                    same.column("doc_id"), same.column("text_key"), pa.array(np.diff(words.bounds), pa.int64()), pa.array([sum(b - a for a, b in x) for x in merged], pa.int64()),
                    pa.array([sorted(items[k]) if k in items else [] for k in range(len(run))], pa.list_(pa.string())),
                    pa.array([[{"first": a, "last": b} for a, b in x] for x in merged], HITS)], ["doc_id", "text_key", "n_words", "n_hit", "items", "hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(scan, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items, hits): words inside any benchmark window, and the items with occurring windows.

    A benchmark of at most BLOCK_BYTES is searched in one pass over the documents without a shuffle. A larger one is cut into
    blocks of that size, one pass each, and the hits of a document (by id and text digest) are united. Null texts have no
    words and are never hit; a null item text gives no window; repeated documents each get their row; an empty benchmark hits
    nothing. Other columns are ignored.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    if size <= BLOCK_BYTES:
        return search_documents(docs, [tuple(r) for r in items.collect()], window)
    n_blocks = size // (BLOCK_BYTES // 2) + 1
    keyed = docs.select("doc_id", "text")
    parts = None
    for k in range(n_blocks):
        rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect()]
        found = search_documents(keyed, rows, window).filter("n_hit > 0").withColumn("block", F.lit(k))
        found = stored(found.distinct())
        parts = found if parts is None else parts.unionByName(found)
    key = ["doc_id", "text_key"]
    spans = parts.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("some_items"), F.flatten(F.collect_list("hits")).alias("some_hits"))

    def unite(batches):
        for batch in batches:
            merged = [spans_union([(h["first"], h["last"]) for h in x]) for x in batch.column("some_hits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), batch.column("some_items"), pa.array([sum(b - a for a, b in x) for x in merged], pa.int64()),
                                              pa.array([[{"first": a, "last": b} for a, b in x] for x in merged], HITS)], ["doc_id", "text_key", "some_items", "some_hit", "some_hits"])

    spans = spans.mapInArrow(unite, "doc_id long, text_key long, some_items array<string>, some_hit long, some_hits array<struct<first:int,last:int>>").alias("s")
    bare = search_documents(keyed, [], window).alias("d")
    return (bare.join(spans, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_key") == F.col("s.text_key")), "left").select(
        "d.doc_id", "d.text_key", "n_words", F.coalesce("some_hit", "n_hit").alias("n_hit"), F.coalesce("some_items", "items").alias("items"), F.coalesce("some_hits", "hits").alias("hits")))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, all columns kept; every row is judged by its own text.

    The search runs inside the scan and nothing is shuffled; for a benchmark over BLOCK_BYTES, the hit rows are found by id and
    text digest and taken out by a null-safe join.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > BLOCK_BYTES:
        hit = decontaminate(docs, benchmark).filter("n_hit > 0").select("doc_id", "text_key").distinct().alias("hit")
        same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("hit.doc_id")) & (F.xxhash64("d.text") == F.col("hit.text_key"))
        return docs.alias("d").join(hit, same, "left_anti")
    rows = [tuple(r) for r in benchmark.select(F.col("item_id").cast("string"), "text").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    built: list = []

    def scan(batches):
        if not built:
            built.append(benchmark_patterns(shared.value))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keep = np.ones(part.num_rows, dtype=bool)
                for first, run in text_batches(part.column("text").to_pylist()):
                    words = Words(run, WORD_BYTES)
                    for tables, _ in built[0]:
                        for _, at in tables.search(words):
                            keep[first + int(words.text[at])] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(scan, docs.schema)
