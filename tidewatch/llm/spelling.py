"""Spelling variant grouping by Bloom-guided neighbourhoods.

The vocabulary is counted in full. Its words are put into blocked Bloom filters, sharded by word length (a large length into hash
parts); filters are broadcast, at most FILTER_BYTES at once, in as many rounds as that takes. Every word generates its deletions
and its replacements by a later letter, as hashes alone; insertions and the other replacements are the same pairs seen from the
other side. Only edits that a filter knows become strings and are shuffled to an exact join with the vocabulary, which removes the
false positives. Words are held as Latin-1, one byte a code point: no other letters take part.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import BASE_INVERSE, LOWER, mixed, powers, stored

MIN_LENGTH, MIN_COUNT, RATIO, TYPO_RATE = 6, 5, 5, 199
CHUNK, COUNTED_WORDS, PROBES = 1 << 20, 400_000, 1 << 20               # text, words and edits that a task holds at once
BITS, SHARD_WORDS, FILTER_BYTES, TASK_WORDS = 16, 1 << 20, 1 << 26, 50_000   # bits a word; words a shard; bytes of filters broadcast at once
RUN, GAP = re.compile(rb"[a-z\xc0-\xff]{%d,}" % MIN_LENGTH), re.compile(rb"[^a-z\xc0-\xff]")
TO_LOWER = LOWER.tobytes()


# ---- vocabulary --------------------------------------------------------------------------------------

def runs_of(text: str) -> Counter:
    """Lower-cased runs of at least MIN_LENGTH letters with their counts, from the whole text in chunks cut between runs."""
    data, found, at = text.encode("latin-1", "replace").translate(TO_LOWER), Counter(), 0
    while at < len(data):
        gap = GAP.search(data, at + CHUNK) if len(data) - at > CHUNK else None
        end = gap.start() if gap else len(data)
        found.update(RUN.findall(data[at:end]))
        at = end
    return found


def as_typed(doc_id: int | None, word: bytes, start: int) -> bytes:
    """The run with its planted deletion, if the checksum that began with the id says so."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
    if h % TYPO_RATE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least MIN_LENGTH code points with their counts over all documents, those below MIN_COUNT left out.

    Tasks add up their own words first, so a frequent word is one row a task.
    """
    def scan(batches):
        total: Counter = Counter()

        def rows():
            for k in range(0, len(words := list(total)), 50_000):
                part = words[k:k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in part], pa.string()), pa.array([total[w] for w in part], pa.int64())], ["word", "n"])
            total.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if not text:
                        continue
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in runs_of(text).items():
                        word = as_typed(doc_id, word, start)
                        if len(word) >= MIN_LENGTH:
                            total[word] += n
                    if len(total) > COUNTED_WORDS:
                        yield from rows()
        yield from rows()

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


# ---- filters -----------------------------------------------------------------------------------------

class Shape:
    """Number of parts and of 512-bit blocks a part, by word length; part, block and bits of a hash."""

    def __init__(self, counts: dict[int, int]):
        self.parts = {length: -(-n // SHARD_WORDS) for length, n in counts.items()}
        self.blocks = {length: -(-n * BITS // (512 * self.parts[length])) for length, n in counts.items()}

    def place(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = (h >> np.uint64(48)) % np.uint64(self.parts[length])
        block = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(self.blocks[length])) >> np.uint64(32)
        return part.astype(np.int64), block.astype(np.int64)

    def rounds(self) -> list[list[tuple[int, int]]]:
        """Shards (length, part) in runs of at most FILTER_BYTES, one shard at least."""
        out, size = [[]], 0
        for length in sorted(self.parts):
            for part in range(self.parts[length]):
                need = self.blocks[length] * 64
                if out[-1] and size + need > FILTER_BYTES:
                    out.append([])
                    size = 0
                out[-1].append((length, part))
                size += need
        return out if out[0] else []


def bit(h: np.ndarray, k: int) -> np.ndarray:
    """The bit that a hash sets in word k of its block."""
    return np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))


def matrices(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, their words as rows of bytes), one pair a length."""
    data = [w.encode("latin-1") for w in words]
    lengths = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield at, np.frombuffer(b"".join(data[k] for k in at), dtype=np.uint8).reshape(len(at), length)


def raw_hash(words: np.ndarray) -> np.ndarray:
    return ((words.astype(np.uint64) + np.uint64(1)) * powers(words.shape[1])[0][:words.shape[1]]).sum(axis=1, dtype=np.uint64)


def filters(words: DataFrame, shape: Shape) -> DataFrame:
    """(length, part, bits) of every shard. Words are dealt by shard, of which none holds more than about SHARD_WORDS words."""
    def keyed(batches):
        for batch in batches:
            for _, rows in matrices(batch.column("word").to_pylist()):
                h = mixed(raw_hash(rows))
                length = np.full(len(h), rows.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(length, pa.int32()), pa.array(shape.place(rows.shape[1], h)[0], pa.int32()), pa.array(h.view(np.int64))], ["length", "part", "h"])

    def build(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            lengths, parts, h = (batch.column(c).to_numpy() for c in ("length", "part", "h"))
            for length, part in set(zip(lengths.tolist(), parts.tolist())):
                mine = h[(lengths == length) & (parts == part)].view(np.uint64)
                bits = held.setdefault((length, part), np.zeros((shape.blocks[length], 8), dtype=np.uint64))
                block = shape.place(length, mine)[1]
                for k in range(8):
                    np.bitwise_or.at(bits[:, k], block, bit(mixed(mine), k))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())],
                                             ["length", "part", "bits"])

    hashes = words.select("word").mapInArrow(keyed, "length int, part int, h long")
    return hashes.repartition("length", "part").mapInArrow(build, "length int, part int, bits binary")


def known(shape: Shape, tables: dict[tuple[int, int], np.ndarray], length: int, raw: np.ndarray) -> np.ndarray:
    """Places of the hashes that one of the given filters may hold."""
    h = mixed(raw)
    parts, blocks = shape.place(length, h)
    found = []
    for part in range(shape.parts[length]):
        if (length, part) in tables:
            left = np.flatnonzero(parts == part) if shape.parts[length] > 1 else np.arange(len(h))
            table = tables[length, part]
            for k in range(8):                                      # most edits are gone after one or two words
                left = left[table[blocks[left], k] & bit(mixed(h[left]), k) != 0]
            found.append(left)
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


# ---- edits -------------------------------------------------------------------------------------------

def known_edits(words: np.ndarray, letters: np.ndarray, shape: Shape, tables: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, edited words) for the edits of words of one length that the filters may hold, each edit once."""
    n, length = words.shape
    up, raw = powers(length)[0], raw_hash(words)
    if any((length, p) in tables for p in range(shape.parts.get(length, 0))):
        step = max(1, PROBES // (n * len(letters)))
        for first in range(0, length, step):
            here = words[:, first:first + step]
            change = letters[None, None, :].astype(np.uint64) - here[:, :, None].astype(np.uint64)
            row, at, letter = np.nonzero(letters[None, None, :] > here[:, :, None])
            hit = known(shape, tables, length, raw[row] + change[row, at, letter] * up[first + at])
            if len(hit):
                edited = words[row[hit]]
                edited[np.arange(len(hit)), first + at[hit]] = letters[letter[hit]]
                yield row[hit], edited
    if any((length - 1, p) in tables for p in range(shape.parts.get(length - 1, 0))):
        step = max(1, PROBES // n)
        values = (words.astype(np.uint64) + np.uint64(1)) * up[:length]
        through = np.cumsum(values, axis=1, dtype=np.uint64)
        last = np.append(words[:, 1:] != words[:, :-1], np.ones((n, 1), dtype=bool), axis=1)     # of equal neighbours one is deleted
        for first in range(0, length, step):
            row, at = np.nonzero(last[:, first:first + step])
            at += first
            shorter = through[row, at] - values[row, at] + (raw[row] - through[row, at]) * np.uint64(BASE_INVERSE)
            hit = known(shape, tables, length - 1, shorter)
            if len(hit):
                keep = np.ones((len(hit), length), dtype=bool)
                keep[np.arange(len(hit)), at[hit]] = False
                yield row[hit], words[row[hit]][keep].reshape(len(hit), length - 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words of a stored vocabulary that differ by one edit, once."""
    spark = words.sparkSession
    counts = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}     # one row a length
    shape = Shape(counts)

    def seen(batches):
        flags = np.zeros(256, dtype=bool)
        for batch in batches:
            flags[np.frombuffer("".join(batch.column("word").to_pylist()).encode("latin-1"), dtype=np.uint8)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(flags), pa.int32())], ["letter"])

    letters = np.array(sorted(r[0] for r in words.select("word").mapInArrow(seen, "letter int").distinct().collect()), dtype=np.uint8)   # at most 90 rows
    tables = stored(filters(words, shape))
    dealt = words.repartition(sum(counts.values()) // TASK_WORDS + 1, "word")
    found = spark.createDataFrame([], "word string, n long, edited string")
    for shards in shape.rounds():
        wanted = spark.createDataFrame(shards, "length int, part int")
        rows = tables.join(wanted, ["length", "part"], "left_semi").collect()                # at most FILTER_BYTES, or one shard
        shared = spark.sparkContext.broadcast({(r["length"], r["part"]): np.frombuffer(r["bits"], dtype=np.uint64).reshape(-1, 8) for r in rows})

        def scan(batches, shared=shared):
            for batch in batches:
                for start in range(0, batch.num_rows, 4096):
                    part = batch.slice(start, 4096)
                    counted = part.column("n").to_numpy()
                    texts = part.column("word").to_pylist()
                    for at, rows in matrices(texts):
                        for lo in range(0, len(at), max(1, PROBES // (rows.shape[1] * len(letters)))):
                            some = at[lo:lo + max(1, PROBES // (rows.shape[1] * len(letters)))]
                            for row, edited in known_edits(rows[lo:lo + len(some)], letters, shape, shared.value):
                                width, data = edited.shape[1], edited.tobytes().decode("latin-1")
                                yield pa.RecordBatch.from_arrays([pa.array([texts[k] for k in some[row]], pa.string()), pa.array(counted[some[row]]),
                                                                  pa.array([data[k:k + width] for k in range(0, len(data), width)], pa.string())], ["word", "n", "edited"])

        found = found.unionByName(dealt.mapInArrow(scan, "word string, n long, edited string"))
    exact = words.select(F.col("word").alias("edited"), F.col("n").alias("n_b"))
    return found.join(exact, "edited").select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("edited").alias("b"), "n_b")


# ---- groups ------------------------------------------------------------------------------------------

def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form) by pointer doubling. Counts grow RATIO-fold along a chain, so it is short and has no ring."""
    up = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = stored(up.join(above, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if up.filter("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary.

    Null and empty texts have no words; a row without id takes part, its id counts as empty; repeated rows count again. An empty
    table, or one without frequent words, gives no rows. Extra columns are ignored.
    """
    words = stored(vocabulary(docs))
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    strong = (-F.col("best.less")) >= F.col("n") * RATIO
    found = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    return found.join(last_forms(found.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
