"""SimHash fingerprints with DataFrame functions alone, the likeness of two of them, and search within a Hamming radius.

Terms are pairs of neighbouring lower-case words (the last word stands alone too), each occurrence a vote, so a term weighs as
often as it occurs. Bits i and i + 32 of a term hash are counted in the two halves of one sum, so 128 bits take 64 sums, all
combined inside the task that reads the text; what is shuffled is one row a text.
"""
from __future__ import annotations

from itertools import combinations
from math import pi

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import running_total, stored

BITS, CHUNK_ROWS, PART_ROWS = 128, 256, 250_000
RADIUS, QUERY_STEP = 3, 100        # bits; every document whose id this divides is a query of the search
MAX_BROADCAST_LEADS = 250_000      # 12 MB
HALVES = 0x1_0000_0001


def term_hashes(text: Column) -> Column:
    words = F.split(F.lower(text), r"\s+")
    return F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b))


def votes() -> list[Column]:
    """Aggregates over rows of one term hash ``h`` each."""
    hashes = (F.col("h"), F.xxhash64("h"))
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(HALVES))).alias(f"v{k}_{i}") for k, h in enumerate(hashes) for i in range(32)] + [F.count("h").alias("terms")]


def majority(k: int) -> Column:
    """64 bits: bit i is set if more than half of the terms have it."""
    word = F.lit(0).cast("long")
    for i in range(32):
        count = F.col(f"v{k}_{i}")
        for shift, ones in ((i, count.bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(count, 32))):
            word = word.bitwiseOR(F.shiftleft((ones * 2 > F.col("terms")).cast("long"), shift))
    return word


def fingerprint_columns(exploded: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and the fingerprint as longs f0 and f1, from rows of keys and term hash h."""
    return exploded.groupBy(*keys).agg(*votes()).select(*keys, majority(0).alias("f0"), majority(1).alias("f1"))


def text_of(f0: Column, f1: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(f)), 16, "0") for f in (f0, f1)))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def likeness(distance_: Column) -> Column:
    """Cosine of the angle that the share of different bits estimates: 1 for equal, about 0 for unrelated texts, never less."""
    return F.greatest(F.lit(0.0), F.cos(distance_ * F.lit(pi / BITS)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0, f1) of every document; a null text counts as empty and repeated rows each get one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), term_hashes(F.coalesce("text", F.lit(""))).alias("hashes"))
    rows = rows.select("row", "doc_id", F.explode("hashes").alias("h"))
    return fingerprint_columns(rows, ["row", "doc_id"]).drop("row")


def with_next(docs: DataFrame) -> DataFrame:
    """(chunk, place, n_chunks, last, doc_id, text, next): each document and the text of the next one in ascending doc_id order.

    Distinct (doc_id, text hash) pairs get dense ranks; CHUNK_ROWS ranks are a chunk, and the first of each chunk is also sent to
    the end of the chunk before, so the next text is found inside a chunk. The last chunk is followed by the first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    pairs = stored(rows.select("doc_id", "key").distinct().withColumn("one", F.lit(1)))
    n = pairs.count()
    n_chunks = max(1, -(-n // CHUNK_ROWS))
    rank = running_total(pairs, ["doc_id", "key"], "one", "rank", max(1, -(-n // PART_ROWS))).select(F.col("doc_id").alias("r_id"), F.col("key").alias("r_key"), "rank")
    chunk = F.floor(F.col("rank") / CHUNK_ROWS).cast("long")
    ranked = rows.join(rank, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")))
    before = F.when(F.col("rank") % CHUNK_ROWS == 0, F.array(chunk, F.pmod(chunk - 1, F.lit(n_chunks)))).otherwise(F.array(chunk))
    placed = ranked.select("doc_id", "text", "rank", F.posexplode(before).alias("ghost", "chunk"))
    order = Window.partitionBy("chunk").orderBy("ghost", "rank")
    linked = (placed.withColumn("next", F.lead("text").over(order)).withColumn("next_ghost", F.lead("ghost").over(order)).withColumn("place", F.row_number().over(order))
              .filter("ghost = 0"))
    return linked.select("chunk", "place", (F.col("next_ghost") == 1).alias("last"), "doc_id", "text", "next").withColumn("n_chunks", F.lit(n_chunks))


def edited_and_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within) of every document.

    The edited text has the last quarter of the code points replaced by the first as many (or all) of the next document. A null
    text counts as empty; equal ids are ordered by a text hash, and the copy of a repeated row is its next document; rows without
    id come first; a single document is its own next. Extra columns are ignored. n_within is the number of other documents with a
    fingerprint at most RADIUS bits apart, for ids divisible by QUERY_STEP; null for the others and without an id.
    """
    n, k = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next"), F.lit(1), k))
    rows = with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    keys = ["chunk", "place", "n_chunks", "last", "doc_id", "n_chars", "edited_sha256"]
    both = rows.withColumn("edited_sha256", F.sha2("edited", 256)).select(*keys, F.posexplode(F.array("text", "edited")).alias("is_edited", "t"))
    votes_of = fingerprint_columns(both.select(*keys, "is_edited", F.explode(term_hashes(F.col("t"))).alias("h")), [*keys, "is_edited"])
    two = votes_of.groupBy(*keys).agg(*[F.max(F.when(F.col("is_edited") == e, F.col(f))).alias(f"{name}{f}") for e, name in ((0, "a"), (1, "e")) for f in ("f0", "f1")])
    table = stored(two)                                    # narrow: no texts
    target = table.select(F.col("chunk").alias("n_chunk"), F.col("place").alias("n_place"), F.col("af0").alias("nf0"), F.col("af1").alias("nf1"))
    following = table.withColumn("n_chunk", F.when(F.col("last"), F.pmod(F.col("chunk") + 1, F.col("n_chunks"))).otherwise(F.col("chunk"))).withColumn("n_place", F.when(F.col("last"), F.lit(1)).otherwise(F.col("place") + 1))
    prints, asks = table.select(F.col("af0").alias("f0"), F.col("af1").alias("f1"), "doc_id"), F.col("doc_id") % QUERY_STEP == 0
    counts = stored(near_counts(prints, prints.filter(asks)))
    within = counts.select(F.col("f0").alias("af0"), F.col("f1").alias("af1"), F.lit(True).alias("asked"), (F.col("n") - 1).alias("n_within"))
    within = F.broadcast(within) if counts.count() <= MAX_BROADCAST_LEADS else within
    out = following.withColumn("asked", F.coalesce(asks, F.lit(False))).join(target, ["n_chunk", "n_place"]).join(within, ["af0", "af1", "asked"], "left")
    c = F.col
    return out.select("doc_id", "n_chars", "edited_sha256", text_of(c("af0"), c("af1")).alias("fingerprint"), text_of(c("ef0"), c("ef1")).alias("edited_fingerprint"),
                      likeness(distance(c("af0"), c("af1"), c("ef0"), c("ef1"))).alias("near_edited"), likeness(distance(c("af0"), c("af1"), c("nf0"), c("nf1"))).alias("near_next"), "n_within")


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of radius + 2 blocks."""
    n = radius + 2
    edges = [BITS * k // n for k in range(n + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def bit_field(first: int, width: int) -> Column:
    """The bits [first, first + width) of the fingerprint, as a string of its parts in either word."""
    parts = []
    for word, base in (("f0", 0), ("f1", 64)):
        low, high = max(first, base), min(first + width, base + 64)
        if low < high:
            size = high - low
            parts.append(F.shiftrightunsigned(F.shiftleft(F.col(word), base + 64 - high), 64 - size).cast("string"))
    return F.concat_ws(",", *parts)


def agreeing(radius: int, x0: Column, x1: Column) -> Column:
    """Bit b is set if the differing bits x0 and x1 leave block b alone."""
    found = F.lit(0).cast("long")
    for b, (first, width) in enumerate(blocks(radius)):
        mask = ((1 << width) - 1) << first
        low, high = (m - (1 << 64) if m >> 63 else m for m in (mask & (1 << 64) - 1, mask >> 64))
        same = (x0.bitwiseAND(F.lit(low).cast("long")) == 0) & (x1.bitwiseAND(F.lit(high).cast("long")) == 0)
        found = found + F.when(same, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long"))
    return found


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(f0, f1, n): for every different fingerprint of ``queries``, the rows of ``prints`` at most ``radius`` bits apart, equal ones
    included; only those with any.

    The block tables of :func:`within_radius`. A pair counts in the first table it meets in, the one of the first two blocks it
    agrees in, so no pair is a row and nothing is made distinct. Few queries are broadcast and the tables are probed in place, hot
    blocks too; more are joined by a shuffle, where adaptive execution splits a hot block.
    """
    if not 0 <= radius <= 60:
        raise ValueError("radius out of range")
    known = prints.filter("f0 is not null and f1 is not null").groupBy("f0", "f1").agg(F.count(F.lit(1)).alias("members"))
    asked = queries.filter("f0 is not null and f1 is not null").select("f0", "f1").distinct()
    fields = [bit_field(*b) for b in blocks(radius)]
    tables = list(combinations(range(len(fields)), 2))
    leads = F.posexplode(F.array(*[F.xxhash64(fields[i], fields[j]) for i, j in tables])).alias("k", "lead")
    held = stored(asked.select(F.col("f0").alias("q0"), F.col("f1").alias("q1"), leads))
    held = F.broadcast(held) if held.count() <= MAX_BROADCAST_LEADS else held
    x0, x1 = F.col("f0").bitwiseXOR(F.col("q0")), F.col("f1").bitwiseXOR(F.col("q1"))
    both = F.element_at(F.array(*[F.lit(1 << i | 1 << j).cast("long") for i, j in tables]), F.col("k") + 1)
    upto = F.element_at(F.array(*[F.lit((2 << j) - 1).cast("long") for _, j in tables]), F.col("k") + 1)
    near = (F.bit_count(x0) + F.bit_count(x1) <= radius) & (agreeing(radius, x0, x1).bitwiseAND(upto) == both)
    met = known.select("f0", "f1", "members", leads).join(held, ["k", "lead"]).filter(near)
    return met.groupBy("q0", "q1").agg(F.sum("members").alias("n")).select(F.col("q0").alias("f0"), F.col("q1").alias("f1"), "n")


def within_radius(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(a0, a1, b0, b1, distance): all pairs of different fingerprints at most ``radius`` bits apart, from columns f0 and f1.

    Two such fingerprints differ in at most ``radius`` of radius + 2 blocks, so they agree in two blocks at least: one table for
    each two blocks holds the fingerprints with these blocks first, and only rows with equal leading blocks meet. Rows with the
    same fingerprint are one class; their members are found by joining on it.
    """
    if not 0 <= radius <= BITS - 2:
        raise ValueError("radius out of range")
    distinct = prints.filter("f0 is not null and f1 is not null").select("f0", "f1").distinct()
    fields = [bit_field(*b) for b in blocks(radius)]
    tables = F.array(*[F.concat_ws("/", F.lit(str(k)), fields[i], fields[j]) for k, (i, j) in enumerate(combinations(range(len(fields)), 2))])
    led = distinct.select("f0", "f1", F.explode(tables).alias("lead"))
    left, right = (led.select(F.col("f0").alias(f"{s}0"), F.col("f1").alias(f"{s}1"), "lead") for s in "ab")
    apart = distance(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    ordered = (F.col("a0") < F.col("b0")) | ((F.col("a0") == F.col("b0")) & (F.col("a1") < F.col("b1")))
    return left.join(right, "lead").filter(ordered & (apart <= radius)).select("a0", "a1", "b0", "b1", apart.alias("distance")).distinct()
