"""Nearest neighbours, reranking, evidence text and answer checks."""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.keyed import newest_per_key
from tidewatch.functions.scalars import sanitize_field
from tidewatch.schema import SEVERITY_BASE, lookup


QUERY_BLOCK, SIDES, LARGEST_BLOCK = 1024, 8, 32768
PACK_ROWS, PACK_BYTES = 4096, 1 << 22
TILE_Q, TILE_V, PAIRS = 256, 2048, 8192        # a tile's products stay in the cache, as do the pairs measured at once
NAN, NULL = 3.0, 4.0                           # in place of a distance, which is 0 to 2: ranked last, as SQL does


def _blocks(n: int, largest: int = LARGEST_BLOCK) -> int:
    """SIDES blocks of 1 024 to ``largest`` rows, more only for larger tables: each row is sent once a block of the other side."""
    return max(1, min(SIDES, -(-n // 1024)), -(-n // largest))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, distance, rank): exact cosine k-NN of every query (query_id, embedding) over all vectors.

    No vector-query pair is ever a row: a task multiplies a block of queries with vectors and keeps k candidates a query. Queries
    that fit ``query_block`` are held by every task and the vectors scanned in place. More queries meet the vectors block by block in a
    cogroup; both sides of a group are of bounded size and nothing passes the driver. The products are as many as there are pairs, in single
    precision; only pairs that these can't rule out (see ``_best``) are measured in double precision, by SQL's own order of sums. Rows
    travel packed; rows sent are SIDES times the input up to SIDES * LARGEST_BLOCK rows.
    """
    n = queries.count()
    n_q, n_v = (1, 1) if n <= query_block else (_blocks(n), _blocks(vectors.count(), 2 * LARGEST_BLOCK))
    (asked, q_type), (stored, v_type) = _rows(queries, "query_id", "embedding", n_q), _rows(vectors, id_col, vec_col, n_v)
    packed = asked.mapInArrow(lambda batches: _pack(batches, q_type), PACKED)
    if n <= query_block:
        best = _scan(stored, [tuple(r[c] for c in PACK) for r in packed.collect()], q_type, v_type, k)      # at most one block
    else:
        parts = min(4 * n_q * n_v, 4096)                                  # so that few groups share one
        asked = packed.select(F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb"), *PACK).repartition(parts, "qb", "vb")
        stored = stored.mapInArrow(lambda batches: _pack(batches, v_type), PACKED) \
            .select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), F.col("block").alias("vb"), *PACK).repartition(parts, "qb", "vb")
        best = asked.groupBy("qb", "vb").cogroup(stored.groupBy("qb", "vb")).applyInArrow(lambda q, v: _block(q, v, q_type, v_type, k), CANDIDATES)
    return best.groupBy("part").applyInArrow(lambda t: _ranked(t, k), "query_id bigint, id bigint, distance double, rank int")


PACK = ["ids", "missing", "vectors"]
PACKED = "block int, ids binary, missing binary, vectors binary"
CANDIDATES = "part bigint, query_ids binary, ids binary, distances binary"


def _rows(df: DataFrame, id_col: str, vec_col: str, blocks: int) -> tuple[DataFrame, str]:
    """(id, v, block), and the type of the vectors' numbers."""
    single = df.schema[vec_col].dataType.elementType.typeName() == "float"
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(f"array<{'float' if single else 'double'}>").alias("v"))
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "<f4" if single else "<f8"


def _pack(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Rows of up to PACK_ROWS ids and vectors of one block."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, v, block = batch.column("id"), batch.column("v"), batch.column("block").to_numpy()
        if ids.null_count:
            raise ValueError("a vector has no id")
        ids, missing = ids.to_numpy(), v.is_null().to_numpy(zero_copy_only=False)
        dims = np.unique(v.value_lengths().to_numpy(zero_copy_only=False)[~missing])
        if len(dims) > 1:
            raise ValueError("vectors differ in length")
        given = np.zeros((len(ids), int(dims[0]) if len(dims) else 0), dtype=kind)
        given[~missing] = v.flatten().to_numpy(zero_copy_only=False).reshape((~missing).sum(), given.shape[1])
        step, out = max(1, min(PACK_ROWS, PACK_BYTES // max(1, given.strides[0]))), []
        for b in np.unique(block):
            rows = np.flatnonzero(block == b)
            out += [(int(b), ids[r].tobytes(), missing[r].tobytes(), given[r[~missing[r]]].tobytes()) for r in (rows[at:at + step] for at in range(0, len(rows), step))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] + [pa.binary()] * 3)], ["block", *PACK])


def _added(m: np.ndarray) -> np.ndarray:
    """Sums of rows, added one number after the other as SQL does."""
    return np.add.accumulate(m, axis=1)[:, -1]


class _Side:
    """Vectors of a block in order of id: as given, their squared lengths, and as unit vectors in single precision.

    ``far`` is NULL for missing vectors, NAN for those without a direction, else 0. With ``k``, only vectors that may be among a query's
    k nearest are held: of equal ones, and of those that are all equally far, the k of smallest id.
    """
    def __init__(self, packs: list[tuple[bytes, bytes, bytes]], kind: str, k: int | None = None):
        ids = np.concatenate([np.frombuffer(p[0], "<i8") for p in packs])
        missing = np.concatenate([np.frombuffer(p[1], bool) for p in packs])
        filled = [(np.frombuffer(p[2], kind), int((~np.frombuffer(p[1], bool)).sum())) for p in packs]
        dims = {len(v) // n for v, n in filled if n} or {1}
        if len(dims) > 1:
            raise ValueError("vectors differ in length")
        given = np.zeros((len(ids), dims.pop()), dtype=kind)
        given[~missing] = np.concatenate([v for v, _ in filled]).reshape((~missing).sum(), given.shape[1])
        order = np.argsort(ids, kind="stable")
        ids, missing, given = ids[order], missing[order], given[order]
        with np.errstate(all="ignore"):
            square = _added(np.square(given, dtype=np.float64)) if given.shape[1] else np.zeros(len(ids))
        still = ~((square > 0) & np.isfinite(square))
        given[still], square[still] = 0, 1.0
        far = np.where(missing, NULL, np.where(still, NAN, 0.0))
        if k is not None:
            keys = np.ascontiguousarray(np.column_stack([given, far.astype(given.dtype)])).view(np.dtype((np.void, (given.shape[1] + 1) * given.itemsize))).ravel()
            _, group = np.unique(keys, return_inverse=True)
            at = np.argsort(group, kind="stable")
            kept = np.sort(at[_places(group[at]) < k])
            ids, given, square, far = ids[kept], given[kept], square[kept], far[kept]
        self.ids, self.given, self.square, self.far = ids, given, square, far
        self.unit = self.direction(slice(None)).astype(np.float32)

    def direction(self, rows) -> np.ndarray:
        return self.given[rows] / np.sqrt(self.square[rows])[:, None]


def _places(keys: np.ndarray) -> np.ndarray:
    """Places of sorted keys among their equals, from 0."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, dtype=np.int64)
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))


def _measured(q: _Side, v: _Side, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of the pairs (r, c): one by one in double precision, so equal vectors are equally far."""
    out = np.maximum(q.far[r], v.far[c])
    for at in range(0, len(r), PAIRS):
        i, j = r[at:at + PAIRS], c[at:at + PAIRS]
        likeness = _added(np.multiply(q.given[i], v.given[j], dtype=np.float64)) / np.sqrt(q.square[i] * v.square[j])
        out[at:at + PAIRS] = np.where(out[at:at + PAIRS] > 0, out[at:at + PAIRS], 1.0 - np.clip(likeness, -1.0, 1.0))
    return out


def _best(q: _Side, v: _Side, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, distance) of the k nearest of each query by (distance, id).

    Products in single precision are off by less than ``slack``. A pair whose product is below a query's k-th largest by more than twice
    that has k nearer ones and goes no further; what is left is measured.
    """
    found, slack, fine_slack = [], np.float32((q.given.shape[1] + 8) * 2.0 ** -23), (q.given.shape[1] + 8) * 2.0 ** -51
    for far in (NAN, NULL):                                               # all vectors with a direction are equally far from these
        rows, some = np.flatnonzero(q.far == far), np.lexsort((v.ids, np.maximum(v.far, far)))[:k]
        found.append((np.repeat(rows, len(some)), np.tile(some, len(rows)), np.tile(np.maximum(v.far[some], far), len(rows))))
    if v.far.all():                                                       # their length may not be known
        v.given = v.unit = np.zeros((len(v.ids), q.given.shape[1]), dtype=np.float32)
    products, marks = np.empty(TILE_Q * TILE_V, dtype=np.float32), np.empty(TILE_Q * TILE_V, dtype=bool)      # used again by every tile
    whole = np.flatnonzero(q.far == 0)
    for rows in (whole[at:at + TILE_Q] for at in range(0, len(whole), TILE_Q)):
        tile, bound = q.unit[rows], np.full(len(rows), -np.inf, dtype=np.float32)
        held, waiting = [], 0
        for at in range(0, len(v.ids), TILE_V):
            stored, far = v.unit[at:at + TILE_V], v.far[at:at + TILE_V] > 0
            n = len(rows) * len(stored)
            product = products[:n].reshape(len(rows), -1)
            np.matmul(tile, stored.T, out=product)
            if at == 0 and len(stored) >= k:
                bound = np.partition(np.where(far, -np.inf, product), -k, axis=1)[:, -k] - 2 * slack
            np.greater_equal(product, bound[:, None], out=marks[:n].reshape(product.shape))
            some = _marked(marks, n)
            if len(some) > max(n // 16, 4 * k * len(rows)):               # very many are about equally near: the products in double precision rule out more
                fine = np.where(far, -np.inf, q.direction(rows) @ v.direction(slice(at, at + TILE_V)).T)
                some = np.flatnonzero(marks[:n].reshape(product.shape) & (fine >= np.partition(fine, -k, axis=1)[:, -k, None] - 2 * fine_slack))
            r, c = np.divmod(some, len(stored))
            held.append((r, c + at, np.where(far[c], np.float32(-2), products[some])))
            waiting += len(r)
            last = at + TILE_V >= len(v.ids)
            if waiting > 2 * k * len(rows) or last:
                r, c, p = (np.concatenate(a) for a in zip(*held))
                order = np.argsort(8.0 * r - p)                           # by query, nearest first
                r, c, p = r[order], c[order], p[order]
                kth = np.flatnonzero(_places(r) == k - 1)
                bound[r[kth]] = p[kth] - 2 * slack
                kept = p >= bound[r]
                r, c, p = r[kept], c[kept], p[kept]
                if last or len(r) > 4 * k * len(rows):                    # before the last, where very many are about equally far
                    d = _measured(q, v, rows[r], c)
                    order = np.lexsort((c, d, r))                         # rows of v are in order of id
                    order = order[_places(r[order]) < k]
                    r, c, p, d = r[order], c[order], p[order], d[order]
                held, waiting = [(r, c, p)], 0
        if len(v.ids):
            found.append((rows[r], c, d))
    return tuple(np.concatenate(a) for a in zip(*found))


def _marked(marks: np.ndarray, n: int) -> np.ndarray:
    """Places of the few marks among the first n; eight are looked at together."""
    whole = -(-n // 8) * 8
    marks[n:whole] = False
    eights = np.flatnonzero(marks[:whole].view(np.uint64))
    r, c = np.nonzero(marks[:whole].reshape(-1, 8)[eights])
    return eights[r] * 8 + c


def _first(query_ids: np.ndarray, ids: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, distances, query_ids))
    order = order[_places(query_ids[order]) < k]
    return query_ids[order], ids[order], distances[order]


def _candidates(block: int, query_ids: np.ndarray, ids: np.ndarray, distances: np.ndarray) -> pa.Table:
    """Packed by query block and remainder of the query's id, which are then ranked each by itself."""
    part = block * 32 + query_ids % 32
    rows = [(int(p), *(a[part == p].tobytes() for a in (query_ids, ids, distances))) for p in np.unique(part)]
    return pa.table([pa.array([r[n] for r in rows], t) for n, t in enumerate([pa.int64()] + [pa.binary()] * 3)], ["part", "query_ids", "ids", "distances"])


def _block(asked: pa.Table, stored: pa.Table, q_type: str, v_type: str, k: int) -> pa.Table:
    if not (asked.num_rows and stored.num_rows):
        return _candidates(0, *[np.empty(0, dtype=np.int64)] * 2, np.empty(0))
    q, v = (_Side(list(zip(*(t.column(c).to_pylist() for c in PACK))), kind, few) for t, kind, few in ((asked, q_type, None), (stored, v_type, k)))
    r, c, distance = _best(q, v, k)
    return _candidates(asked.column("qb")[0].as_py(), q.ids[r], v.ids[c], distance)


def _scan(rows: DataFrame, packs: list, q_type: str, v_type: str, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(packs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = _Side(shared.value, q_type) if shared.value else None
        best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        for batch in _pack(batches, v_type) if q else ():
            v = _Side(list(zip(*(batch.column(c).to_pylist() for c in PACK))), v_type, k)
            r, c, distance = _best(q, v, k)
            best = _first(*(np.concatenate(a) for a in zip(best, (q.ids[r], v.ids[c], distance))), k)
        yield from _candidates(0, *best).to_batches()

    return rows.mapInArrow(task, CANDIDATES)


def _ranked(found: pa.Table, k: int) -> pa.Table:
    query_ids, ids, distances = _first(*(np.frombuffer(b"".join(found.column(c).to_pylist()), t) for c, t in (("query_ids", "<i8"), ("ids", "<i8"), ("distances", "<f8"))), k)
    shown = pa.array(np.where(distances == NAN, np.nan, distances), pa.float64(), mask=distances == NULL)
    return pa.table([pa.array(query_ids), pa.array(ids), shown, pa.array((_places(query_ids) + 1).astype(np.int32))], ["query_id", "id", "distance", "rank"])


def upsert_vectors(stored: DataFrame, incoming: DataFrame, key: str = "vec_id") -> DataFrame:
    versions = stored.withColumn("_v", F.lit(0)).unionByName(incoming.withColumn("_v", F.lit(1)))
    return newest_per_key(versions, [key], ["_v"]).drop("_v")


def rerank(candidates: DataFrame, scores: DataFrame | None, top_k: int) -> DataFrame:
    """Reorder retrieved rows (query_id, id, rank) by given scores (query_id, id, score); without scores keep the order."""
    if scores is None:
        return candidates.filter(F.col("rank") <= top_k).withColumn("new_rank", F.col("rank"))
    joined = candidates.join(scores, ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "rank")  # a query's few candidates
    return joined.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= top_k)


def similar_cases(vectors: DataFrame, queries: DataFrame, verdicts: DataFrame, top: int = 3) -> DataFrame:
    """Most similar confirmed cases of each query vector, itself left out, with a similarity percentage."""
    near = nearest(vectors, queries, top + 1).filter(F.col("id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("rank")
    best = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top)
    pct = F.greatest(F.lit(0), F.bround((1 - F.col("distance")) * 100).cast("int"))
    return best.join(verdicts, best["id"] == verdicts["case_key"], "left").select("query_id", "id", pct.alias("similarity_pct"), "verdict")


# ---- evidence and answers -------------------------------------------------------------------------------

def evidence_lines(events: DataFrame, key: str, max_events: int = 10) -> DataFrame:
    """One text block per key: its most severe events, one line each.

    The row_number limit is applied before the shuffle as well, so a hot key sends only its top rows.
    """
    level = F.coalesce(lookup({k: v for k, v in SEVERITY_BASE.items()}, F.col("severity")), F.lit(0))
    order = Window.partitionBy(key).orderBy(level.desc(), "timestamp", "event_id")
    def s(c, default):
        return F.coalesce(sanitize_field(F.col(c).cast("string")), F.lit(default))
    top = events.filter(F.col(key).isNotNull()).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_events)
    line = F.concat(F.lit("EVENT: "), s("event_type", "?"), F.lit(" | process="), s("process_name", "?"), F.lit(" | host="), s("hostname", "?"),
                    F.lit(" | technique="), s("attack_technique", "N/A"))
    rows = top.select(key, F.struct("n", line.alias("line")).alias("l")).groupBy(key).agg(F.sort_array(F.collect_list("l")).alias("l"))
    return rows.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("evidence"), F.size("l").alias("n_events"))


def numbered_context(passages: DataFrame, key: str, order_by: str, text: str, top: int = 5) -> DataFrame:
    """``[Evidence i] text`` blocks per question, in rank order."""
    rows = passages.filter(F.col(order_by) <= top).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order_by, text))).alias("p"))
    numbered = F.transform("p", lambda x, i: F.concat(F.lit("[Evidence "), (i + 1).cast("string"), F.lit("] "), x[text]))
    return rows.select(key, F.array_join(numbered, "\n\n").alias("context"))


CITATION = r"\[([^\]]{3,64})\]"  # fixed value


def citations_valid(answer: Column, context_ids: Column) -> Column:
    return F.size(F.array_except(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), context_ids)) == 0


def answer_confidence(context_ids: Column, citation_ok: Column) -> Column:
    n = F.size(context_ids)
    return F.round(F.when(n > 0, 0.5).otherwise(0.0) + F.when(citation_ok, 0.3).otherwise(0.0) + F.when(n >= 5, 0.1).otherwise(0.0), 4)


def keyword_recall(text: Column, keywords: Column) -> Column:
    """Share of keywords found in the text, ignoring case; 1 when there are none."""
    low = F.lower(text)
    hits = F.size(F.filter(keywords, lambda w: F.contains(low, F.lower(w))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(hits / F.size(keywords))


def evaluation_summary(results: DataFrame) -> DataFrame:
    """Rows, mean latency, mean recall and tokens per (model, prompt_type)."""
    return results.groupBy("model", "prompt_type").agg(
        F.count(F.lit(1)).alias("rows"), F.floor(F.avg("latency_ms")).alias("avg_latency_ms"), F.round(F.avg("keyword_recall"), 2).alias("avg_recall"),
        F.sum("tokens").alias("total_tokens"))
