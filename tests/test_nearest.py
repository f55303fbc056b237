"""Nearest neighbours: the SQL's rows on awkward vectors, and few pairs looked at twice."""
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import vectors as V
from tidewatch.plans import load_all
from tidewatch.plans.retrieval import PROBES, knn_sql


def awkward():
    """Random ones, many copies of one, copies in other lengths, near copies, small whole numbers with their many ties, zero, opposite and missing vectors."""
    rng = np.random.default_rng(3)
    common, rows = rng.standard_normal(8), list(rng.standard_normal((300, 8)))
    rows += [common] * 60 + [common * s for s in (2, 0.5, 3, 0.1) for _ in range(5)] + [common + 1e-7 * rng.standard_normal(8) for _ in range(30)] + [-common] * 3
    rows += list(rng.integers(-1, 2, (300, 8)).astype(float)) + [np.zeros(8)] * 15
    order = rng.permutation(len(rows) + 12)
    return [(int(i) * 3 - 40, [float(np.float32(x)) for x in rows[at]] if at < len(rows) else None, int(i) % 10) for i, at in enumerate(order)]


@pytest.mark.parametrize("query_block", [5000, 50])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_are_the_sqls(spark, tmp_path, monkeypatch, query_block, kind):
    monkeypatch.setattr(V, "SIDES", 3)
    monkeypatch.setattr(V, "LARGEST_BLOCK", 150)
    rows = [r for r in awkward() if r[1] or kind == "float"]               # DuckDB refuses missing lists of doubles here
    spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").coalesce(4).write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    for k in (1, 10):
        out = V.nearest(e, e.selectExpr("vec_id as query_id", "embedding"), k, query_block=query_block)
        got = sorted((r["query_id"], r["rank"], r["id"], repr(r["distance"])) for r in out.collect())
        want = con.execute(f"WITH {PROBES}, {knn_sql(k)} SELECT query_id, rank, id, distance FROM near").fetchall()
        assert got == sorted((q, r, i, repr(d)) for q, r, i, d in want)
    lost = V.nearest(e.filter("vec_id % 3 = 0").withColumn("embedding", F.lit(None).cast(f"array<{kind}>")), e.selectExpr("vec_id as query_id", "embedding"), 2, query_block=query_block)
    assert {(r["rank"], r["id"], r["distance"]) for r in lost.collect()} == {(n + 1, i, None) for n, i in enumerate(sorted(i for i, *_ in rows if i % 3 == 0)[:2])}
    near = V.nearest(e.limit(0), e.selectExpr("vec_id as query_id", "embedding"), 3, query_block=query_block)
    assert near.count() == 0 and V.nearest(e, e.limit(0).selectExpr("vec_id as query_id", "embedding"), 3).count() == 0


def test_few_pairs_are_measured_in_double_precision(monkeypatch):
    rows = np.random.default_rng(5).standard_normal((9000, 16)).astype("<f4")
    side = lambda a, b, k=None: V._Side([(np.arange(a, b).tobytes(), np.zeros(b - a, bool).tobytes(), rows[a:b].tobytes())], "<f4", k)
    seen, measured = [], V._measured
    monkeypatch.setattr(V, "_measured", lambda q, v, r, c: seen.append(len(r)) or measured(q, v, r, c))
    r, c, d = V._best(side(0, 1000), side(1000, 9000, 10), 10)
    assert len(r) == 10_000 and sum(seen) < 20_000           # of 8 million pairs


def test_few_pairs_of_near_copies_are_measured(monkeypatch):
    rng = np.random.default_rng(5)
    rows = (rng.standard_normal(16) + 1e-4 * rng.standard_normal((5000, 16))).astype("<f4")
    side = lambda a, b, k=None: V._Side([(np.arange(a, b).tobytes(), np.zeros(b - a, bool).tobytes(), rows[a:b].tobytes())], "<f4", k)
    q, v, seen, measured = side(0, 300), side(300, 5000, 10), [], V._measured
    want = np.lexsort((np.broadcast_to(v.ids, (300, len(v.ids))), measured(q, v, *np.divmod(np.arange(300 * len(v.ids)), len(v.ids))).reshape(300, -1)), axis=1)[:, :10]
    monkeypatch.setattr(V, "_measured", lambda q, v, r, c: seen.append(len(r)) or measured(q, v, r, c))
    r, c, d = V._best(q, v, 10)
    assert (c[np.lexsort((d, r))].reshape(300, 10) == want).all() and sum(seen) < 40_000           # of 1.4 million pairs, all nearer to each other than single precision tells


def test_copies_are_held_k_times():
    rows = np.repeat(np.random.default_rng(5).standard_normal((5, 16)), 200, axis=0)
    v = V._Side([(np.arange(1000)[::-1].tobytes(), np.zeros(1000, bool).tobytes(), rows.tobytes())], "<f8", 3)
    assert sorted(v.ids.tolist()) == [200 * g + n for g in range(5) for n in range(3)]


def test_neighbours_are_searched_once_for_a_rerank(spark, monkeypatch):
    seen, nearest = spark.sparkContext.accumulator(0), V.nearest

    def counted(*args):
        def add(parts):
            for part in parts:
                seen.add(part.num_rows)
                yield part
        out = nearest(*args)
        return out.mapInArrow(add, out.schema)
    monkeypatch.setattr(V, "nearest", counted)
    assert load_all().queries["vec3_rerank"](spark, "/root/testdata/sf0.001").count() == 2000
    assert seen.value == 5000                                # was 10 000: once for the rows, once for the scores
