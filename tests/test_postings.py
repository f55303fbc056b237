"""Stored postings: lookups equal scans, and open the folders of their keys alone."""
import random
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.postings import store_postings
from tidewatch.operators import cluster as K, graph as G
from tidewatch.schema import conform

EDGE = "source_type string, source_id string, edge_type string, target_type string, target_id string, event_id string"


def keep_only(postings, keys, spark):
    """Remove every bucket folder but those of ``keys``."""
    numbers = {r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(F.pmod(F.xxhash64("k"), F.lit(postings.buckets))).collect()}
    for folder in Path(postings.folder).glob("bucket=*"):
        if int(folder.name.split("=")[1]) not in numbers:
            shutil.rmtree(folder)
    return len(numbers)


def test_lookups_equal_filters_and_read_their_buckets_alone(spark, tmp_path):
    """One key holds most rows; null keys, unknown keys, repeated rows, an empty table."""
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", f"k{rng.randrange(40)}", None]), rng.randrange(9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "key string, n int")
    postings = store_postings(df, "key", ["n"], f"{tmp_path}/p", buckets=16)
    for keys in (["hot"], ["k1", "k2", "gone", None], ["gone"], []):
        want = sorted(r for r in rows if r[0] is not None and r[0] in keys)
        assert sorted(map(tuple, postings.rows_of(spark, keys).collect())) == want
        asked = spark.createDataFrame([(k,) for k in keys], "node string")
        assert sorted(map(tuple, postings.rows(asked).collect())) == want
    assert keep_only(postings, ["hot", "k1"], spark) <= 2
    assert postings.rows_of(spark, ["hot"]).count() == sum(r[0] == "hot" for r in rows)
    assert len(list(Path(postings.folder).glob("bucket=*"))) <= 2
    assert store_postings(df.limit(0), "key", [], f"{tmp_path}/empty").rows_of(spark, ["hot"]).count() == 0


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    rng = random.Random(5)
    names = [f"n{k}" for k in range(60)]
    pairs = {("hub", n) for n in names[:45]} | {(rng.choice(names), rng.choice(names)) for _ in range(90)}
    edges = spark.createDataFrame([("t", a, "x", "t" if b < "n3" else "u", b, f"e{a}{b}") for a, b in sorted(pairs)], EDGE)
    entities = spark.createDataFrame([(n, "t" if n < "n3" else "u", n.upper(), "e0") for n in names[:50] + ["hub"]], "id string, type string, name string, event_id string")
    return entities, edges, G.store_graph(entities, edges, str(tmp_path_factory.mktemp("graph")), buckets=8)


@pytest.mark.parametrize("root", ["hub", "n7", "nobody"])
def test_traversals_of_a_stored_graph_equal_those_of_frames(spark, graph, root):
    entities, edges, index = graph
    plain = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert plain(G.edges_from(index, root, 3, spark)) == plain(G.edges_from(edges, root, 3))
    assert plain(G.shortest_path(index, root, "n55", 4, spark)) == plain(G.shortest_path(edges, root, "n55", 4))
    for types in (None, ["u"]):
        for got, want in zip(G.stored_subgraph(spark, index, root, 2, 20, types), G.subgraph(entities, edges, root, 2, 20, types)):
            assert plain(got) == plain(want)


def test_one_hop_needs_the_bucket_of_its_node(spark, graph, tmp_path):
    entities, edges, _ = graph
    index = G.store_graph(entities, edges, str(tmp_path), buckets=64)
    want = edges.filter("source_id = 'hub'").count()
    assert keep_only(index.by_source, ["hub"], spark) == 1
    shutil.rmtree(index.by_target.folder)
    shutil.rmtree(index.entities.folder)
    assert G.edges_from(index, "hub", 1, spark).count() == want


def test_chains_over_an_index_equal_chains_over_events(spark, tmp_path):
    rng, start = random.Random(6), datetime(2024, 1, 1)
    rows = [(f"e{k}", start + timedelta(minutes=rng.randrange(300)), rng.choice(["busy", "busy", f"h{rng.randrange(30)}"]) if k % 4 == 0 else f"only{k // 3}",
             rng.choice([None, f"u{rng.randrange(40)}", f"x\\U{rng.randrange(40)}"]), rng.choice([None, "", f"d{rng.randrange(25)}.com"])) for k in range(400)]
    events = conform(spark.createDataFrame(rows, "event_id string, timestamp timestamp, hostname string, username string, domain string"))
    index = K.store_causal_index(events, f"{tmp_path}/index", buckets=8)
    for first, depth, most in [("e0", 5, 50), ("e0", 2, 7), ("e1", 5, 50), ("e2", 1, 1000), ("e399", 5, 1000), ("none", 5, 50)]:
        want = K.causal_chain(events, first, depth, most).collect()
        assert K.causal_chain(events, first, depth, most, index).collect() == want
    lone = events.filter("event_id = 'e1'")
    keys = [k for r in events.filter("event_id = 'e1'").select(K.causal_ids().alias("k")).collect() for k in r["k"]]
    hop = K.causal_chain(events, "e1", 1, 50).collect()
    keep_only(index, keys, spark)
    assert K.causal_chain(lone, "e1", 1, 50, index).collect() == hop   # neither the other buckets nor the other events are read
