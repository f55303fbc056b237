"""Distributed operators against plain sequential code on small random data, hot keys included."""
import random
from collections import defaultdict, deque
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.keyed import with_position, with_previous
from tidewatch.operators import cluster as K, governance as V, graph as G, scores as S, vectors as VEC
from tidewatch.operators.kpi import nearest_rank
from tidewatch.schema import conform

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def make(spark, rows, ddl):
    return conform(spark.createDataFrame(rows, ddl))


@pytest.fixture(scope="module")
def timed(spark):
    rng = random.Random(3)
    rows, t = [], {"hot": 0.0, "calm": 0.0}
    for i in range(900):
        host = "hot" if rng.random() < 0.7 else "calm"
        t[host] += rng.choice([0, 5, 30, 70, 400, 4000])
        rows.append((f"e{i:04d}", START + timedelta(seconds=t[host]), host))
    return rows


def test_previous_and_position_equal_plain_windows(spark, timed):
    from pyspark.sql import Window
    df = spark.createDataFrame(timed, "event_id string, timestamp timestamp, hostname string")
    w = Window.partitionBy("hostname").orderBy("timestamp", "event_id")
    want = df.select("event_id", F.lag("event_id").over(w).alias("p"), (F.row_number().over(w) - 1).alias("n"))
    got = with_position(with_previous(df, ["hostname"], "timestamp", "event_id", F.col("event_id"), "p"), ["hostname"], "timestamp", "event_id", "n")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.select("event_id", "p", "n").collect()))


@pytest.mark.parametrize("chunk_windows", [1, 3, 12])
def test_temporal_clusters_equal_greedy_walk(spark, timed, chunk_windows):
    """One host holds most rows; with short chunks a start is carried over several of them, and dense stretches never pause."""
    rng, second = random.Random(8), 0.0
    for i in range(3000):
        second += rng.choice([1, 7, 20, 20, 20, 290])
        timed = timed if i else list(timed)
        timed.append((f"d{i:04d}", START + timedelta(seconds=second), "dense"))
    want, state = {}, {}
    for eid, ts, host in sorted(timed, key=lambda r: (r[2], r[1], r[0])):
        if host not in state or ts - state[host] > timedelta(minutes=5):
            state[host] = ts
        want[eid] = state[host]
    df = make(spark, timed, "event_id string, timestamp timestamp, hostname string")
    got = {r["event_id"]: r["cluster_start"].astimezone(timezone.utc) for r in K.temporal_cluster_members(df, 5, chunk_windows=chunk_windows).collect()}
    assert got == want


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for _ in range(110)] + [("hub", f"n{i}") for i in range(0, 40)] + [(f"c{i}", f"c{i + 1}") for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for n in list(parent):
        groups[find(n)].add(n)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    want = {n: min(g) for g in groups.values() for n in g if n in linked}
    got = {r["node"]: r["label"] for r in K.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want


def test_causal_chain_equals_breadth_first_search(spark):
    rng = random.Random(8)
    rows = [(f"e{i:03d}", START + timedelta(minutes=i), f"h{rng.randint(0, 60)}.x", f"D\\u{rng.randint(0, 60)}") for i in range(150)]
    by_id = {r[0]: r for r in rows}

    def ids(r):
        return {"host:" + r[2].split(".")[0], "user:" + r[3].split("\\")[1].lower()}
    level, seen, order, depth = ["e010"], {"e010"}, [], 0
    while level:
        order += [(e, depth) for e in level]
        keys = set().union(*[ids(by_id[e]) for e in level])
        if depth == 5:
            break
        level = [r[0] for r in rows if r[0] not in seen and ids(r) & keys]
        seen.update(level)
        depth += 1
    got = {r["event_id"]: r["depth"] for r in K.causal_chain(make(spark, rows, "event_id string, timestamp timestamp, hostname string, username string"), "e010").collect()}
    assert got == dict(order[:50])


@pytest.mark.parametrize("chunk_windows, rounds", [(8, 6), (1, 6), (1, 0), (2, 1)])
def test_rate_gate_equals_sequential_walk(spark, chunk_windows, rounds):
    """One scope has four fifths of the actions; few rounds leave the rest to the walk in order."""
    rng = random.Random(11)
    rows, t = [], defaultdict(float)
    for i in range(700):
        scope = "hot" if rng.random() < 0.8 else "calm"
        t[scope] += rng.choice([0, 0, 20, 300, 900, 5000])
        rows.append((f"a{i:04d}", scope, START + timedelta(seconds=t[scope]), "notify", "8.8.8.8", rng.choice([0.5, 0.9, None]), True))
    want, passed = {}, defaultdict(deque)
    for aid, scope, ts, _, _, confidence, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if confidence is not None and confidence < 0.85:
            want[aid] = "confidence"
            continue
        q = passed[scope]
        while q and q[0] < ts - timedelta(hours=1):
            q.popleft()
        want[aid] = "allowed" if len(q) < 3 else "rate_limit"
        if want[aid] == "allowed":
            q.append(ts)
    ddl = "action_id string, scope string, requested_at timestamp, action string, target string, confidence double, human_confirmed boolean"
    got = {r["action_id"]: r["gate"] for r in V.decide_actions(spark.createDataFrame(rows, ddl), chunk_windows=chunk_windows, rounds=rounds).collect()}
    assert got == want
    shadow = V.decide_actions(spark.createDataFrame(rows, ddl), learning_mode=True).select("shadow_gate", "allowed").distinct().collect()
    assert all(not r["allowed"] for r in shadow)


def plain_scorer(feature, split, window):
    """One row against one window, tree by tree."""
    trees, inner = feature.shape

    def path(row, t):
        node, out = 0, [0]
        while node < inner:
            node = 2 * node + 1 + int(row[feature[t, node]] >= split[t, node])
            out.append(node)
        return out

    def score(row, reference):
        total = 0.0
        for t in range(trees):
            paths = [path(r, t) for r in reference]
            for depth, node in enumerate(path(row, t)):
                mass = sum(p[depth] == node for p in paths)
                total += mass * 2.0 ** depth
                if mass < 0.1 * window:
                    break
        return min(1.0, max(0.0, 1.0 - total / (trees * window * (inner * 2 + 1))))
    return score


@pytest.mark.parametrize("block, rows_at_once", [(64, 4096), (2, 120), (1, 10)])
def test_anomaly_scores_equal_sequential_model(spark, monkeypatch, block, rows_at_once):
    monkeypatch.setattr(S, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(S, "PASS_ROWS", rows_at_once)
    rng = random.Random(2)
    rows = [(f"e{i:04d}", START + timedelta(minutes=7 * i), f"10.0.{int(rng.random() < 0.3)}.5", "cmd.exe", rng.randint(0, 65000), rng.choice(["low", "high", "critical"])) for i in range(400)]
    df = make(spark, rows, "event_id string, timestamp timestamp, src_ip string, process_name string, dst_port int, severity string")
    feats = {r["event_id"]: np.array([[r[f"f_{n}"] for n in S.FEATURES]]) for r in S.peer_features(df).collect()}
    score = plain_scorer(*S.grow_trees(7, 5, 4), 50)
    want, history = {}, defaultdict(list)
    for eid, _, ip, *_ in rows:
        past = history[ip.rsplit(".", 1)[0]]
        n = len(past)
        if n < 50:
            want[eid] = 0.5 if n == 0 else 0.0
        else:
            w = n // 50
            want[eid] = score(feats[eid][0], np.vstack(past[(w - 1) * 50:w * 50]))
        past.append(feats[eid])
    got = {r["event_id"]: r["anomaly_score"] for r in S.score_anomalies(df, trees=5, height=4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nearest_rank_is_exact(spark):
    """Negative and extreme numbers, ties, a hot group, a null group and null values; all groups and percentiles in one frame."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([1, 7, None, -3, 2 ** 62, -2 ** 63, rng.randrange(-10 ** 6, 10 ** 12)])) for _ in range(1501)]
    rows.append(("one", 5))
    percents = [0, 37.5, 50, 95, 100]
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        want.update({(g, float(p)): v[round(p / 100 * (len(v) - 1))] for p in percents})
    df = spark.createDataFrame(rows, "g string, v bigint")
    got = {(r["g"], r["percent"]): r["value"] for r in nearest_rank(df, "v", percents, ["g"]).collect()}
    assert got == want
    everything = sorted(x for _, x in rows if x is not None)
    assert {r["percent"]: r["value"] for r in nearest_rank(df, "v", percents).collect()} == {float(p): everything[round(p / 100 * (len(everything) - 1))] for p in percents}
    assert nearest_rank(df.limit(0), "v", percents, ["g"]).count() == 0


def test_nearest_neighbours_over_many_partitions_and_batches(spark):
    rng = np.random.RandomState(1)
    m = rng.randn(300, 8)
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(300)], "vec_id bigint, embedding array<double>").repartition(7)
    q = df.filter("vec_id < 30").selectExpr("vec_id AS query_id", "embedding")
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, int(j)) for i in range(30) for j in np.argsort(1 - unit[i] @ unit.T, kind="stable")[:5]}
    assert {(r["query_id"], r["id"]) for r in VEC.nearest(df, q, 5, query_block=7).collect()} == want


def test_shortest_path_and_missing_path(spark):
    rows = [("t", a, "x", "t", b) for a, b in [("a", "b"), ("c", "b"), ("c", "d"), ("a", "e"), ("e", "d"), ("y", "z")]]
    edges = spark.createDataFrame(rows, "source_type string, source_id string, edge_type string, target_type string, target_id string")
    assert [r["node"] for r in G.shortest_path(edges, "a", "d").orderBy("step").collect()] == ["a", "e", "d"]
    assert G.shortest_path(edges, "a", "z").count() == 0
