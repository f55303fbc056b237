"""Stages of the ingest job over several micro-batches."""
import os
import random
from datetime import datetime, timedelta, timezone

import numpy as np

from tests.test_brute_force import plain_scorer
from tidewatch.operators import correlate as C, scores as S
from tidewatch.schema import conform
from tidewatch.streaming import jobs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
DDL = "event_id string, timestamp timestamp, src_ip string, dst_ip string, dst_port int, event_type string, event_outcome string, process_name string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def run_batches(spark, folder, batches, **stages):
    """Ingests each list of rows as a micro-batch of its own; returns (stored events, folder of the stages)."""
    schema = None
    for k, rows in enumerate(batches):
        frame = conform(spark.createDataFrame(rows, DDL))
        schema = frame.schema
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for name in os.listdir(f"{folder}/in"):                 # the stream takes files by age
            path = f"{folder}/in/{name}"
            if name.endswith(".parquet") and os.path.getmtime(path) > 1e9:
                os.utime(path, (1e6 + k, 1e6 + k))
    iocs = spark.createDataFrame([], "ioc_type string, ioc_value string, confidence int, feed_source string, actor_tag string, malware_family string, bare_ip string")
    stream = jobs.event_stream(spark, f"{folder}/in", schema, max_files=1)
    jobs.ingest(stream, f"{folder}/events", f"{folder}/cp", iocs, stages=jobs.derived_stages(f"{folder}/stages", **stages)).awaitTermination()
    return spark.read.parquet(f"{folder}/events"), f"{folder}/stages"


def test_correlation_over_batches_equals_the_detectors_over_all_events(spark, tmp_path):
    rng, rows = random.Random(4), []

    def event(second, src, dst, port, kind="conn", outcome=None):
        rows.append((f"e{len(rows):04d}", at(second), src, dst, port, kind, outcome, None))
    for i in range(16):
        event(i * 60, "10.0.0.1", "9.9.9.9", 443)                                # stays a beacon
        event(i * 60 if i < 8 else i * i * 40, "10.0.0.2", "9.9.9.9", 443)       # loses its regularity in the last batch
    for i in range(8):
        event(200 + i, "10.0.0.3", "8.8.8.8", 100 + i, "scan")                   # one scan window and one window of failures, both split over batches
        event(205 + 2 * i, "10.0.0.3", None if i % 2 else "8.8.8.8", None, "logon_failure")
        event(300 + i, "10.0.0.1", "8.8.8.8", 200 + i, "scan")
        event(1800 + i, "10.0.0.3", "8.8.4.4", 300 + i, "scan")                  # reported: the clock of its batch is two hours on
    cut = [[r for i, r in enumerate(rows) if r[1] < at(500) and i % 3 != 1], [r for i, r in enumerate(rows) if r[1] < at(500) and i % 3 == 1], [r for r in rows if r[1] >= at(500)]]
    for batch in cut:
        rng.shuffle(batch)
    scan, brute, beacon = dict(window="60 seconds", min_ports=5), dict(min_failures=3), dict(min_intervals=3, max_cv=0.3)
    chains = [C.Chain("by-rules", rule_ids=["corr-portscan", "corr-bruteforce"], window="1 day"), C.Chain("by-tactics", rule_tactics=["discovery", "command-and-control"], window="1 day")]
    events, stages = run_batches(spark, tmp_path, cut, **scan, brute=brute, beacon=beacon, chains=chains)
    got = jobs.derived_table(spark, stages, "detections")
    parts = [C.port_scans(events, **scan), C.brute_force(events, **brute), C.beacons(events, **beacon)]
    want = parts[0].select(*C.OUTPUT).unionByName(parts[1].select(*C.OUTPUT)).unionByName(parts[2].select(*C.OUTPUT))
    want = want.unionByName(C.chain_by_rules(want, chains[0], "2024-01-01 20:00:00")).unionByName(C.chain_by_tactics(want, chains[1], "2024-01-01 20:00:00"))
    wanted = {(r["id"], r["rule_id"], r["entity_key"], r["n_events"], r["created_at"]) for r in want.collect()}
    assert {(r["id"], r["rule_id"], r["entity_key"], r["n_events"], r["created_at"]) for r in got.collect()} == wanted
    assert {(r[1], r[2]) for r in wanted} == {("corr-portscan", "10.0.0.1"), ("corr-portscan", "10.0.0.3"), ("corr-bruteforce", "10.0.0.3"), ("corr-beacon", "10.0.0.1"),
                                              ("corr-chain-by-rules", "10.0.0.3"), ("corr-chain-by-tactics", "10.0.0.1")}
    early = spark.read.parquet(f"{stages}/detections").filter("rule_id = 'corr-beacon' AND entity_key = '10.0.0.2'").orderBy("run").collect()
    assert [r["retracted"] for r in early][-1] and not early[0]["retracted"]
    repeats = [r for r in got.collect() if r["suppressed"]]
    assert {(r["rule_id"], r["window_start"].astimezone(timezone.utc)) for r in repeats} == {("corr-bruteforce", at(180))}     # the second target of one source


def test_anomaly_scores_over_batches_equal_a_sequential_replay(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"e{i:04d}", at(60 * rng.randint(0, 5000)), f"10.0.{int(rng.random() < 0.3)}.5", "9.9.9.9", rng.choice([443, 443, 443, 65000]), "conn", None, "cmd.exe") for i in range(330)]
    batches = [rows[:70], rows[70:75], rows[75:330]]
    events, stages = run_batches(spark, tmp_path, batches, anomaly=dict(trees=5, height=4), threshold=0.4)
    feats = {r["event_id"]: np.array([[r[f"f_{n}"] for n in S.FEATURES]]) for r in S.peer_features(events).collect()}
    score, want, history = plain_scorer(*S.grow_trees(7, 5, 4), 50), {}, {}
    for batch in batches:
        for eid, _, ip, *_ in sorted(batch, key=lambda r: (r[1], r[0])):
            past = history.setdefault(ip, [])
            w = len(past) // 50
            want[eid] = score(feats[eid][0], np.vstack(past[(w - 1) * 50:w * 50])) if w else 0.0 if past else 0.5
            past.append(feats[eid])
    got = {r["event_id"]: r["anomaly_score"] for r in events.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    found = {r["event_id"] for r in jobs.derived_table(spark, stages, "anomalies").collect()}
    assert found == {k for k, v in want.items() if v > 0.4} and found


def test_beacon_state_takes_rows_of_neighbouring_batches_interleaved(spark, tmp_path):
    instants = [60 * i for i in range(48)]
    batches = [instants[0:12:2] + [instants[12]], instants[1:12:2] + instants[14:24:2], instants[13:24:2] + instants[24:36:3], [t for i, t in enumerate(instants[24:]) if i >= 12 or i % 3]]
    assert sorted(sum(batches, [])) == instants
    for k, batch in enumerate(batches):
        frame = conform(spark.createDataFrame([(f"e{t}", at(t), "10.0.0.1", "9.9.9.9", 443, "conn", None, None) for t in batch], DDL))
        frame.coalesce(1).write.parquet(f"{tmp_path}/made{k}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        [name] = [n for n in os.listdir(f"{tmp_path}/made{k}") if n.endswith(".parquet")]
        os.rename(f"{tmp_path}/made{k}/{name}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1e9 + 10 * k, 1e9 + 10 * k))
    stream = jobs.event_stream(spark, f"{tmp_path}/in", frame.schema, max_files=1)
    rows = jobs.run_to_table(jobs.stream_beacons(stream), f"{tmp_path}/out", f"{tmp_path}/cp", mode="update").orderBy("batch_id").collect()
    assert [r["n_intervals"] for r in rows] == [6, 17, 27, 47]
    assert abs(rows[-1]["mean_interval"] - 60) < 1e-9 and rows[-1]["stddev_interval"] < 1e-6 and rows[-1]["regular"]
