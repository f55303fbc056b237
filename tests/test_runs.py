"""Run tables, the id index, and ingest jobs that stop half way."""
import os
import random
import re
import shutil
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tidewatch.operators import correlate as C
from tidewatch.schema import conform
from tidewatch.sources import runs as R, sinks
from tidewatch.streaming import jobs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def totals(spark, folder, fan_in=3):
    return R.RunTable(spark, folder, ["k"], R.added_up(["k"], ["n"], ["low"]), _parse_datatype_string("k string, n bigint, low bigint"), buckets=4, fan_in=fan_in)


def test_runs_add_up_and_merge(spark, tmp_path):
    table, rng, want = totals(spark, f"{tmp_path}/t"), random.Random(1), {}
    assert table.rows() is None
    for batch in range(10):
        rows = [(rng.choice("abcdefgh"), rng.randint(1, 9), rng.randint(0, 99)) for _ in range(6)] if batch % 4 else []
        frame = spark.createDataFrame(rows, table.schema)
        table.compact(batch)
        table.write(batch, frame.limit(2))                      # stopped, and written anew by the replay
        table.write(batch, frame)
        for k, n, low in rows:
            have = want.get(k, (0, 100))
            want[k] = have[0] + n, min(have[1], low)
    assert {r["k"]: (r["n"], r["low"]) for r in table.rows().collect()} == want
    levels = [r.level for r in table.runs()]
    assert len(levels) <= 5 and max(levels) == 2
    some = spark.createDataFrame([("a",), ("c",)], "k string")
    read = table.rows(touched=some)
    assert {r["k"]: (r["n"], r["low"]) for r in read.collect()} == {k: v for k, v in want.items() if k in "ac"}
    opened = {r[0] for r in some.select(R.bucket_of(["k"], 4)).collect()}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert {int(b) for b in re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(([^)]*)\)", plan)[1].split(",")} == opened and len(opened) < 4
    # A crash after the merged run was written and before its parts were deleted, and one before it was whole.
    merged = table.runs()[0]
    shutil.copytree(f"{tmp_path}/t/run={table.runs()[-1].name}", f"{tmp_path}/t/run={R.Run(0, merged.first, merged.first).name}")
    shutil.copytree(f"{tmp_path}/t/run={merged.name}", f"{tmp_path}/t/run={R.Run(3, 0, 9).name}", ignore=shutil.ignore_patterns("_SUCCESS"))
    assert {r["k"]: (r["n"], r["low"]) for r in table.rows().collect()} == want
    table.compact(10)
    assert {r["k"]: (r["n"], r["low"]) for r in table.rows().collect()} == want and [r.level for r in table.leftovers()] == []


def test_newest_version_keeps_all_rows_of_the_last_batch(spark, tmp_path):
    table = R.RunTable(spark, f"{tmp_path}/t", ["k"], R.newest_version(["k"]), _parse_datatype_string("k string, v bigint"), fan_in=2)
    for batch, rows in enumerate([[("a", 1), ("a", 2), (None, 3)], [("b", 4)], [("a", 5), ("a", 6)], [(None, 7)], [("b", 8)]]):
        table.compact(batch)
        table.write(batch, spark.createDataFrame(rows, table.schema))
        assert batch != 3 or table.rows(before=3).count() == 4
    assert sorted(map(repr, (tuple(r) for r in table.rows().collect()))) == sorted(map(repr, [("a", 5), ("a", 6), (None, 7), ("b", 8)]))


def test_id_index_opens_only_parts_that_may_hold_an_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R.IdIndex, "PART_IDS", 100)
    index, rng, stored = R.IdIndex(spark, f"{tmp_path}/ids", fan_in=4), random.Random(2), []
    ids = lambda names: spark.createDataFrame([(n,) for n in names], "event_id string")
    assert index.known(ids(["x"])).count() == 0
    for batch in range(9):
        number = index.number("query-a", batch)
        again = rng.sample(stored, min(len(stored), 30))
        new = [f"e{batch}-{k}" for k in range(300)]
        assert index.status(number) == "new"
        index.compact(number)
        assert {r[0] for r in index.known(ids(new + again), number).collect()} == set(again)
        index.begin(number, ids(new))
        assert index.status(number) == "begun"
        index.finish(number)
        assert index.status(number) == "done"
        stored += new
    assert len(index.ids.runs()) <= 4 and index.status(0) == "done"
    assert index.number("query-b", 0) == 9 and index.number("query-a", 9) == 9 and index.number("query-b", 2) == 11
    parts = sum(len([n for n in R.Folder(spark, f"{tmp_path}/ids/ids/run={r.name}").names() if n.startswith("bucket=")]) for r in index.ids.runs())
    places = index.ids.candidates(ids([f"new{k}" for k in range(200)]))
    assert parts > 16 and places.select("run", "bucket").distinct().count() <= 3
    assert index.ids.candidates(ids(["e3-7"])).select("run", "bucket").distinct().count() == 1
    whole = spark.createDataFrame([(f"e{k}", START + timedelta(days=k)) for k in range(50)], "event_id string, timestamp timestamp")
    late = R.IdIndex(spark, f"{tmp_path}/late")
    late.cover(whole)
    late.cover(whole)
    assert late.known(ids(["e7", "f7"])).count() == 1 and late.number("q", 0) == 1


DDL = "event_id string, timestamp timestamp, src_ip string, dst_ip string, dst_port int, event_type string"


@pytest.mark.parametrize("stop", ["append", "finish"])
def test_a_job_that_stops_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, stop):
    days = [[(f"e{b}{k}", START + timedelta(days=k % 3, minutes=k), "10.0.0.1", "9.9.9.9", 443, "conn") for k in range(6)] for b in range(3)]
    days[2] += days[0][:3]                                        # ids of another batch and day once more
    for b, rows in enumerate(days):
        conform(spark.createDataFrame(rows, DDL)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{b}")
    frame = conform(spark.createDataFrame(days[0], DDL))
    iocs = spark.createDataFrame([], "ioc_type string, ioc_value string, confidence int, feed_source string, actor_tag string, malware_family string, bare_ip string")
    calls, written = [], []

    def stages(fresh, number):
        calls.append(number)
        written.append((number, sorted(r["event_id"] for r in fresh.select("event_id").collect())))
        if stop == "stages" and len(calls) == 2:
            raise RuntimeError("stop")
        return fresh

    real_append, real_finish = jobs.append_events, R.IdIndex.finish

    def append(rows, folder):
        real_append(rows.limit(2) if stop == "append" and len(calls) == 2 else rows, folder)         # a part of the rows got through
        if stop == "append" and len(calls) == 2:
            raise RuntimeError("stop")

    def finish(self, number):
        if stop == "finish" and len(calls) == 2:
            raise RuntimeError("stop")
        real_finish(self, number)

    monkeypatch.setattr(jobs, "append_events", append)
    monkeypatch.setattr(R.IdIndex, "finish", finish)

    def run(b):
        for name in os.listdir(f"{tmp_path}/in{b}"):
            if name.endswith(".parquet"):
                os.makedirs(f"{tmp_path}/in", exist_ok=True)
                shutil.copy(f"{tmp_path}/in{b}/{name}", f"{tmp_path}/in/{b}.parquet")
        jobs.ingest(jobs.event_stream(spark, f"{tmp_path}/in", frame.schema, max_files=1), f"{tmp_path}/events", f"{tmp_path}/cp", iocs, stages=stages).awaitTermination()

    run(0)
    with pytest.raises(Exception):
        run(1)
    run(2)
    got = [r["event_id"] for r in spark.read.parquet(f"{tmp_path}/events").collect()]
    assert sorted(got) == sorted(r[0] for rows in (days[0], days[1], days[2][:6]) for r in rows)
    assert calls == [0, 1, 1, 2] and written[1] == written[2]


def test_beacons_from_chunk_moments_equal_the_detector(spark):
    rng, rows = random.Random(3), []
    for pair in range(30):
        t, step, jitter = rng.randint(0, 5000), rng.choice([30, 300, 4000]), rng.choice([0, 5, 20, 300])
        for _ in range(rng.randint(1, 40)):
            rows.append((f"e{len(rows)}", START + timedelta(seconds=t), f"10.0.0.{pair}", "9.9.9.9", 443, "conn"))
            t += max(0, step + rng.randint(-jitter, jitter))
    events = conform(spark.createDataFrame(rows, DDL))
    for chunk in ("minute", "hour", "day"):
        parts = [C.connection_chunks(events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k), chunk) for k in range(3)]
        chunks = C.with_moments(C.merged_chunks(parts[0].unionByName(parts[1]).unionByName(parts[2])))
        read = lambda df: sorted((r["id"], r["n_events"], round(r["mean_interval"], 6), round(r["stddev_interval"], 6), r["created_at"]) for r in df.collect())
        want = read(C.beacons(events, 4, 0.5))
        assert read(C.beacons_of(chunks, 4, 0.5)) == want and len(want) > 5
        end = "2024-01-01 03:10:30"
        assert read(C.beacons_of(C.trimmed(chunks, end, "2 hours", chunk), 4, 0.5)) == read(C.beacons(events, 4, 0.5, end, "2 hours"))


@pytest.mark.parametrize("stop", range(7))
def test_a_purge_that_stops_loses_nothing_and_is_finished_later(spark, tmp_path, monkeypatch, stop):
    rows = spark.createDataFrame([(f"e{k}", START + timedelta(hours=6 * k)) for k in range(40)], "event_id string, timestamp timestamp")
    folder = f"{tmp_path}/events"
    sinks.append_events(rows.repartition(3), folder)
    read = lambda: sorted(r[0] for r in spark.read.parquet(folder).select("event_id").collect())
    want = sorted(f"e{k}" for k in range(40) if 6 * k >= 7 * 24 + 10)
    steps = []

    def counted(real):
        def run(self, *names):
            steps.append(names)
            if len(steps) == stop + 2:                     # the first one clears what an earlier purge left
                raise RuntimeError("stop")
            real(self, *names)
        return run
    with monkeypatch.context() as patched:
        patched.setattr(R.Folder, "move", counted(R.Folder.move))
        patched.setattr(R.Folder, "delete", counted(R.Folder.delete))
        with pytest.raises(RuntimeError):
            sinks.purge_old(spark, folder, "2024-01-15 10:00:00", 7)
    assert set(read()) >= set(want)
    sinks.purge_old(spark, folder, "2024-01-15 10:00:00", 7)
    assert read() == want
    sinks.purge_old(spark, folder, "2024-01-15 10:00:00", 7)
    assert read() == want
