"""Cases that once gave wrong answers: batch borders in streams, ids across days, many entities, foreign tables in hunts."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.cluster import causal_chain, cluster_events
from tidewatch.operators.hunt import hunt_sql
from tidewatch.schema import conform
from tidewatch.sources import sinks
from tidewatch.streaming import jobs

START = datetime(2024, 1, 1)
CONN = "event_id string, timestamp timestamp, src_ip string, dst_ip string, dst_port int, event_type string"


def connections(n, shuffled):
    rows = [(str(k), START + timedelta(seconds=60 * k), "10.0.0.1", "10.0.0.2", 443, "conn") for k in range(n)]
    if shuffled:
        random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("batches", [1, 5])
def test_beacon_state_does_not_depend_on_batches(spark, tmp_path, batches):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = connections(400, shuffled=batches == 1)
        for k in range(batches):
            part = rows[400 * k // batches:400 * (k + 1) // batches]
            random.Random(k).shuffle(part)
            spark.createDataFrame(part, CONN).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.event_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], CONN).schema, max_files=1)
        out = jobs.run_to_table(jobs.stream_beacons(stream), f"{tmp_path}/out", f"{tmp_path}/cp", mode="update")
        last = out.orderBy(F.col("batch_id").desc()).first()
        assert (last["n_intervals"], last["mean_interval"], last["stddev_interval"], last["regular"]) == (399, 60.0, 0.0, True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_id_is_stored_once_whatever_its_day(spark, tmp_path):
    schema = "event_id string, timestamp timestamp, ingested_at timestamp"
    row = lambda day: spark.createDataFrame([("x1", START + timedelta(days=day), START + timedelta(days=day))], schema)
    folder = f"{tmp_path}/events"
    assert sinks.stored_table(spark, folder) is None
    sinks.append_events(sinks.new_events(None, row(0)), folder)
    assert sinks.new_events(sinks.stored_table(spark, folder), row(1)).count() == 0
    assert sinks.new_events(sinks.stored_table(spark, folder).drop("event_date"), row(1)).count() == 0


def test_all_entities_of_an_event_link(spark):
    rows = [("a", START, [f"e{k}" for k in range(40)]), ("b", START, ["e39", "z"])]
    events = spark.createDataFrame(rows, "event_id string, timestamp timestamp, entities array<string>")
    found = cluster_events(events, F.col("entities"))
    assert found.select("cluster_id").distinct().count() == 1 and found.count() == 2


def test_a_chain_of_events_that_have_ids_of_their_own(spark):
    rows = [("a", START, "h1", "u1", ["x"]), ("b", START + timedelta(minutes=1), "h2", "u1", ["y"]), ("c", START, "h3", "u3", ["x"])]
    events = conform(spark.createDataFrame(rows, "event_id string, timestamp timestamp, hostname string, username string, ids array<string>")).withColumn("ids", F.array(F.lit("x")))
    assert {r["event_id"] for r in causal_chain(events, "a").collect()} == {"a", "b"}


def test_hunts_read_the_event_view_alone(spark, tmp_path):
    columns = ", ".join(f"c{k} int" for k in range(40))
    events = spark.createDataFrame([("a", 1, "UnresolvedRelation [x]", [1, 2], *range(40)), ("b", 2, "identifier('x')", None, *range(40))], f"event_id string, k int, str string, list array<int>, {columns}")
    events.select("event_id", "k").createOrReplaceTempView("secrets")
    path = f"{tmp_path}/other"
    events.select("event_id").write.parquet(path)
    ok = ["select event_id from normalized_events", "with t as (select * from normalized_events) select k from t where k in (select max(k) from t)", "select count(*) from NORMALIZED_EVENTS n join normalized_events m using (k);",
          "select str, upper(str) from normalized_events where str like '%Unresolved%'", "with a as (select k from normalized_events), b as (select * from a where exists (select 1 from normalized_events e where e.k = a.k)) select * from b union all select k from a",
          "select event_id, sum(case when k > 1 then 1 else 0 end) over (partition by str order by k rows between unbounded preceding and current row) s from normalized_events order by s desc limit 5",
          "select k, x from normalized_events lateral view explode(list) as x where x between 1 and 3", "select str, count(distinct k) n, max(cast(k as double)) from normalized_events group by str having count(*) > 0",
          "select filter(list, x -> x > 1), element_at(list, 1), list[0], k % 2, str || 'x', date '2024-01-01' from normalized_events", "with normalized_events as (select event_id from normalized_events) select * from normalized_events"]
    for sql in ok:
        assert hunt_sql(events, sql).count() > 0, sql
    many = ", ".join(f"c{k}" for k in range(35))
    for sql in ["select * from secrets", "select * from parquet.`/root/testdata/sf0.001/labels.parquet`", "select * from normalized_events where k = (select max(k) from secrets)",
                "with normalized as (select * from secrets) select * from normalized", "select java_method('java.lang.System', 'getenv') from normalized_events", "drop table x", "select 1; select 2",
                f"select * from identifier('parquet.`{path}`')", f"select * from identifier(concat('parquet.`', '{path}`'))", f"select {many}, reflect('java.lang.System', 'getProperty', 'user.home') from normalized_events",
                "with secrets as (select * from secrets) select * from secrets", "with recursive secrets as (select event_id, k from secrets) select * from secrets",
                "select * from normalized_events n where exists (select 1 from (select * from secrets) s where s.k = n.k)", "select * from normalized_events where k in (select k from secrets)",
                "select (select max(k) from secrets) m from normalized_events", "select * from range(3)", "select * from normalized_events, lateral (select * from secrets)", "table secrets", "from secrets select *",
                "select '${env:HOME}' from normalized_events", "select try_reflect('java.lang.System', 'getProperty', 'user.home') from normalized_events", "select system.builtin.reflect('a', 'b') from normalized_events",
                "select _metadata.file_path from normalized_events", "select current_user from normalized_events", "select input_file_name() from normalized_events", "select * from stream(normalized_events)",
                f"select * from read_files('{path}')", f"select * from normalized_events union select * from parquet.`{path}`", "select identifier('k') from normalized_events",
                "with a as (select * from b), b as (select k from normalized_events) select * from a", "select k from normalized_events lateral view java_method('a', 'b') as x"]:
        with pytest.raises(Exception) as error:
            hunt_sql(events, sql)
        assert isinstance(error.value, ValueError) or "PARSE" in str(error.value), (sql, error.value)
