"""Work a row and shares of a task stay bounded as tables grow."""
from pyspark.sql import functions as F

from tidewatch.operators import cluster as K, coverage as C, governance as G, vectors as V
from tidewatch.plans import ingestion as I, load_all, model as M, streams as S
from tidewatch.schema import conform
from tidewatch.sources import feeds as X
from tidewatch.streaming import jobs as J


def test_rows_sent_by_nearest_grow_with_the_table():
    for n in (10_000, 40_000, 250_000):
        assert V._blocks(n) <= V.SIDES                       # copies of a row; were n / 1024, of filtered vectors n / 100
        assert n / V._blocks(n) <= V.LARGEST_BLOCK
    assert V._blocks(0) == V._blocks(1) == 1


def test_events_are_dealt_before_they_become_wide(spark, monkeypatch):
    rows = spark.range(1000).withColumnRenamed("id", "event_id").coalesce(1)
    assert M.spread(rows, "event_id").rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "PART_ROWS", 100)
    dealt = M.spread(rows, "event_id")
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000


def test_batches_land_in_exactly_so_many_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    for rows in (1000, 2, 0):                                # few rows leave partitions empty, which write no file
        S.land(spark.range(rows), folder, 4)
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 12
    sizes, stream = [], spark.readStream.schema("id long").option("maxFilesPerTrigger", 4).parquet(folder)
    stream.writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sizes == [1000, 2, 0]


def test_validation_pairs_no_request_with_all_detections(spark):
    at = lambda s: F.timestamp_seconds(s)
    asked = spark.createDataFrame([("a", "T1", 1000), ("b", "T1.001", 400), ("c", "T2", 1000), ("d", "T1", 99), ("e", "T1", 100)], "request_id string, technique_id string, s long").withColumn("checked_at", at("s")).drop("s")
    found = spark.createDataFrame([("x", "T1.002", 100), ("y", "T1", 100), ("z", "T1", 950), ("w", "T3", 990)], "id string, attack_technique string, s long").withColumn("created_at", at("s")).drop("s")
    out = C.validate_tests(asked, found, 300)
    got = {r["request_id"]: (r["detection_id"], r["verdict"]) for r in out.collect()}
    assert got == {"a": ("z", "pass"), "b": (None, "fail"), "c": (None, "fail"), "d": (None, "fail"), "e": ("y", "pass")}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_slot" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_a_batch_is_normalized_once_and_keeps_the_first_delivery_of_an_id(spark, tmp_path, monkeypatch):
    rows = [("a", 5, "late"), ("a", 3, "first"), ("b", 1, "only"), ("a", 3, "again")]
    frame = conform(spark.createDataFrame(rows, "event_id string, s long, hostname string").withColumn("timestamp", F.timestamp_seconds(F.col("s") + 1_704_067_200)).drop("s")).withColumn("ingested_at", F.col("timestamp"))
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = spark.sparkContext.accumulator(0)

    def counted(batch):
        def add(parts):
            for part in parts:
                seen.add(part.num_rows)
                yield part
        return batch.mapInArrow(add, batch.schema)
    monkeypatch.setattr(J, "normalize", counted)
    iocs = spark.createDataFrame([], "ioc_type string, ioc_value string, confidence int, feed_source string, actor_tag string, malware_family string, bare_ip string")
    J.ingest(J.event_stream(spark, f"{tmp_path}/in", frame.schema), f"{tmp_path}/events", f"{tmp_path}/cp", iocs, f"{tmp_path}/hits").awaitTermination()
    got = {r["event_id"]: r["hostname"] for r in spark.read.parquet(f"{tmp_path}/events").collect()}
    assert set(got) == {"a", "b"} and got["a"] in ("first", "again")
    assert seen.value == len(rows)                           # was twice as many: once for the rows, once for the hits


def test_events_land_as_they_were_dealt(spark, tmp_path):
    raw = M.raw_events(spark, "/root/testdata/sf0.001", 6)
    assert raw.rdd.getNumPartitions() == 6
    S.land(raw, f"{tmp_path}/in", 6, dealt=True)
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 6 and spark.read.parquet(f"{tmp_path}/in").count() == raw.count()


def test_one_causal_chain_stores_no_postings_of_all_events(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("all events stored for one chain")
    monkeypatch.setattr(K, "store_causal_index", refuse)
    queries = load_all().queries
    assert queries["clu6_causal_chain"](spark, "/root/testdata/sf0.001").count() == 50
    assert queries["clu8_causality"](spark, "/root/testdata/sf0.001").first()["n_events"] == 50


def test_catalog_objects_are_parsed_once(spark):
    objects = X.stix_objects(I.stix_lines(spark, "/root/testdata/sf0.001"))
    plans = [f(objects)._jdf.queryExecution().optimizedPlan().toString() for f in (X.stix_group_techniques, X.technique_documents)]
    assert all("from_json" not in p for p in plans)          # were three and four parses of every line
    one = X.stix_techniques(objects)._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("from_json") == 1


def test_gates_are_judged_once_a_row_above_the_deal(spark):
    rows = [("a", "block_ip", " 10.1.2.3 ", "safelist"), ("b", "block_ip", "11.0.0.1", "allowed"), ("c", "block_ip", "::1", "safelist"), ("d", "notify", "10.1.2.3", "allowed"), ("e", "block_ip", None, "allowed")]
    acts = spark.createDataFrame([(i, f"s{i}", a, t, 0.9, True) for i, a, t, _ in rows], "action_id string, scope string, action string, target string, confidence double, human_confirmed boolean") \
        .withColumn("requested_at", F.timestamp_seconds(F.lit(0))).repartition(3, "action_id")
    out = G.decide_actions(acts)
    assert {r["action_id"]: r["gate"] for r in out.collect()} == {i: g for i, _, _, g in rows}
    assert "safelist" not in out._jdf.queryExecution().optimizedPlan().toString()      # was judged where it is filtered on and again in the result


def test_entities_of_an_event_are_made_once(spark):
    rows = conform(spark.createDataFrame([(f"e{i}", f"h{i // 2}", f"u{i}") for i in range(6)], "event_id string, hostname string, username string")).withColumn("timestamp", F.timestamp_seconds(F.lit(0)))
    out = K.cluster_events(rows)
    assert {r["event_id"]: r["n_events"] for r in out.collect()} == {f"e{i}": 2 for i in range(6)}
    assert "user:" not in out._jdf.queryExecution().optimizedPlan().toString()         # was made anew for every use
