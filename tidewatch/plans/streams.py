"""Streaming jobs drained over the event table written as stream input."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import correlate as C, intel as I
from tidewatch.plans import derived as D
from tidewatch.plans.enrichment import ASSETS
from tidewatch.plans.graphs import GRAPH
from tidewatch.plans.detection import BEACON, BRUTE_SQL, BRUTE, CHAINS, SCAN, SCAN_SQL, correlated
from tidewatch.plans.ingestion import RECORD_COLUMNS, eve_lines, sensor_docs, syslog_lines  # noqa: F401
from tidewatch.plans.model import AS_OF, REGISTRY, events, query, raw_events, table, with_ne
from tidewatch.sources.runs import Folder
from tidewatch.sources.sinks import append_events, scratch_folder
from tidewatch.streaming import jobs as J, runner as T


FILE_ROWS = 1 << 15


def files_a_batch(spark, sf, batches):
    """In how many files a micro-batch lands: its size grows with the table, the share of a task that writes or reads a file does not."""
    return max(1, -(-table(spark, sf, "events").count() // (batches * FILE_ROWS)))


def land(rows, folder, files, dealt=False):
    """Appends exactly ``files`` files, empty ones where rows are few, so that a stream that takes as many at a time sees them as one batch.
    Rows ``dealt`` into as many partitions beforehand, while they were narrow, are written as they are."""
    spark, disk = rows.sparkSession, Folder(rows.sparkSession, folder)
    wanted = files + sum(n.endswith(".parquet") for n in disk.names())
    (rows if dealt else rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(folder)
    for _ in range(wanted - sum(n.endswith(".parquet") for n in disk.names())):
        spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(folder)


def landed(spark, sf, batches=1):
    """Event table as stream input; returns (stream, folder for outputs). Several batches are groups of files in time order, read one at a time."""
    folder = scratch_folder(spark)
    if batches == 1:
        events(spark, sf).write.parquet(folder + "/in")
        return J.event_stream(spark, folder + "/in", events(spark, sf).schema), folder
    ordered, files = events(spark, sf).withColumn("_day", F.dayofyear("timestamp")), files_a_batch(spark, sf, batches)
    for k in range(batches):                                  # written one after another: the stream takes files by age
        land(ordered.filter((F.col("_day") > 30 * k // batches) & (F.col("_day") <= 30 * (k + 1) // batches if k < batches - 1 else F.lit(True))).drop("_day"), folder + "/in", files)
    return J.event_stream(spark, folder + "/in", events(spark, sf).schema, max_files=files), folder


def newest_batch(rows, keys):
    """Of an update-mode output, the last row of each key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


@query("str1_tail_firewall", with_ne("SELECT date_trunc('second', timestamp) AS timestamp, src_ip, dst_ip, dst_port FROM ne"))
def str1(spark, sf):
    folder = scratch_folder(spark)
    syslog_lines(spark, sf).write.text(folder + "/in")
    stream = J.tail(spark, folder + "/in", "firewall", max_files=2, as_of=F.lit("2024-02-01").cast("timestamp"))
    return J.run_to_table(stream, folder + "/out", folder + "/cp").select("timestamp", "src_ip", "dst_ip", "dst_port")


@query("str1_tail_ids", with_ne("SELECT timestamp, src_ip, 'flow_id:' || event_id AS flow FROM ne"))
def str1b(spark, sf):
    folder = scratch_folder(spark)
    eve_lines(spark, sf).write.text(folder + "/in")
    out = J.run_to_table(J.tail(spark, folder + "/in", "eve"), folder + "/out", folder + "/cp")
    return out.select("timestamp", "src_ip", F.regexp_extract("tags", r"(flow_id:\d+)", 1).alias("flow"))


@query("str2_tail_host_agent", with_ne("SELECT process_id, date_trunc('second', timestamp) AS timestamp, 'osquery:procs' AS tags FROM ne"))
def str2(spark, sf):
    folder = scratch_folder(spark)
    events(spark, sf).select(F.to_json(F.struct(F.lit("procs").alias("name"), F.unix_timestamp("timestamp").alias("unixTime"), F.struct(
        F.col("process_id").cast("string").alias("pid"), F.col("event_id").alias("e")).alias("columns"))).alias("value")).write.text(folder + "/in")
    return J.run_to_table(J.tail(spark, folder + "/in", "osquery"), folder + "/out", folder + "/cp").select("process_id", "timestamp", "tags")


@query("str3_pull_documents", with_ne("SELECT event_id AS doc FROM ne WHERE CAST(event_id AS BIGINT) % 13 <> 0"))
def str3(spark, sf):
    folder = scratch_folder(spark)
    sensor_docs(spark, sf).withColumn("kind", F.lit("alert")).write.json(folder + "/in")
    out = J.run_to_table(J.tail_documents(spark, folder + "/in"), folder + "/out", folder + "/cp")
    return out.select(F.get_json_object("raw_event", "$.doc_id").alias("doc"))


_INGESTED: dict[tuple, str] = {}


def ingested(spark, sf, stages=False):
    """Folder of a table filled in three micro-batches, the last of which delivers a fifth of the rows again; one run a session and input."""
    key = (spark.sparkContext.applicationId, sf, stages)
    if key not in _INGESTED:
        _INGESTED[key] = _ingest(spark, sf, stages)
    return _INGESTED[key]


def _ingest(spark, sf, stages):
    folder = scratch_folder(spark)
    files = files_a_batch(spark, sf, 2)
    raw = raw_events(spark, sf, 2 * files)
    land(raw, folder + "/in", 2 * files, dealt=True)
    land(raw_events(spark, sf, files).filter("process_id % 5 = 0"), folder + "/in", files, dealt=files > 1)
    stream = J.event_stream(spark, folder + "/in", raw.schema, max_files=files)
    hook = J.derived_stages(folder + "/stages", **SCAN, brute=BRUTE, beacon=BEACON, chains=CHAINS, as_of=AS_OF, buckets=4) if stages else None
    J.ingest(stream, folder + "/events", folder + "/cp", D.iocs(spark, sf), folder + "/hits", hook).awaitTermination()
    return folder


@query("str4_ingest_pipeline", with_ne("SELECT event_id, severity, timestamp FROM ne"))
def str4(spark, sf):
    return spark.read.parquet(ingested(spark, sf) + "/events").select("event_id", "severity", "timestamp")


@query("str4_assets", with_ne("SELECT * FROM assets", ASSETS))
def str4b(spark, sf):
    return J.derived_table(spark, ingested(spark, sf, True) + "/stages", "assets")


@query("str4_entities", with_ne("SELECT * FROM ents", *GRAPH))
def str4c(spark, sf):
    return J.derived_table(spark, ingested(spark, sf, True) + "/stages", "entities").select("id", "type", "name", "case_id", "created_at")


@query("str4_edges", with_ne("SELECT source_id, edge_type, target_id, event_id, created_at FROM edges", *GRAPH))
def str4d(spark, sf):
    return J.derived_table(spark, ingested(spark, sf, True) + "/stages", "edges").select("source_id", "edge_type", "target_id", "event_id", "created_at")


@query("str4_detections", with_ne("SELECT * FROM scans", SCAN_SQL))
def str4e(spark, sf):
    return J.derived_table(spark, ingested(spark, sf, True) + "/stages", "detections").filter("rule_id = 'corr-portscan'").select("src_ip", "window_start", "distinct_ports", "n_events", "first_event", "created_at")


@query("str4_correlations", REGISTRY.sql["cor7_run_all"])
def str4f(spark, sf):
    """What the correlation stage stored, repeats removed as of the same time and against the same history as cor7_run_all."""
    found = J.derived_table(spark, ingested(spark, sf, True) + "/stages", "detections")
    return C.suppress_repeats(found, found.filter(~F.col("rule_id").startswith("corr-chain-")), AS_OF).select("rule_id", "entity_key", "n_events", "created_at")


@query("str4_anomalies")
def str4g(spark, sf):
    """Score of every ingested event and the detection it made; random trees, so rows only, checked against a replay in the tests."""
    folder = ingested(spark, sf, True)
    found = J.derived_table(spark, folder + "/stages", "anomalies").select("event_id", F.col("id").alias("detection_id"), "rule_id", "severity")
    return spark.read.parquet(folder + "/events").select("event_id", "anomaly_score").join(found, "event_id", "left")


CLOSED = "(SELECT max(timestamp) - INTERVAL 10 MINUTE FROM ne {0})"


@query("str5_port_scans", with_ne(f"SELECT src_ip, window_start, distinct_ports, n_events FROM scans WHERE window_start + INTERVAL 1 DAY <= {CLOSED.format('WHERE dst_port IS NOT NULL')}", SCAN_SQL))
def str5(spark, sf):
    stream, folder = landed(spark, sf)
    return J.run_to_table(J.stream_port_scans(stream, **SCAN), folder + "/out", folder + "/cp")


@query("str5_brute_force", with_ne("SELECT src_ip, dst_ip, window_start, n_events FROM brutes WHERE window_start + INTERVAL 7 DAY <= "
       + CLOSED.format("WHERE event_outcome = 'failure'"), BRUTE_SQL))
def str5b(spark, sf):
    stream, folder = landed(spark, sf)
    return J.run_to_table(J.stream_brute_force(stream, **BRUTE), folder + "/out", folder + "/cp")


@query("str6_beacon_state", with_ne("""
SELECT src_ip, dst_ip, dst_port, count(*) AS n_intervals, round(avg(gap), 3) AS mean_interval, round(stddev_pop(gap), 3) AS stddev_interval FROM (
  SELECT src_ip, dst_ip, dst_port, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY timestamp)) / 1e6 AS gap
  FROM ne WHERE event_type IN ('conn', 'http') AND dst_port IS NOT NULL) WHERE gap IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 4 AND stddev_pop(gap) / avg(gap) < 0.9"""))
def str6(spark, sf):
    stream, folder = landed(spark, sf, batches=5)
    out = J.run_to_table(J.stream_beacons(stream, 4, 0.9, ttl_ms=40 * 86_400_000), folder + "/out", folder + "/cp", mode="update")
    return newest_batch(out, ["src_ip", "dst_ip", "dst_port"]).filter("regular").select("src_ip", "dst_ip", "dst_port", "n_intervals", F.round("mean_interval", 3).alias("mean_interval"), F.round("stddev_interval", 3).alias("stddev_interval"))


@query("str7_suppress_repeats", with_ne("SELECT DISTINCT 'corr-portscan' AS rule_id, src_ip AS entity_key FROM scans", SCAN_SQL))
def str7(spark, sf):
    folder = scratch_folder(spark)
    found = C.port_scans(events(spark, sf), **SCAN).select(*C.OUTPUT)
    found.write.parquet(folder + "/in")
    stream = J.event_stream(spark, folder + "/in", found.schema)
    return J.run_to_table(J.suppress(stream, "60 days"), folder + "/out", folder + "/cp").select("rule_id", "entity_key")


@query("str8_heartbeats", with_ne("SELECT source_type, epoch_us(max(timestamp)) // 1000 AS last_seen_ms, 'connected' AS status FROM ne GROUP BY 1"))
def str8(spark, sf):
    stream, folder = landed(spark, sf, batches=3)
    out = J.run_to_table(J.stream_heartbeats(stream, offline_after_ms=40 * 86_400_000), folder + "/out", folder + "/cp", mode="update")
    return newest_batch(out, ["source_type"]).filter("status = 'connected'")


@query("str9_periodic_privacy_scan", with_ne("SELECT event_id FROM ne WHERE event_type = 'http' AND http_request_body_len > 4096 AND regexp_matches(domain, '(^|\\.)tracker[02]\\.com$')"))
def str9(spark, sf):
    """The privacy scan as a micro-batch job over newly landed events."""
    stream, folder = landed(spark, sf)
    blocklist = spark.createDataFrame([(d,) for d in D.TRACKERS], "domain string")

    def scan(batch, batch_id):
        I.cookie_exfil(batch, blocklist).select("event_id").write.mode("append").parquet(folder + "/found")
    stream.writeStream.foreachBatch(scan).option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder + "/found")


TICKS = "ticks AS (SELECT least(4, (dayofyear(timestamp) - 1) // 6) AS k, max(timestamp) AS t FROM ne GROUP BY 1), spans AS (SELECT k, t, lag(t) OVER (ORDER BY k) AS earlier FROM ticks)"


def ticked(spark, sf, jobs, before=None):
    """Runs the jobs at the end of each of five micro-batches, every tick twice: the second must change nothing."""
    stream, folder = landed(spark, sf, batches=5)
    runner = T.Runner(spark, folder, jobs(folder))
    real = runner.tick
    runner.tick = lambda now: real(now) + real(now)
    T.on_event_time(stream, runner, folder + "/cp", before(folder) if before else None).awaitTermination()
    return folder


@query("str9_triage", with_ne(f"""SELECT id, t AS taken_at FROM (SELECT id, t, row_number() OVER (PARTITION BY k ORDER BY created_at DESC, id DESC) AS r
FROM det JOIN spans ON created_at <= t AND (earlier IS NULL OR created_at > earlier) WHERE triaged_at IS NULL) WHERE r <= 20""", D.DET, TICKS))
def str9b(spark, sf):
    folder = ticked(spark, sf, lambda f: [T.triage_job(spark, lambda: D.detections(spark, sf), f + "/triaged")])
    return spark.read.parquet(folder + "/triaged").select("id", "taken_at")


@query("str9_kpi_snapshot", with_ne("""SELECT CAST(CAST(t AS DATE) AS VARCHAR) AS snapshot_date, count(*) FILTER (created_at <= t) AS detection_count,
  count(*) FILTER (created_at <= t AND created_at > t - INTERVAL 24 HOUR) AS alert_volume FROM det, ticks GROUP BY t""", D.DET, TICKS))
def str9c(spark, sf):
    def compute(now):
        at = F.timestamp_micros(F.lit(round(now.timestamp() * 1_000_000)))
        det = D.detections(spark, sf).filter(F.col("created_at") <= at)
        return det.agg(F.count(F.lit(1)).alias("detection_count"), F.count_if(F.col("created_at") > at - F.expr("INTERVAL 24 HOURS")).alias("alert_volume")).withColumn("snapshot_date", F.to_date(at))
    folder = ticked(spark, sf, lambda f: [T.snapshot_job(compute, f + "/snapshots")])
    return spark.read.parquet(folder + "/snapshots").select(F.col("snapshot_date").cast("string"), "detection_count", "alert_volume")


@query("str9_daily", with_ne("""SELECT CAST(CAST(t AS DATE) AS VARCHAR) AS day, (SELECT count(*) FROM ne WHERE timestamp <= t AND timestamp >= t - INTERVAL 9 DAY) AS backed_up,
  (SELECT CAST(sum(greatest(0, confidence - k - 1)) AS BIGINT) FROM iocs) AS ioc_confidence FROM ticks""", D.IOCS, TICKS))
def str9d(spark, sf):
    """Days without a tick are made up for by one run; each run decays, purges to nine days and backs up."""
    def prepare(folder):
        D.iocs(spark, sf).withColumn("day", F.lit("2023-12-31").cast("date")).write.partitionBy("day").parquet(folder + "/iocs")
        return [T.daily_job(spark, folder + "/events", folder + "/backups", folder + "/iocs", 9)]

    folder = ticked(spark, sf, prepare, lambda folder: lambda batch, batch_id: append_events(batch, folder + "/events"))
    kept = spark.read.option("recursiveFileLookup", "true").parquet(folder + "/backups").groupBy(F.regexp_extract(F.input_file_name(), r"events_(\d{4}-\d\d-\d\d)", 1).alias("day")).agg(F.count(F.lit(1)).alias("backed_up"))
    sums = spark.read.parquet(folder + "/iocs").groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("confidence").cast("bigint").alias("ioc_confidence"))
    return kept.join(sums, "day").select("day", "backed_up", "ioc_confidence")
