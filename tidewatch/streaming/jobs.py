"""Structured Streaming forms of ingestion and detection. Cursors are checkpoints; watermarks replace fixed lookbacks."""
from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import _parse_datatype_string

from tidewatch.functions.scalars import stable_id
from tidewatch.functions.keyed import cut_lineage, newest_per_key, oldest_per_key
from tidewatch.operators.correlate import (BEACON_TYPES, CHUNK_KEY, FAILURE_KEY, OUTPUT, PAIR, PORT_KEY, PORT_SUMS, Chain, auth_failure, beacons_of, brute_of, chain_by_rules, chain_by_tactics, connection_chunks,
                                             failure_counts, merged_chunks, port_counts, scans_of, since, trimmed, with_moments)
from tidewatch.operators.graph import EDGE_KEY, extract_edges, extract_entities, first_edges, upsert_entities
from tidewatch.operators.intel import asset_mentions, ioc_hits, match_iocs, merge_assets
from tidewatch.operators.normalize import normalize
from tidewatch.operators.rules import anomaly_rules
from tidewatch.operators.scores import anomaly_detections, peer_features, score_new
from tidewatch.sources import logs, sensor  # noqa: F401  (they register their readers)
from tidewatch.sources.records import source
from tidewatch.sources.runs import IdIndex, RunTable, added_up, newest_version
from tidewatch.sources.sinks import append_events, stored_table


# ---- sources -----------------------------------------------------------------------------------------

def tail(spark: SparkSession, folder: str, kind: str, max_files: int | None = None, **reader_options) -> DataFrame:
    """New files of a folder as events; ``kind`` names a registered line reader (eve, firewall, osquery, ...)."""
    stream = spark.readStream.option("recursiveFileLookup", "true")
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    return source(kind)(stream.text(folder), **reader_options)


def tail_documents(spark: SparkSession, folder: str, max_files: int | None = 100) -> DataFrame:
    """Landed NDJSON of sensor documents (kind, value); the checkpoint is the pull cursor."""
    stream = spark.readStream.schema("kind string, value string")
    return sensor.sensor_events((stream.option("maxFilesPerTrigger", max_files) if max_files else stream).json(folder))


def event_stream(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


# ---- pipeline ------------------------------------------------------------------------------------------

def ingest(events: DataFrame, table: str, checkpoint: str, iocs: DataFrame, hits_folder: str | None = None,
           stages: Callable[[DataFrame, int], DataFrame | None] | None = None, available_now: bool = True, interval: str = "30 seconds") -> StreamingQuery:
    """normalize -> indicator match -> drop ids already stored -> append, per micro-batch.

    Known ids are looked up in an index beside the table (:class:`~tidewatch.sources.runs.IdIndex`), never in the table. ``stages`` gets
    the new rows of the batch and its number before they are stored: what it writes by number is complete once the rows are. Rows it
    returns are stored in their place. A replayed batch whose rows are stored does nothing; one that stopped before or while they were is
    run again, and only in that case the ids of the days it has are read from the table, to store just the missing rows.
    """
    spark = events.sparkSession
    index = IdIndex(spark, f"{table.rstrip('/')}_ids")
    index.cover(stored_table(spark, table))

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        number = index.number(spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch", batch_id)
        status = index.status(number)
        if status == "done":
            return
        index.compact(number)
        matched = cut_lineage(match_iocs(normalize(batch), iocs).withColumn("_row", F.monotonically_increasing_id()))
        fresh = cut_lineage(matched.join(later_copies(matched), "_row", "left_anti").join(index.known(matched, number), "event_id", "left_anti").select(*batch.columns))
        stored = None
        if status == "begun" and (old := stored_table(spark, table)) is not None:
            days = fresh.select(F.to_date("timestamp").alias("event_date")).distinct()
            stored = cut_lineage(old.join(F.broadcast(days) if days.count() <= MAX_DAYS else days, "event_date", "left_semi").select("event_id").join(fresh.select("event_id"), "event_id", "left_semi"))
        index.begin(number, fresh)
        if hits_folder:
            new_hits = ioc_hits(matched).join(fresh.select("event_id"), "event_id", "left_semi")
            new_hits.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(hits_folder)
        staged = stages(fresh, number) if stages else None
        rows = fresh if staged is None else staged.select(*batch.columns)
        append_events(rows if stored is None else rows.join(stored, "event_id", "left_anti").select(*batch.columns), table)
        index.finish(number)

    writer = events.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def later_copies(rows: DataFrame) -> DataFrame:
    """(_row) of all but the first delivery of each id. Stored by itself: copies are few as a rule, so that leaving them out moves no wide row."""
    best = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ingested_at", "timestamp", "_row")).alias("first")).filter("n > 1")
    return cut_lineage(rows.select("event_id", "_row").join(best, "event_id").filter(F.col("_row") != F.col("first._row")).select("_row"))


MAX_DAYS = 100_000
DETECTION = {**dict.fromkeys(OUTPUT, "string"), "n_events": "bigint", "created_at": "timestamp", "src_ip": "string", "dst_ip": "string", "dst_port": "int", "window_start": "timestamp", "distinct_ports": "bigint",
             "first_event": "timestamp", "mean_interval": "double", "stddev_interval": "double", "suppressed": "boolean", "retracted": "boolean"}


def _detection_rows(*parts: DataFrame) -> DataFrame:
    """Rows of several detectors in the columns of :data:`DETECTION`, null where a detector has none."""
    rows = [p.select(*[F.col(c).cast(t) if c in p.columns else F.lit(None).cast(t).alias(c) for c, t in DETECTION.items()]) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _unretracted(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("retracted"))


def _add(old: DataFrame | None, new: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return new if old is None else merge(old.unionByName(new))


add_ports, add_failures = added_up(PORT_KEY, *PORT_SUMS), added_up(FAILURE_KEY, *PORT_SUMS)


class StageTables:
    """What the stages of :func:`ingest` keep over batches, as run tables: every batch writes its own share and reads just the buckets of
    the keys it touches."""

    def __init__(self, spark: SparkSession, folder: str, fresh: DataFrame | None = None, buckets: int = 16, fan_in: int = 8):
        """``fresh`` gives the columns where they follow from those of events; without it they are read from the files."""
        def table(name: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], rows: Callable[[DataFrame], DataFrame] | str) -> RunTable:
            schema = _parse_datatype_string(rows) if isinstance(rows, str) else rows(fresh).schema if fresh is not None else None
            return RunTable(spark, f"{folder}/{name}", keys, merge, schema, buckets, fan_in)
        counts = "n_events bigint, first_event timestamp, created_at timestamp"
        self.ports = table("ports", ["src_ip"], add_ports, f"src_ip string, window_start timestamp, dst_port int, {counts}")
        self.failures = table("failures", ["src_ip"], add_failures, f"src_ip string, dst_ip string, window_start timestamp, {counts}")
        self.chunks = table("connections", ["src_ip"], newest_version(CHUNK_KEY), "src_ip string, dst_ip string, dst_port int, chunk timestamp, instants array<bigint>, n bigint, first bigint, last bigint, mean double, m2 double")
        self.clock = table("clock", [], added_up([], [], [], ["newest"]), "newest timestamp")
        self.detections = table("detections", ["entity_key"], newest_version(["id"]), ", ".join(f"{c} {t}" for c, t in DETECTION.items()))
        self.anomaly_state = table("anomaly_state", ["subnet", "process"], newest_version(["subnet", "process"]), lambda f: score_new(f, None)[1])
        self.assets = table("assets", ["ip"], added_up(["ip"], [], ["first_seen"], ["last_seen", "named"]), asset_mentions)
        self.entities = table("entities", ["id"], lambda rows: newest_per_key(rows, ["id"], ["timestamp", "event_id"]).drop("_version"), extract_entities)
        self.edges = table("edges", EDGE_KEY, lambda rows: oldest_per_key(rows, EDGE_KEY, ["timestamp", "event_id"]).drop("_version"), extract_edges)
        self.all = [self.ports, self.failures, self.chunks, self.clock, self.detections, self.anomaly_state, self.assets, self.entities, self.edges]

    def compact(self, before: int) -> None:
        for table in self.all:
            table.compact(before)


def correlate_batch(fresh: DataFrame, tables: StageTables, number: int, scan: dict, brute: dict, beacon: dict, chains: list[Chain],
                    as_of: str | None = None, suppress_minutes: int = 60) -> DataFrame:
    """Detections that the new rows make, change or end, over the keys they touch: the parts of :func:`~tidewatch.operators.correlate.run_all` on one micro-batch.

    Windows split over batches are counted whole from added-up counts, and a beacon from the moments of all chunks of its pair; the
    event table is not read. Of the instants only those of chunks with new ones are. A beacon that new rows make irregular is written
    with ``retracted``. Chains are looked for among all detections of the entities with a new detection, those of this batch included.
    ``suppressed`` marks a detection whose (rule, entity) an earlier batch reported within the last ``suppress_minutes`` as another
    detection; it stays evidence for chains. Without ``as_of`` the clock is the newest time seen, and a chain found once stays unless it may
    rest on a beacon since retracted; at a fixed ``as_of`` it stays as long as it holds as of then.
    """
    spark = fresh.sparkSession
    sources = cut_lineage(fresh.filter("src_ip IS NOT NULL").select("src_ip").distinct())
    entities = sources.withColumnRenamed("src_ip", "entity_key")
    history = tables.detections.rows(number, entities)
    history = cut_lineage(_unretracted(history)) if history is not None else spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in DETECTION.items()))
    window, failures, chunk = scan.get("window", "60 seconds"), brute.get("window", "60 seconds"), beacon.get("chunk", "hour")

    def whole(new: DataFrame, table: RunTable, keys: list[str], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """New and stored counts of the windows that new rows fall into; the new ones are written."""
        new = cut_lineage(new)
        table.write(number, new)
        old = table.rows(number, sources)
        touched = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        return new if old is None else _add(old.join(touched, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi"), new, merge)

    ports = whole(port_counts(fresh, window), tables.ports, ["src_ip", "window_start"], add_ports)
    failed = whole(failure_counts(fresh, failures), tables.failures, FAILURE_KEY, add_failures)
    new_chunks, known_chunks = connection_chunks(fresh, chunk), tables.chunks.rows(number, sources)
    if known_chunks is not None:
        again = known_chunks.join(new_chunks.select(*CHUNK_KEY), CHUNK_KEY, "left_semi").select(*CHUNK_KEY, "instants")
        new_chunks = merged_chunks(new_chunks.unionByName(again))
    new_chunks = cut_lineage(with_moments(new_chunks))
    tables.chunks.write(number, new_chunks)
    pairs = new_chunks.select(*PAIR).distinct()
    chunks = new_chunks
    if known_chunks is not None:
        chunks = new_chunks.unionByName(known_chunks.join(pairs, PAIR, "left_semi").select(*new_chunks.columns).join(new_chunks.select(*CHUNK_KEY), CHUNK_KEY, "left_anti").select(*new_chunks.columns))
    if beacon.get("as_of") and beacon.get("lookback"):
        chunks = trimmed(chunks, beacon["as_of"], beacon["lookback"], chunk)
    limits = {k: v for k, v in beacon.items() if k in ("min_intervals", "max_cv")}
    found = cut_lineage(_detection_rows(scans_of(ports, window, scan.get("min_ports", 15)), brute_of(failed, failures, brute.get("min_failures", 10)), beacons_of(chunks, **limits)))
    lost = history.filter("rule_id = 'corr-beacon'").join(pairs, PAIR, "left_semi").join(found, "id", "left_anti").select(*history.columns)
    entities = found.select("entity_key").union(lost.select("entity_key")).distinct()
    known = history.join(entities, "entity_key", "left_semi").join(found.select("id").union(lost.select("id")), "id", "left_anti").select(*DETECTION).unionByName(found)
    seen = fresh.agg(F.max("timestamp").alias("newest"))
    tables.clock.write(number, seen)
    if as_of is None:
        clock = tables.clock.rows(number)
        now = (seen if clock is None else seen.unionByName(clock)).agg(F.max("newest").cast("string")).first()[0]
    else:
        now = as_of
    changed, ended = [found], [lost]
    for chain in chains if now is not None else []:
        parts = [chain_by_rules(known, chain, now)] if chain.rule_ids else []
        parts += [chain_by_tactics(known, chain, now)] if len(chain.rule_tactics) >= 2 else []
        if not parts:
            continue
        rows = _detection_rows(*parts)
        gone = history.filter(F.col("rule_id") == f"corr-chain-{chain.name}").join(entities, "entity_key", "left_semi").join(rows, "id", "left_anti")
        if as_of is None:
            gone = gone.filter(since("created_at", now, chain.window)).join(lost, "entity_key", "left_semi") if "corr-beacon" in chain.rule_ids or "command-and-control" in chain.rule_tactics else None
        changed.append(rows)
        ended += [] if gone is None else [gone.select(*history.columns)]
    live = history.filter(~F.col("suppressed"))
    recent = live.filter(F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {suppress_minutes} MINUTES")) \
        .groupBy("rule_id", "entity_key").agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    earlier = live.select("id", F.lit(True).alias("_reported"))
    out = _detection_rows(*changed).join(recent, ["rule_id", "entity_key"], "left").join(earlier, "id", "left") \
        .withColumn("suppressed", F.col("_reported").isNull() & F.coalesce((F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id")), F.lit(False))).withColumn("retracted", F.lit(False))
    return cut_lineage(_detection_rows(out, *[e.withColumn("retracted", F.lit(True)) for e in ended]))


def derived_stages(folder: str, window: str = "60 seconds", min_ports: int = 15, brute: dict | None = None, beacon: dict | None = None,
                   chains: list[Chain] | None = None, as_of: str | None = None, suppress_minutes: int = 60,
                   anomaly: dict | None = None, threshold: float = 0.7, buckets: int = 16, fan_in: int = 8) -> Callable[[DataFrame, int], DataFrame]:
    """The ``stages`` of :func:`ingest`: assets, anomalies, graph and correlation of each micro-batch.

    New rows get the score of their peer group's half-space trees (:func:`~tidewatch.operators.scores.score_new`, ``anomaly`` its sizes) and are
    returned with it; scores above ``threshold`` make a detection. The state of a group is what the last batch that touched it wrote. The fixed rules are written beside.

    What is kept below ``folder`` are run tables (:class:`StageTables`), of which a batch reads the buckets of its own keys; a replayed batch
    overwrites its own run. Anomalies and rule hits are plain results by batch. A batch without new rows writes nothing.
    """
    def run(fresh: DataFrame, number: int) -> DataFrame:
        spark = fresh.sparkSession
        if fresh.isEmpty():
            return fresh
        tables = StageTables(spark, folder, fresh, buckets, fan_in)
        tables.compact(number)
        scores, state = score_new(fresh, tables.anomaly_state.rows(number, peer_features(fresh).select("subnet", "process").distinct()), **(anomaly or {}))
        scores, state = cut_lineage(scores), cut_lineage(state)
        tables.anomaly_state.write(number, state)
        tables.detections.write(number, correlate_batch(fresh, tables, number, dict(window=window, min_ports=min_ports), brute or {}, beacon or {}, chains or [], as_of, suppress_minutes))
        tables.assets.write(number, asset_mentions(fresh))
        tables.entities.write(number, newest_per_key(extract_entities(fresh), ["id"], ["timestamp", "event_id"]))
        tables.edges.write(number, oldest_per_key(extract_edges(fresh), EDGE_KEY, ["timestamp", "event_id"]))
        results = {"anomaly_rules": fresh.select("event_id", anomaly_rules().alias("rules")).filter(F.size("rules") > 0), "anomalies": anomaly_detections(scores, threshold)}
        for name, rows in results.items():
            rows.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{folder}/{name}")
        return fresh.drop("anomaly_score").join(scores.select("event_id", "anomaly_score"), "event_id", "left").select(*fresh.columns)

    return run


def derived_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What the stages of all batches add up to: equal to the batch operator over all stored events."""
    if name in ("anomalies", "anomaly_rules"):
        return spark.read.parquet(f"{folder}/{name}").drop("batch_id")
    rows = getattr(StageTables(spark, folder), name).rows()
    if name == "detections":
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in DETECTION.items())).drop("retracted") if rows is None else _unretracted(rows).drop("retracted")
    if rows is None:
        raise ValueError(f"no batch has written {name}")
    return {"assets": merge_assets, "entities": upsert_entities, "edges": first_edges}.get(name, lambda r: r)(rows)


# ---- windowed detectors ---------------------------------------------------------------------------------

def stream_port_scans(events: DataFrame, window: str = "60 seconds", min_ports: int = 15, delay: str = "10 minutes") -> DataFrame:
    """Port scans per closed window. The set of ports is bounded by the port range."""
    return (events.filter("src_ip IS NOT NULL AND dst_port IS NOT NULL").withWatermark("timestamp", delay)
            .groupBy(F.window("timestamp", window).alias("w"), "src_ip")
            .agg(F.size(F.collect_set("dst_port")).alias("distinct_ports"), F.count(F.lit(1)).alias("n_events"))
            .filter(F.col("distinct_ports") >= min_ports)
            .select(F.col("w.start").alias("window_start"), "src_ip", "distinct_ports", "n_events"))


def stream_brute_force(events: DataFrame, window: str = "60 seconds", min_failures: int = 10, delay: str = "10 minutes") -> DataFrame:
    return (events.filter(F.col("src_ip").isNotNull() & auth_failure()).withWatermark("timestamp", delay)
            .groupBy(F.window("timestamp", window).alias("w"), "src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("n_events"))
            .filter(F.col("n_events") >= min_failures).select(F.col("w.start").alias("window_start"), "src_ip", "dst_ip", "n_events"))


def suppress(detections: DataFrame, window: str = "60 minutes") -> DataFrame:
    """First detection per (rule, entity) within the window passes."""
    return detections.withWatermark("created_at", window).dropDuplicatesWithinWatermark(["rule_id", "entity_key"])


# ---- keyed state -------------------------------------------------------------------------------------------

BEACON_OUT = "src_ip string, dst_ip string, dst_port int, n_intervals bigint, mean_interval double, stddev_interval double, regular boolean"


def stream_beacons(events: DataFrame, min_intervals: int = 19, max_cv: float = 0.3, ttl_ms: int = 7_200_000, delay: str = "10 minutes") -> DataFrame:
    """Running count, mean and spread of the gaps per (source, target, port), and whether they are regular; one row a key and micro-batch.

    The newest row of a key holds and counts every instant admitted so far. Instants that the watermark has passed are folded into four numbers;
    newer ones (eight bytes each) are held in state and ordered among those of later micro-batches, which may still come in between. State
    expires when event time has moved on by ``ttl_ms``.
    """
    conns = events.filter(F.col("event_type").isin(BEACON_TYPES) & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull() & F.col("dst_port").isNotNull()) \
        .withWatermark("timestamp", delay).select("src_ip", "dst_ip", "dst_port", "timestamp", F.unix_micros("timestamp").alias("t"))

    def folded(moments: tuple, t: np.ndarray) -> tuple:
        last, n, mean, m2 = moments
        if not len(t):
            return moments
        gaps = np.diff(t if last is None else np.concatenate([[last], t])) / 1e6
        if len(gaps):  # merge two samples' moments
            k, gm = len(gaps), float(gaps.mean())
            m2 += float(((gaps - gm) ** 2).sum()) + (gm - mean) ** 2 * n * k / (n + k)
            mean += (gm - mean) * k / (n + k)
            n += k
        return int(t[-1]), n, mean, m2

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        *moments, held = state.get if state.exists else (None, 0, 0.0, 0.0, b"")
        parts = [np.frombuffer(held, dtype=np.int64)] + ([] if state.hasTimedOut else [pdf["t"].to_numpy() for pdf in batches])
        t = np.sort(np.concatenate(parts))
        passed = int(np.searchsorted(t, watermark * 1000, side="right"))       # a later micro-batch brings nothing up to here
        moments, t = folded(tuple(moments), t[:passed]), t[passed:]
        total = folded(moments, t)
        expiry = total[0] // 1000 + ttl_ms
        if state.hasTimedOut and expiry <= watermark:
            state.remove()
            return
        state.update((*moments, t.tobytes()))
        state.setTimeoutTimestamp(max(min(expiry, int(t[-1]) // 1000 + 1) if len(t) else expiry, watermark + 1))
        if state.hasTimedOut:
            return
        _, n, mean, m2 = total
        spread = (m2 / n) ** 0.5 if n else 0.0
        yield pd.DataFrame({"src_ip": pd.Series([key[0]], dtype=object), "dst_ip": pd.Series([key[1]], dtype=object), "dst_port": [key[2]], "n_intervals": [n],
                            "mean_interval": [mean], "stddev_interval": [spread], "regular": [bool(n >= min_intervals and mean > 0 and spread / mean < max_cv)]})

    return conns.groupBy("src_ip", "dst_ip", "dst_port").applyInPandasWithState(
        fold, BEACON_OUT, "last bigint, n bigint, mean double, m2 double, held binary", "update", GroupStateTimeout.EventTimeTimeout)


def stream_heartbeats(events: DataFrame, offline_after_ms: int = 300_000, delay: str = "1 minute") -> DataFrame:
    """``connected`` with the newest event time when a source sends, ``offline`` when event time moves on without it.

    Only the newest beat that a task has of a source goes on to the source's state: there are few sources and many events.
    """
    def newest_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = (rows if held is None else pa.concat_tables([held, rows])).group_by("source_type").aggregate([("timestamp", "max"), ("ms", "max")]).select(["source_type", "timestamp_max", "ms_max"]).rename_columns(["source_type", "timestamp", "ms"])
        if held is not None:
            yield from held.to_batches()

    sent = events.filter("source_type IS NOT NULL").select("source_type", "timestamp", F.unix_millis("timestamp").alias("ms"))
    beats = sent.mapInArrow(newest_of_each, sent.schema).withWatermark("timestamp", delay)

    def watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(seen: int, status: str) -> pd.DataFrame:
            return pd.DataFrame({"source_type": pd.Series([key[0]], dtype=object), "last_seen_ms": [seen], "status": pd.Series([status], dtype=object)})
        if state.hasTimedOut:
            seen = state.get[0]
            state.remove()
            yield row(seen, "offline")
            return
        newest = max(int(pdf["ms"].max()) for pdf in batches)
        seen = max(newest, state.get[0] if state.exists else 0)
        state.update((seen,))
        state.setTimeoutTimestamp(max(seen + offline_after_ms, state.getCurrentWatermarkMs() + 1))
        yield row(seen, "connected")

    return beats.groupBy("source_type").applyInPandasWithState(
        watch, "source_type string, last_seen_ms bigint, status string", "seen bigint", "update", GroupStateTimeout.EventTimeTimeout)


# ---- running ----------------------------------------------------------------------------------------------------

def run_to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is available into Parquet and return it; non-append modes write each batch's rows."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(folder)
        query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    schema = stream.schema if mode == "append" else stream.schema.add("batch_id", "long")
    return spark.read.schema(schema).parquet(folder)


def relay_to_days(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Sensor documents as gzip JSON day files."""
    out = logs.relay_documents(lines).withColumn("day", F.substring("timestamp", 1, 10))
    return out.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).option("compression", "gzip") \
              .partitionBy("day").trigger(availableNow=True).start()
