"""Event clustering by shared entities and by time, causal chains and their scores."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.keyed import cut_lineage
from tidewatch.functions.postings import Postings, store_postings
from tidewatch.functions.scalars import canonical_id, parse_once
from tidewatch.operators.rules import map_techniques
from tidewatch.schema import CHAIN_SEVERITY_POINTS, lookup


# ---- shared-entity clusters ---------------------------------------------------------------------

def entity_array(kinds: tuple[str, ...] = ("host", "user", "proc", "ip", "domain"), scope: Column | None = None) -> Column:
    """Sorted distinct entity ids of one event. ``scope`` (e.g. an hour or a case) keeps entities apart between scopes."""
    def present(name: str) -> Column:
        return F.col(name).isNotNull() & (F.col(name) != "")
    host = F.when(present("hostname"), F.lower("hostname")).otherwise("unknown")
    parts = {
        "host": F.when(present("hostname"), F.concat(F.lit("host:"), F.lower("hostname"))),
        "user": F.when(present("username"), F.concat(F.lit("user:"), F.lower("username"))),
        "proc": F.when(present("process_name") & F.col("process_id").isNotNull(),
                       F.concat(F.lit("proc:"), host, F.lit(":"), F.col("process_id").cast("string"))),
        "ip": F.when(present("dst_ip"), F.concat(F.lit("ip:"), "dst_ip")),
        "domain": F.when(present("domain"), F.concat(F.lit("domain:"), F.lower("domain"))),
    }
    ids = F.array_compact(F.array(*[parts[k] for k in kinds]))
    if scope is not None:
        ids = F.transform(ids, lambda e: F.concat(scope.cast("string"), F.lit("/"), e))
    return F.array_sort(F.array_distinct(ids))


def incidence(events: DataFrame, entities: Column | None = None) -> DataFrame:
    """(event_id, entity) rows."""
    return events.select("event_id", F.explode(entities if entities is not None else entity_array()).alias("entity"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, label): label is the smallest node of the component.

    Alternating large-star and small-star rounds. Each round costs shuffles linear in the edges, never emits node pairs
    inside a component, and converges in about log(n) rounds; state is checkpointed so lost executors do not replay the loop.
    """
    def both_ways(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large_star(e: DataFrame) -> DataFrame:
        sym = both_ways(e)
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return sym.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        rest = down.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return rest.unionByName(low.select("a", F.col("m").alias("b"))).distinct()

    current = cut_lineage(edges.toDF("a", "b").filter("a <> b").distinct())
    for _ in range(max_rounds):
        previous, current = current, cut_lineage(small_star(large_star(current)))
        if current.count() == previous.count() and current.join(previous, ["a", "b"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError("components did not converge; raise max_rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


def cluster_events(events: DataFrame, entities: Column | None = None) -> DataFrame:
    """(event_id, cluster_id, entities) for clusters of two or more events connected by shared entities.

    Components run over entities, not events: each event links its first entity to its others, so the graph has one
    edge per distinct entity pair that meets in an event and no event pairs are built.
    """
    # Entities are made once a row, on dealt rows, and stored, as they are joined and counted several times.
    tagged = cut_lineage(parse_once(events, entities if entities is not None else entity_array(), "_made")       # events may have entities of their own
                         .select("event_id", "timestamp", F.col("_made").alias("entities"))
                         .filter(F.size("entities") > 0).withColumn("anchor", F.col("entities")[0]))
    edges = tagged.select(F.col("anchor").alias("a"), F.explode(F.slice("entities", 2, F.size("entities"))).alias("b")).distinct()
    labels = connected_components(edges)
    placed = cut_lineage(tagged.join(labels, F.col("anchor") == F.col("node"), "left")
                         .withColumn("cluster_id", F.coalesce("label", "anchor")).drop("node", "label", "anchor"))
    big = placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_events")).filter("n_events > 1")
    return placed.join(big, "cluster_id")


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """Size, shared entities, relatedness (shared / all) and time range per cluster.

    An entity is shared when it occurs in as many events as the cluster has.
    """
    per_entity = clustered.select("cluster_id", "n_events", F.explode("entities").alias("entity")) \
        .groupBy("cluster_id", "n_events", "entity").agg(F.count(F.lit(1)).alias("hits"))
    overlap = per_entity.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.sort_array(F.collect_list(F.when(F.col("hits") == F.col("n_events"), F.col("entity")))).alias("shared_entities"))
    span = clustered.groupBy("cluster_id", "n_events").agg(F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"))
    return span.join(overlap, "cluster_id").withColumn(
        "relatedness", F.round(F.size("shared_entities") / F.col("n_entities"), 3))


# ---- time clusters ---------------------------------------------------------------------------------

def chunk_transfer(t: np.ndarray, start: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What a chunk of sorted instants, none before ``start``, does to the cluster start that is carried into it: (entries, exits).

    A carried start covers instants up to ``width`` later; the first one beyond begins a cluster, and so on to the chunk's last
    start. Only instants within ``width`` of the chunk's start, and the next one, can be that first one. Entries with one exit are
    kept as their last, so chains that run together, as they soon do, leave few rows.
    """
    n = len(t)
    onward = np.append(np.searchsorted(t, t + width, side="right"), n)
    entry = np.arange(min(n, int(np.searchsorted(t, start + width, side="right")) + 1))
    last, here = entry.copy(), onward[entry]
    while (here < n).any():                              # as many steps as windows fit into the chunk
        last, here = np.where(here < n, here, last), onward[here]
    keep = np.append(last[1:] != last[:-1], True) if len(last) else np.zeros(0, dtype=bool)
    return t[entry[keep]], t[last[keep]]


def temporal_cluster_members(events: DataFrame, window_minutes: int = 5, hostname: str | None = None,
                             case_id: str | None = None, chunk_windows: int = 12) -> DataFrame:
    """(event_id, host, timestamp, cluster_start): a cluster takes events up to ``window_minutes`` after its first event.

    The sequential rule is solved without walking a host's events in one task: time is cut into chunks of ``chunk_windows`` windows,
    the instants of a (host, chunk) are brought together once, and each chunk gives its transfer from the start carried in to the one
    carried out (:func:`chunk_transfer`). The transfers of a host, a few numbers a chunk, are applied in order, streamed; with its
    entry known every chunk then marks its own starts.
    """
    scope = events.filter(F.col("timestamp").isNotNull())
    if hostname:
        scope = scope.filter(F.col("hostname") == hostname)
    if case_id:
        scope = scope.filter(F.col("case_id") == case_id)
    width = window_minutes * 60_000_000
    length = width * chunk_windows
    rows = scope.select("event_id", F.coalesce("hostname", F.lit("unknown")).alias("host"), "timestamp",
                        F.unix_micros("timestamp").alias("t")).withColumn("slot", F.floor(F.col("t") / width))
    instants = cut_lineage(rows.groupBy("host", F.floor(F.col("t") / length).alias("chunk")).agg(F.sort_array(F.collect_set("t")).alias("t")))

    def transfers(batches):
        for batch in batches:
            found = [chunk_transfer(np.asarray(t, dtype=np.int64), c * length, width) for c, t in zip(batch.column("chunk").to_pylist(), batch.column("t").to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("chunk"), pa.array([e for e, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.int64()))],
                                             ["host", "chunk", "entries", "exits"])

    def compose(batches):
        host, carried = None, None
        for batch in batches:
            out = []
            for name, entries, exits in zip(batch.column("host").to_pylist(), batch.column("entries").to_numpy(zero_copy_only=False), batch.column("exits").to_numpy(zero_copy_only=False)):
                if name != host:
                    host, carried = name, None
                out.append(carried)
                at = 0 if carried is None else int(np.searchsorted(entries, carried + width, side="right"))
                if at < len(exits):                      # else all instants belong to the carried start
                    carried = int(exits[at])
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("chunk"), pa.array(out, pa.int64())], ["host", "chunk", "carried"])

    def mark(batches):
        for batch in batches:
            host, start = [], []
            for name, carried, t in zip(batch.column("host").to_pylist(), batch.column("carried").to_pylist(), batch.column("t").to_numpy(zero_copy_only=False)):
                at = 0 if carried is None else int(np.searchsorted(t, carried + width, side="right"))
                while at < len(t):
                    host.append(name)
                    start.append(int(t[at]))
                    at = int(np.searchsorted(t, t[at] + width, side="right"))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(start, pa.int64())], ["host", "own"])

    moves = instants.mapInArrow(transfers, "host string, chunk bigint, entries array<bigint>, exits array<bigint>")
    carried = moves.repartition("host").sortWithinPartitions("host", "chunk").mapInArrow(compose, "host string, chunk bigint, carried bigint")
    starts = cut_lineage(instants.join(carried, ["host", "chunk"]).mapInArrow(mark, "host string, own bigint"))
    # A slot is one window wide, so it holds at most one start; an event belongs to its own slot's or the previous one's.
    placed = starts.withColumn("slot", F.floor(F.col("own") / width))
    before = placed.select("host", (F.col("slot") + 1).alias("slot"), F.col("own").alias("earlier"))
    return rows.join(placed, ["host", "slot"], "left").join(before, ["host", "slot"], "left").select(
        "event_id", "host", "timestamp",
        F.timestamp_micros(F.when(F.col("own") <= F.col("t"), F.col("own")).otherwise(F.col("earlier"))).alias("cluster_start"))


def temporal_clusters(members: DataFrame) -> DataFrame:
    """Clusters of two or more events with their density score."""
    seconds = (F.unix_micros("last_event") - F.unix_micros("cluster_start")) / 1e6
    return (members.groupBy("host", "cluster_start").agg(F.count(F.lit(1)).alias("n_events"), F.max("timestamp").alias("last_event"))
            .filter("n_events > 1")
            .withColumn("relatedness", F.round(F.least(F.lit(1.0), F.col("n_events") / (F.greatest(F.lit(1.0), seconds) / 60 + 1)), 3)))


def correlate_events(events: DataFrame, window_minutes: int = 10, entities: Column | None = None) -> DataFrame:
    """Both clusterings in one list."""
    shared = cluster_stats(cluster_events(events, entities)).select(
        F.lit("shared_entity").alias("cluster_type"), F.col("cluster_id").alias("key"), "n_events", "first_event", "last_event", "relatedness")
    timed = temporal_clusters(temporal_cluster_members(events, window_minutes)).select(
        F.lit("temporal"), F.concat(F.lit("host:"), F.lower("host")), "n_events", "cluster_start", "last_event", "relatedness")
    return shared.union(timed)


# ---- causal chains ----------------------------------------------------------------------------------

CAUSAL_KINDS = {"host": "hostname", "user": "username", "process": "process_name", "ip_src": "src_ip", "ip_dst": "dst_ip", "domain": "domain"}


def causal_ids() -> Column:
    return F.array_distinct(F.array_compact(F.array(*[canonical_id(k, F.col(c)) for k, c in CAUSAL_KINDS.items()])))


def store_causal_index(events: DataFrame, folder: str, buckets: int = 256) -> Postings:
    """Events by canonical id, in time order; each posting carries all ids of its event, so that a chain needs no event row."""
    tagged = events.select("event_id", "timestamp", causal_ids().alias("ids"))
    return store_postings(tagged.select(F.explode("ids").alias("entity"), "timestamp", "event_id", "ids"), "entity", ["timestamp", "event_id"], folder, buckets)


def causal_chain(events: DataFrame, start_event: str, max_depth: int = 5, max_events: int = 50, index: Postings | None = None) -> DataFrame:
    """(event_id, depth): events reached from ``start_event`` over shared canonical ids, nearest and oldest first.

    The feature caps the chain at ``max_events``, so a level keeps at most that many ids; only those few travel through
    the driver. With an index a level reads the buckets of its ids, without one it is a filtered top-k over all events.
    """
    spark = events.sparkSession
    # Ids behind a one-row explode: computed once a row, and where the rows have been dealt to, not in the few tasks that read the files.
    tagged = parse_once(events, causal_ids(), "_made").select("event_id", "timestamp", F.col("_made").alias("ids"))
    found: list[tuple[str, int]] = []
    seen: set[str] = set()
    frontier = tagged.filter(F.col("event_id") == start_event).select("event_id", "ids").limit(1).collect()
    depth = 0
    while frontier and len(found) < max_events:
        found += [(r["event_id"], depth) for r in frontier]
        seen.update(r["event_id"] for r in frontier)
        if depth == max_depth or len(found) >= max_events:
            break
        keys = sorted({k for r in frontier for k in r["ids"]})
        room = max_events - len(found)
        if index is not None:
            linked, most = index.rows_of(spark, keys), room * len(CAUSAL_KINDS)  # an event has a posting an id, one a kind at most
        else:
            linked, most = tagged.filter(F.arrays_overlap("ids", F.array(*[F.lit(k) for k in keys]))), room
        nearest = linked.filter(~F.col("event_id").isin(sorted(seen))).orderBy("timestamp", "event_id").select("event_id", "ids").limit(most).collect()
        frontier = list({r["event_id"]: r for r in nearest}.values())[:room]
        depth += 1
    return spark.createDataFrame(found, "event_id string, depth int")


def score_chains(chain_events: DataFrame, alerts: DataFrame, techniques: DataFrame) -> DataFrame:
    """0-100 score per chain from the worst alert, distinct techniques, length, and an entity that recurs in 3+ events.

    Inputs are keyed by ``chain_id``: ``chain_events`` with the event columns, ``alerts`` with severity, ``techniques``.
    """
    length = chain_events.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_events"))
    repeats = chain_events.select("chain_id", "event_id", F.explode(causal_ids()).alias("entity")) \
        .groupBy("chain_id", "entity").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("chain_id").agg(F.max(F.col("n") >= 3).alias("recurs"))
    points = F.coalesce(lookup(CHAIN_SEVERITY_POINTS, F.lower("severity")), F.lit(0))
    worst = alerts.groupBy("chain_id").agg(F.max(points).alias("severity_points"))
    named = techniques.filter(F.col("technique").isNotNull() & (F.col("technique") != "")) \
        .groupBy("chain_id").agg(F.count_distinct("technique").alias("n_techniques"))
    joined = length.join(repeats, "chain_id", "left").join(worst, "chain_id", "left").join(named, "chain_id", "left")
    return joined.select("chain_id", "n_events", F.least(
        F.lit(100),
        F.coalesce("severity_points", F.lit(0)) + F.least(F.coalesce("n_techniques", F.lit(0)) * 5, F.lit(20))
        + F.least(F.col("n_events") * 2, F.lit(20)) + F.when(F.col("recurs"), 20).otherwise(0)).cast("int").alias("score"))


def causality(events: DataFrame, detections: DataFrame, links: DataFrame, detection_id: str, max_depth: int = 5,
              max_events: int = 50, index: Postings | None = None) -> DataFrame:
    """One row for a detection: chain size, alerts in the chain, techniques, score, time bounds.

    Techniques are the catalog's for the detection's tag; without one, those that the type of the triggering event or the
    detection's text stand for.
    """
    trigger = links.filter(F.col("detection_id") == detection_id).join(events.select("event_id", "timestamp"), "event_id") \
        .agg(F.min_by("event_id", F.struct("timestamp", "event_id")).alias("event_id")).first()["event_id"]
    chain = causal_chain(events, trigger, max_depth, max_events, index)
    in_chain = events.join(chain, "event_id").withColumn("chain_id", F.lit(detection_id))
    touching = links.join(chain.select("event_id"), "event_id", "left_semi").select(F.col("detection_id").alias("id")).distinct()
    alerts = detections.join(touching, "id", "left_semi").withColumn("chain_id", F.lit(detection_id))
    kind = events.filter(F.col("event_id") == trigger).select("event_type").first()
    tag = F.when(F.coalesce("attack_technique", F.lit("")) != "", F.array(F.concat(F.lit("attack."), F.lower("attack_technique")))).otherwise(F.array().cast("array<string>"))
    text = F.lower("explanation") if "explanation" in detections.columns else F.lit("")
    alert = detections.filter(F.col("id") == detection_id).select(tag.alias("tags"), F.lit(kind["event_type"] if kind else None).cast("string").alias("event_type"), text.alias("category"))
    techniques = map_techniques(alert).select(F.lit(detection_id).alias("chain_id"), "technique")
    bounds = in_chain.groupBy("chain_id").agg(F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"))
    alert_count = alerts.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_alerts"))
    return score_chains(in_chain, alerts, techniques).join(bounds, "chain_id").join(alert_count, "chain_id", "left") \
        .withColumn("trigger_event", F.lit(trigger))
