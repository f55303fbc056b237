"""Windowed correlation: port scans, brute force, beaconing, rule chains, repeat suppression.

Every detector returns detection rows; ``*_events`` functions return the long link table
(detection id, event id), so no row carries an unbounded id list.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.keyed import with_previous
from tidewatch.functions.scalars import stable_id

PAIR = ["src_ip", "dst_ip", "dst_port"]
BEACON_TYPES = ["conn", "network_connect", "tls", "ssl", "http"]
OUTPUT = ["id", "rule_id", "rule_name", "severity", "attack_technique", "attack_tactic", "entity_key",
          "explanation", "n_events", "created_at"]


def since(ts: str, as_of: str | None, lookback: str | None) -> Column:
    """Lookback predicate against a fixed reference time; no cut-off without one."""
    if as_of is None or lookback is None:
        return F.lit(True)
    end = F.lit(as_of).cast("timestamp")
    return (F.col(ts) >= end - F.expr(f"INTERVAL {lookback}")) & (F.col(ts) <= end)


def _window_id(rule: str, *keys: str) -> Column:
    return stable_id(F.lit(rule), F.concat_ws("|", F.unix_micros("window_start").cast("string"), *keys))


def scan_windows(events: DataFrame, window: str, as_of: str | None = None, lookback: str | None = None) -> DataFrame:
    """Rows with a source and a target port, and the start of the window they fall in."""
    return (events.filter(since("timestamp", as_of, lookback) & F.col("src_ip").isNotNull() & F.col("dst_port").isNotNull())
            .withColumn("window_start", F.window("timestamp", window).getField("start")))


PORT_KEY, PORT_SUMS = ["src_ip", "window_start", "dst_port"], (["n_events"], ["first_event"], ["created_at"])
FAILURE_KEY = ["src_ip", "dst_ip", "window_start"]


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.min("timestamp").alias("first_event"), F.max("timestamp").alias("created_at"))


def port_counts(events: DataFrame, window: str, as_of: str | None = None, lookback: str | None = None) -> DataFrame:
    """Rows by source, window and port; counts of several batches can be added up."""
    return _counted(scan_windows(events, window, as_of, lookback), PORT_KEY)


def port_scans(events: DataFrame, window: str = "60 seconds", min_ports: int = 15,
               as_of: str | None = None, lookback: str | None = None) -> DataFrame:
    """Sources touching many distinct ports inside one tumbling window."""
    return scans_of(port_counts(events, window, as_of, lookback), window, min_ports)


def scans_of(counts: DataFrame, window: str = "60 seconds", min_ports: int = 15) -> DataFrame:
    """Port scans from counts with one row a source, window and port."""
    return (counts.groupBy("src_ip", "window_start")
            .agg(F.count(F.lit(1)).alias("distinct_ports"), F.sum("n_events").alias("n_events"),
                 F.min("first_event").alias("first_event"), F.max("created_at").alias("created_at"))
            .filter(F.col("distinct_ports") >= min_ports)
            .select("*", _window_id("corr-portscan", "src_ip").alias("id"), F.lit("corr-portscan").alias("rule_id"),
                    F.lit("Correlation: Port Scan").alias("rule_name"), F.lit("medium").alias("severity"),
                    F.lit("T1046").alias("attack_technique"), F.lit("discovery").alias("attack_tactic"),
                    F.col("src_ip").alias("entity_key"),
                    F.format_string(f"Port scan from %s (%d ports in {window})", "src_ip", "distinct_ports").alias("explanation")))


def port_scan_events(events: DataFrame, scans: DataFrame, window: str = "60 seconds", **scope) -> DataFrame:
    keyed = scan_windows(events, window, scope.get("as_of"), scope.get("lookback"))
    hits = scans.select("src_ip", "window_start", F.col("id").alias("detection_id"))
    return keyed.join(hits, ["src_ip", "window_start"]).select("detection_id", "event_id")


def auth_failure() -> Column:
    failed_ssh = (F.col("event_type") == "ssh") & (F.col("ssh_auth_success") == F.lit(False))
    return F.coalesce((F.col("event_outcome") == "failure") | (F.col("event_type") == "logon_failure") | failed_ssh, F.lit(False))


def failure_windows(events: DataFrame, window: str, as_of: str | None = None, lookback: str | None = None) -> DataFrame:
    """Authentication failures with a source, and the start of the window they fall in."""
    return (events.filter(since("timestamp", as_of, lookback) & F.col("src_ip").isNotNull() & auth_failure())
            .withColumn("window_start", F.window("timestamp", window).getField("start")))


def failure_counts(events: DataFrame, window: str, as_of: str | None = None, lookback: str | None = None) -> DataFrame:
    """Failures by source, target and window; counts of several batches can be added up."""
    return _counted(failure_windows(events, window, as_of, lookback), FAILURE_KEY)


def brute_force(events: DataFrame, window: str = "60 seconds", min_failures: int = 10,
                as_of: str | None = None, lookback: str | None = None) -> DataFrame:
    """Repeated authentication failures from one source to one target."""
    return brute_of(failure_counts(events, window, as_of, lookback), window, min_failures)


def brute_of(counts: DataFrame, window: str = "60 seconds", min_failures: int = 10) -> DataFrame:
    """Brute force from counts with one row a source, target and window."""
    return (counts.filter(F.col("n_events") >= min_failures)
            .select("*", _window_id("corr-bruteforce", "src_ip", "dst_ip").alias("id"),
                    F.lit("corr-bruteforce").alias("rule_id"), F.lit("Correlation: Brute Force").alias("rule_name"),
                    F.lit("high").alias("severity"), F.lit("T1110").alias("attack_technique"),
                    F.lit("credential-access").alias("attack_tactic"), F.col("src_ip").alias("entity_key"),
                    F.format_string(f"Brute force from %s to %s (%d failures in {window})", "src_ip",
                                    F.coalesce("dst_ip", F.lit("unknown")), "n_events").alias("explanation")))


def connections(events: DataFrame, as_of: str | None = None, lookback: str | None = None) -> DataFrame:
    return events.filter(since("timestamp", as_of, lookback) & F.col("event_type").isin(BEACON_TYPES)
                         & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull() & F.col("dst_port").isNotNull())


def connection_gaps(events: DataFrame, as_of=None, lookback=None, chunk: str = "hour") -> DataFrame:
    """Seconds since the previous connection of the same (source, target, port); first one has no row."""
    conns = connections(events, as_of, lookback).select("event_id", "src_ip", "dst_ip", "dst_port", "timestamp")
    micros = F.unix_micros("timestamp")
    return (with_previous(conns, ["src_ip", "dst_ip", "dst_port"], "timestamp", "event_id", micros, "_before", chunk)
            .filter(F.col("_before").isNotNull())
            .withColumn("gap_seconds", (micros - F.col("_before")) / 1e6).drop("_before"))


def beacons(events: DataFrame, min_intervals: int = 19, max_cv: float = 0.3,
            as_of: str | None = None, lookback: str | None = None, chunk: str = "hour") -> DataFrame:
    """Connections with regular spacing: coefficient of variation of the gaps below ``max_cv``."""
    return _beacon_rows(connection_gaps(events, as_of, lookback, chunk).groupBy(*PAIR)
                        .agg(F.count(F.lit(1)).alias("n_events"), F.avg("gap_seconds").alias("mean_interval"),
                             F.stddev_pop("gap_seconds").alias("stddev_interval"), F.max("timestamp").alias("created_at")), min_intervals, max_cv)


def _beacon_rows(stats: DataFrame, min_intervals: int, max_cv: float) -> DataFrame:
    cv = F.try_divide(F.col("stddev_interval"), F.col("mean_interval"))
    return (stats.filter((F.col("n_events") >= min_intervals) & (F.col("mean_interval") > 0) & (cv < max_cv))
            .select("*", stable_id(F.lit("corr-beacon"), F.concat_ws("|", "src_ip", "dst_ip", F.col("dst_port").cast("string"))).alias("id"),
                    F.lit("corr-beacon").alias("rule_id"), F.lit("Correlation: Beaconing").alias("rule_name"),
                    F.lit("high").alias("severity"), F.lit("T1071").alias("attack_technique"),
                    F.lit("command-and-control").alias("attack_tactic"), F.col("src_ip").alias("entity_key"),
                    F.format_string("Beaconing from %s to %s:%d (CV=%.2f, %d connections)", "src_ip", "dst_ip", "dst_port",
                                    cv, F.col("n_events") + 1).alias("explanation")))


# ---- beacon summaries ----------------------------------------------------------------------------------
# Connections of one (source, target, port) in one time chunk: the instants (microseconds, sorted) and what a pair needs of them.

CHUNK_KEY = [*PAIR, "chunk"]
MOMENTS = ["n", "first", "last", "mean", "m2"]


def connection_chunks(events: DataFrame, chunk: str = "hour") -> DataFrame:
    """(source, target, port, chunk, instants) of connections; a chunk holds one chunk's connections of one pair."""
    return (connections(events).groupBy(*PAIR, F.date_trunc(chunk, "timestamp").alias("chunk"))
            .agg(F.array_sort(F.collect_list(F.unix_micros("timestamp"))).alias("instants")))


def merged_chunks(chunks: DataFrame) -> DataFrame:
    """One row a pair and chunk, instants of several batches in order."""
    return chunks.groupBy(*CHUNK_KEY).agg(F.array_sort(F.flatten(F.collect_list("instants"))).alias("instants"))


def with_moments(chunks: DataFrame) -> DataFrame:
    """Adds count, first and last instant, and mean and summed squared deviation of the gaps inside the chunk."""
    gaps = F.zip_with(F.slice("instants", F.lit(2), F.greatest(F.size("instants") - 1, F.lit(0))), F.slice("instants", F.lit(1), F.greatest(F.size("instants") - 1, F.lit(0))), lambda b, a: (b - a) / 1e6)
    placed = chunks.withColumn("n", F.size("instants").cast("bigint")).withColumn("first", F.element_at("instants", 1)).withColumn("last", F.element_at("instants", -1)) \
        .withColumn("mean", F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / 1e6 / (F.col("n") - 1)).otherwise(0.0))
    return placed.withColumn("m2", F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + (gap - F.col("mean")) * (gap - F.col("mean"))))


def beacons_of(moments: DataFrame, min_intervals: int = 19, max_cv: float = 0.3) -> DataFrame:
    """Beacons from the moments of all chunks of some pairs, combined in chunk order; instants are not needed.

    The gaps of a pair are those inside its chunks and one from each chunk's last instant to the next one's first.
    """
    in_order, whole = Window.partitionBy(*PAIR).orderBy("chunk"), Window.partitionBy(*PAIR)
    step = (F.col("first") - F.lag("last").over(in_order)) / 1e6
    placed = moments.select(*CHUNK_KEY, *MOMENTS).withColumn("step", step).withColumn("gaps", F.sum("n").over(whole) - 1) \
        .withColumn("overall", F.try_divide((F.max("last").over(whole) - F.min("first").over(whole)) / 1e6, F.col("gaps")))
    spread = F.col("m2") + (F.col("n") - 1) * F.pow(F.col("mean") - F.col("overall"), 2) + F.coalesce(F.pow(F.col("step") - F.col("overall"), 2), F.lit(0.0))
    stats = placed.filter("gaps > 0").groupBy(*PAIR).agg(F.first("gaps").alias("n_events"), F.first("overall").alias("mean_interval"), F.sqrt(F.sum(spread) / F.first("gaps")).alias("stddev_interval"),
                                                         F.timestamp_micros(F.max("last")).alias("created_at"))
    return _beacon_rows(stats, min_intervals, max_cv)


def trimmed(chunks: DataFrame, as_of: str, lookback: str, chunk: str = "hour") -> DataFrame:
    """Moments of the part of each chunk within the lookback; only border chunks look at their instants."""
    end = F.lit(as_of).cast("timestamp")
    start = end - F.expr(f"INTERVAL {lookback}")
    inside = chunks.filter((F.col("chunk") > start) & (F.col("chunk") < F.date_trunc(chunk, end))).select(*CHUNK_KEY, *MOMENTS)
    border = chunks.filter((F.col("chunk") == F.date_trunc(chunk, start)) | (F.col("chunk") == F.date_trunc(chunk, end))).select(
        *CHUNK_KEY, F.filter("instants", lambda t: (t >= F.unix_micros(start)) & (t <= F.unix_micros(end))).alias("instants"))
    return inside.unionByName(with_moments(border.filter(F.size("instants") > 0)).select(*CHUNK_KEY, *MOMENTS))


@dataclass
class Chain:
    name: str
    description: str = ""
    rule_ids: list[str] = field(default_factory=list)
    rule_tactics: list[str] = field(default_factory=list)
    window: str = "15 minutes"
    severity: str = "critical"


def _co_fired(detections: DataFrame, column: str, wanted: list[str], as_of: str, window: str) -> DataFrame:
    return (detections.filter(F.col(column).isin(wanted) & since("created_at", as_of, window) & F.col("entity_key").isNotNull())
            .groupBy("entity_key").agg(F.count_distinct(column).alias("matched"), F.count(F.lit(1)).alias("n_events"),
                                       F.max("created_at").alias("created_at"))
            .filter(F.col("matched") == len(wanted)))


def chain_by_rules(detections: DataFrame, chain: Chain, as_of: str) -> DataFrame:
    return _chain_rows(_co_fired(detections, "rule_id", chain.rule_ids, as_of, chain.window), chain)


def chain_by_tactics(detections: DataFrame, chain: Chain, as_of: str) -> DataFrame:
    """Entities whose detections cover all tactics and that the rule part did not already report."""
    found = _co_fired(detections, "attack_tactic", chain.rule_tactics, as_of, chain.window)
    if chain.rule_ids:
        done = _co_fired(detections, "rule_id", chain.rule_ids, as_of, chain.window)
        found = found.join(done.select("entity_key"), "entity_key", "left_anti")
    return _chain_rows(found, chain)


def _chain_rows(found: DataFrame, chain: Chain) -> DataFrame:
    return found.select(
        stable_id(F.lit(f"corr-chain-{chain.name}"), F.col("entity_key")).alias("id"),
        F.lit(f"corr-chain-{chain.name}").alias("rule_id"),
        F.lit(f"Correlation Chain: {chain.description or chain.name}").alias("rule_name"),
        F.lit(chain.severity).alias("severity"), F.lit(None).cast("string").alias("attack_technique"),
        F.lit("lateral-movement").alias("attack_tactic"), "entity_key",
        F.format_string(f"Chain '{chain.name}' matched for entity %s", "entity_key").alias("explanation"),
        "n_events", "created_at")


def chain_members(detections: DataFrame, chains_found: DataFrame, chain: Chain, as_of: str) -> DataFrame:
    """Link rows: which detections make up each reported chain."""
    part = detections.filter(
        (F.col("rule_id").isin(chain.rule_ids) | F.col("attack_tactic").isin(chain.rule_tactics))
        & since("created_at", as_of, chain.window)).select("entity_key", F.col("id").alias("member_id"))
    return chains_found.select(F.col("id").alias("chain_id"), "entity_key").join(part, "entity_key").drop("entity_key")


def suppress_repeats(new: DataFrame, history: DataFrame, as_of: str, minutes: int = 60) -> DataFrame:
    """Drop detections whose (rule, entity) already fired within the last ``minutes``."""
    recent = history.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")) \
                    .select("rule_id", "entity_key").distinct()
    return new.join(recent, ["rule_id", "entity_key"], "left_anti").select(*new.columns)


def run_all(events: DataFrame, history: DataFrame, chains: list[Chain], as_of: str, suppress_minutes: int = 60,
            scan: dict | None = None, brute: dict | None = None, beacon: dict | None = None) -> DataFrame:
    """All detectors and chains in one frame, repeats against ``history`` removed."""
    parts = [port_scans(events, **(scan or {})), brute_force(events, **(brute or {})), beacons(events, **(beacon or {}))]
    for chain in chains:
        if chain.rule_ids:
            parts.append(chain_by_rules(history, chain, as_of))
        if len(chain.rule_tactics) >= 2:
            parts.append(chain_by_tactics(history, chain, as_of))
    out = parts[0].select(*OUTPUT)
    for p in parts[1:]:
        out = out.unionByName(p.select(*OUTPUT))
    return suppress_repeats(out, history, as_of, suppress_minutes)
