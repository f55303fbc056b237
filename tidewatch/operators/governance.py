"""Receipts, approval checks, action policy and source health."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.keyed import cut_lineage, newest_per_key
from tidewatch.functions.scalars import cidr_bounds, ipv4_number, once, parse_once
from tidewatch.schema import lookup

# Fixed values.
CASE_STATE = {"applied": "containment_confirmed", "noop_already_present": "containment_confirmed", "validation_failed": "containment_failed",
              "expired_rejected": "containment_failed", "rolled_back": "containment_rolled_back"}
REQUIRED_ACTION = {"validation_failed": "manual_review_required", "rolled_back": "manual_review_required", "expired_rejected": "re_approve_required"}
HIGH_RISK_ACTIONS = ["block_ip", "disable_account", "revoke_access"]
PROTECTED_NETWORKS = [("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16)]


def accept_receipts(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Receipts whose id is new; a repeated id is rejected, the first of a batch is kept."""
    first = incoming.groupBy("receipt_id").agg(F.min_by(F.struct(*[c for c in incoming.columns if c != "receipt_id"]), F.col("executed_at")).alias("r"))
    return first.select("receipt_id", "r.*").join(stored.select("receipt_id"), "receipt_id", "left_anti")


def case_states(receipts: DataFrame) -> DataFrame:
    """State of each case after its latest receipt."""
    latest = newest_per_key(receipts.select("case_id", "failure_taxonomy", "executed_at", "receipt_id"), ["case_id"], ["executed_at", "receipt_id"])
    return latest.select("case_id", "receipt_id", lookup(CASE_STATE, F.col("failure_taxonomy")).alias("case_status"))


def notifications(receipts: DataFrame) -> DataFrame:
    return receipts.filter(F.col("failure_taxonomy").isin(list(REQUIRED_ACTION))).select(
        "receipt_id", "case_id", lookup(REQUIRED_ACTION, F.col("failure_taxonomy")).alias("required_action"), F.lit("pending").alias("status"))


def approval_errors(as_of: str) -> Column:
    """Messages for a recommendation row with approved_by, expires_at, inference_confidence, inspection_passed, override_log."""
    weak = F.col("inference_confidence").isin("low", "none") | ~F.coalesce("inspection_passed", F.lit(True))
    return F.array_compact(F.array(
        F.when(F.trim(F.coalesce("approved_by", F.lit(""))) == "", F.lit("approved_by must be non-empty")),
        F.when(F.col("expires_at") <= F.lit(as_of).cast("timestamp"), F.lit("expires_at is in the past")),
        F.when(weak & F.col("override_log").isNull(), F.lit("override_log is required"))))


def static_gate(min_confidence: float = 0.85, require_approval: bool = True) -> Column:
    """First of the order-free gates that stops an action, else null: approval, confidence, protected networks."""
    inside = once(ipv4_number(F.trim("target")), lambda number: reduce(Column.__or__, [number.between(*cidr_bounds(*n)) for n in PROTECTED_NETWORKS]))
    protected = F.coalesce(inside, F.lit(False)) | (F.trim("target") == "::1")
    return (F.when(F.lit(require_approval) & F.col("action").isin(HIGH_RISK_ACTIONS) & ~F.col("human_confirmed"), "approval")
             .when(F.col("confidence") < min_confidence, "confidence")
             .when((F.col("action") == "block_ip") & protected, "safelist"))


def passed_by_rate(t: np.ndarray, entry: list[int], limit: int, width: int) -> list[int]:
    """Places of the candidates (sorted instants) that pass the rate gate when ``entry`` holds the last passed instants before them.

    Only passed candidates are visited, at most ``limit`` a window: the next one is the first after the last that is more than a window
    later than the ``limit``-th passed before it.
    """
    passed, out, at = list(entry), [], 0
    while True:
        if len(passed) >= limit:
            at = max(at, int(np.searchsorted(t, passed[-limit] + width, side="right")))
        if at >= len(t):
            return out
        out.append(at)
        passed.append(int(t[at]))
        at += 1


def _rate_gate(candidates: DataFrame, limit: int, width: int, chunk_windows: int = 8, rounds: int = 6) -> DataFrame:
    """(action_id) of the candidates (action_id, scope, t) that pass.

    Time is cut into chunks of ``chunk_windows`` windows. Every chunk is evaluated at once, first as if nothing had passed before it; what
    it then carries out, at most ``limit`` instants, is the next one's entry. Chunks whose entry differs from the one they were
    evaluated with are evaluated again, until none is left: mostly after two or three rounds, as passes soon do not depend on those a few
    windows back. Should chunks depend on one another longer than ``rounds``, the rest is walked in order, a chunk at a time.
    """
    length = width * chunk_windows
    chunks = cut_lineage(candidates.groupBy("scope", F.floor(F.col("t") / length).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("t", "action_id"))).alias("c"))
                         .select("scope", "chunk", F.col("c.t").alias("t"), F.col("c.action_id").alias("ids")))

    def carried(t: np.ndarray, entry: list[int]) -> list[int]:
        passed = [*entry, *t[passed_by_rate(t, entry, limit, width)].tolist()]
        return passed[-limit:] if limit else []

    def useful(out: list[int], chunk: int) -> list[int]:
        """The part of what was carried out that still counts from the start of a chunk on."""
        return [x for x in out if x >= chunk * length - width]

    def evaluate(batches):
        for batch in batches:
            out = [carried(t, e or []) for t, e in zip(batch.column("t").to_numpy(zero_copy_only=False), batch.column("entry").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("scope", "chunk", "entry")), pa.array(out, pa.list_(pa.int64()))], ["scope", "chunk", "entry", "out"])

    def walk(batches):
        scope, out = None, []
        for batch in batches:
            entries = []
            for name, c, t in zip(batch.column("scope").to_pylist(), batch.column("chunk").to_pylist(), batch.column("t").to_numpy(zero_copy_only=False)):
                entry = useful(out, c) if name == scope else []
                scope, out = name, carried(t, entry)
                entries.append(entry)
            yield pa.RecordBatch.from_arrays([batch.column("scope"), batch.column("chunk"), pa.array(entries, pa.list_(pa.int64()))], ["scope", "chunk", "entry"])

    def pick(batches):
        for batch in batches:
            ids = [i[k] for t, i, e in zip(batch.column("t").to_numpy(zero_copy_only=False), batch.column("ids").to_pylist(), batch.column("entry").to_pylist()) for k in passed_by_rate(t, e or [], limit, width)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string())], ["action_id"])

    state_schema = "scope string, chunk bigint, entry array<bigint>, out array<bigint>"
    none = F.array().cast("array<bigint>")
    key = [F.col("c.scope").eqNullSafe(F.col("s.scope")), F.col("c.chunk") == F.col("s.chunk")]
    state = cut_lineage(chunks.select("scope", "chunk", "t", none.alias("entry")).mapInArrow(evaluate, state_schema))
    before = Window.partitionBy("scope").orderBy("chunk")
    for _ in range(rounds):
        entry = F.filter(F.coalesce(F.lag("out").over(before), none), lambda x: x >= F.col("chunk") * length - width)
        linked = cut_lineage(state.withColumn("next", entry))
        changed = linked.filter(F.col("next") != F.col("entry")).select("scope", "chunk", F.col("next").alias("entry"))
        if changed.isEmpty():
            break
        again = chunks.alias("c").join(changed.alias("s"), key).select("c.scope", "c.chunk", "t", "entry").mapInArrow(evaluate, state_schema)
        state = cut_lineage(linked.filter(F.col("next") == F.col("entry")).select("scope", "chunk", "entry", "out").unionByName(again))
    else:
        state = chunks.select("scope", "chunk", "t").repartition("scope").sortWithinPartitions("scope", "chunk").mapInArrow(walk, "scope string, chunk bigint, entry array<bigint>")
    return chunks.alias("c").join(state.select("scope", "chunk", "entry").alias("s"), key).select("t", "ids", "entry").mapInArrow(pick, "action_id string")


def decide_actions(actions: DataFrame, min_confidence: float = 0.85, rate_limit: int = 3, rate_window_seconds: int = 3600,
                   learning_mode: bool = False, chunk_windows: int = 8, rounds: int = 6) -> DataFrame:
    """Gate per action (action_id, scope, requested_at, action, target, confidence, human_confirmed).

    Static gates are columns. The rate gate counts only allowed actions, so it depends on the order of a scope's candidates; it is
    evaluated for all time chunks at once and mended where chunks depend on one another (:func:`_rate_gate`), so no scope is one
    task. Of candidates at one instant only the first ``rate_limit`` can pass, so later ones are settled beforehand.
    """
    # Judged once a row and where rows have been dealt to: as a plain column the gate is filtered on in the few tasks that read the files.
    gated = cut_lineage(parse_once(actions, static_gate(min_confidence), "gate"))
    candidates = gated.filter("gate IS NULL").select("action_id", "scope", F.unix_micros("requested_at").alias("t"))
    same_instant = Window.partitionBy("scope", "t").orderBy("action_id")
    thin = candidates.withColumn("n", F.row_number().over(same_instant)).filter(F.col("n") <= rate_limit).drop("n")
    judged = _rate_gate(thin, rate_limit, rate_window_seconds * 1_000_000, chunk_windows, rounds).withColumn("allowed", F.lit(True))
    final = gated.join(judged, "action_id", "left").withColumn(
        "gate", F.coalesce("gate", F.when(F.col("allowed"), "allowed").otherwise("rate_limit"))).drop("allowed")
    real = F.col("gate") == "allowed"
    if learning_mode:
        return final.withColumns({"shadow_gate": F.col("gate"), "allowed": F.lit(False), "gate": F.lit("learning_mode")})
    return final.withColumn("allowed", real)


def source_health(events: DataFrame, as_of: str, degraded_after: int = 120, offline_after: int = 300) -> DataFrame:
    """connected / degraded / offline per source by the age of its last event."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last_seen")
    return events.filter("source_type IS NOT NULL").groupBy("source_type").agg(F.max("timestamp").alias("last_seen")).withColumn(
        "status", F.when(age < degraded_after, "connected").when(age < offline_after, "degraded").otherwise("offline"))
