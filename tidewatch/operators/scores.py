"""Risk scores, behavioural anomaly scoring per peer group, verdict classifier."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.keyed import scratch_folder, with_position
from tidewatch.functions.scalars import peer_process, peer_subnet
from tidewatch.operators.rules import ANOMALY_RULES, anomaly_rules
from tidewatch.schema import SEVERITY_BASE, TECHNIQUE_WEIGHTS, lookup


def _points(table: dict, key: Column) -> Column:
    return F.coalesce(lookup(table, key), F.lit(0))


def detection_score(severity: Column, technique: Column, anomalies: Column) -> Column:
    return F.least(F.lit(100), _points(SEVERITY_BASE, severity) + _points(TECHNIQUE_WEIGHTS, technique)
                   + F.least(anomalies * 10, F.lit(20))).cast("int")


def score_detections(detections: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Detections with risk_score; the anomaly part counts distinct anomaly rules among the matched events."""
    flags = links.join(events.select("event_id", anomaly_rules().alias("_r")), "event_id").select("detection_id", F.explode("_r").alias("_r")) \
        .groupBy("detection_id").agg(F.count_distinct("_r").alias("anomalies"))
    return detections.join(flags, F.col("id") == F.col("detection_id"), "left").withColumn(
        "risk_score", detection_score(F.col("severity"), F.col("attack_technique"), F.coalesce("anomalies", F.lit(0)))).drop("detection_id", "anomalies")


def score_entities(links: DataFrame, events: DataFrame, entity: Column | None = None) -> DataFrame:
    """Score per entity of the matched events from its worst technique and severity, anomaly rules and detections."""
    who = entity if entity is not None else F.coalesce("process_name", "event_id")
    tagged = events.select("event_id", who.alias("entity"), _points(TECHNIQUE_WEIGHTS, F.col("attack_technique")).alias("w"),
                           _points(SEVERITY_BASE, F.lower("severity")).alias("s"), anomaly_rules().alias("r"))
    fired = [F.max(F.array_contains("r", rule).cast("int")).alias(f"r{i}") for i, rule in enumerate(ANOMALY_RULES)]
    worst = links.join(tagged, "event_id").groupBy("entity").agg(F.max("w").alias("w"), F.max("s").alias("s"), F.count_distinct("detection_id").alias("d"), *fired)
    rules = sum((F.col(f"r{i}") for i in range(1, len(fired))), F.col("r0"))
    return worst.select("entity", F.least(
        F.lit(100), F.col("w") + F.least("s", F.lit(30)) + F.least(rules * 10, F.lit(20)) + F.least(F.col("d") * 5, F.lit(10))).cast("int").alias("risk_score"))


def nodes_with_risk(nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """Graph nodes (id) with risk_score, zero when unscored."""
    return nodes.join(scores.select(F.col("entity").alias("id"), "risk_score"), "id", "left").na.fill(0, ["risk_score"])


# ---- behavioural anomaly -----------------------------------------------------------------------------

FEATURES = ["severity", "event_type_hash", "src_port", "dst_port", "http_status", "conn_dur", "pid"]
SEVERITY_LEVEL = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25, "informational": 0.0}


def feature_columns() -> dict[str, Column]:
    """Seven values in [0, 1] per event. Text is hashed by MD5, which is the same in every process."""
    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("double")
    digest = F.conv(F.substring(F.md5(F.coalesce("event_type", F.lit(""))), 1, 8), 16, 10).cast("bigint")
    return {
        "severity": F.coalesce(lookup(SEVERITY_LEVEL, F.lower(F.coalesce("severity", F.lit("")))), F.lit(0.25)),
        "event_type_hash": (digest % 100) / 100.0,
        "src_port": (zero("src_port") % 65536) / 65535.0,
        "dst_port": (zero("dst_port") % 65536) / 65535.0,
        "http_status": (zero("http_status_code") % 1000) / 999.0,
        "conn_dur": F.least(zero("conn_duration"), F.lit(3600.0)) / 3600.0,
        "pid": (zero("process_id") % 65536) / 65535.0,
    }


def squash(value: Column) -> Column:
    return F.tanh(F.abs(value) / 1000.0)


def peer_features(events: DataFrame) -> DataFrame:
    cells = feature_columns()
    return events.select("event_id", "timestamp", peer_subnet(F.coalesce("src_ip", "hostname")).alias("subnet"),
                         peer_process(F.col("process_name")).alias("process"), *[c.alias(f"f_{n}") for n, c in cells.items()])


def grow_trees(n_features: int, trees: int = 25, height: int = 8, seed: int = 7, padding: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Split feature and split value of every inner node of random half-space trees over the unit cube.

    Grown once on the driver (a few thousand numbers) and shipped with the task function.
    """
    rng = np.random.RandomState(seed)
    inner = 2 ** height - 1
    feature, split = np.zeros((trees, inner), dtype=np.int64), np.zeros((trees, inner))
    for t in range(trees):
        boxes = {0: [(0.0, 1.0)] * n_features}
        for node in range(inner):
            box = boxes.pop(node)
            f = rng.randint(n_features)
            lo, hi = box[f]
            margin = padding * (hi - lo)
            cut = rng.uniform(lo + margin, hi - margin)
            feature[t, node], split[t, node] = f, cut
            if 2 * node + 1 < inner:
                boxes[2 * node + 1] = [(lo, cut) if i == f else b for i, b in enumerate(box)]
                boxes[2 * node + 2] = [(cut, hi) if i == f else b for i, b in enumerate(box)]
    return feature, split


def mass_scorer(feature: np.ndarray, split: np.ndarray, window: int):
    """``score(rows, windows)``: the score of every row from the mass of the window before its own; 1 is most anomalous.

    Windows are numbered from 0 in the order of the rows, many in one pass; rows of window 0 only count. Mass of the reference along a
    row's path, deeper counts more, down to the first node with less than a tenth of a window.
    """
    trees, inner = feature.shape
    height, size, tree = int(np.log2(inner + 1)), 2 * inner + 1, np.arange(trees)

    def walk(x: np.ndarray) -> list[np.ndarray]:
        """Node of every (row, tree) at each depth, all trees at once."""
        node = np.zeros((len(x), trees), dtype=np.int64)
        path = [node]
        for _ in range(height):
            value = np.take_along_axis(x, feature[tree, node], axis=1)
            node = 2 * node + 1 + (value >= split[tree, node])
            path.append(node)
        return path

    def score(x: np.ndarray, windows: np.ndarray) -> np.ndarray:
        path, own = walk(x), windows[:, None] * (trees * size) + tree * size
        mass = np.zeros((int(windows.max()) + 1) * trees * size, dtype=np.int64)
        for node in path:
            mass += np.bincount((own + node).ravel(), minlength=len(mass))
        total, live = np.zeros(len(x)), np.ones((len(x), trees), dtype=bool)
        for depth, node in enumerate(path):
            m = mass[np.maximum(own + node - trees * size, 0)]
            total += np.where(live, m, 0).sum(axis=1) * 2.0 ** depth
            live &= m >= 0.1 * window
        return np.clip(1.0 - total / (trees * window * (2 ** (height + 1) - 1)), 0.0, 1.0)

    return score


def score_anomalies(events: DataFrame, window: int = 50, trees: int = 25, height: int = 8, seed: int = 7, chunk: str = "day",
                    squash_features: bool = False) -> DataFrame:
    """(event_id, subnet, process, anomaly_score): every event scored by its peer group's previous full window.

    A window's score needs only the counts of the window before it, so the sequential model splits into independent pieces:
    an event's position in its group (from chunked counts) gives its window, and tasks get blocks of windows. The first event of a group scores 0.5, the rest of its first window 0.
    """
    base = peer_features(events)
    if squash_features:
        base = base.withColumns({f"f_{n}": squash(F.col(f"f_{n}")) for n in FEATURES})
    placed = with_position(base, ["subnet", "process"], "timestamp", "event_id", "position", chunk)
    return _scored(placed.withColumn("scored", F.lit(True)), window, trees, height, seed)


BLOCK_WINDOWS, PASS_ROWS = 64, 4096        # windows of a group that a task gets together; rows of one array pass


def _scored(placed: DataFrame, window: int, trees: int, height: int, seed: int) -> DataFrame:
    """Scores of the rows to be ``scored`` from their position in their group; the other rows are known ones that only count.

    Groups are cut into blocks of BLOCK_WINDOWS windows. A block gets the last window of the block before once more, so one row in
    BLOCK_WINDOWS is sent twice, and a group of any size is spread over as many tasks as it has blocks.
    """
    placed = placed.withColumn("window", F.floor(F.col("position") / window))
    early = placed.filter("scored AND window = 0").select("event_id", "subnet", "process", F.when(F.col("position") == 0, 0.5).otherwise(0.0).alias("anomaly_score"))
    columns = [f"f_{n}" for n in FEATURES]
    block = F.floor(F.col("window") / BLOCK_WINDOWS)
    again = F.when((F.col("window") + 1) % BLOCK_WINDOWS == 0, F.struct((block + 1).alias("block"), F.lit(False).alias("scored")))
    pieces = placed.select("event_id", "subnet", "process", *columns, "position", "window", F.explode(F.array_compact(F.array(F.struct(block.alias("block"), "scored"), again))).alias("p")) \
        .select("event_id", "subnet", "process", *columns, "position", "window", "p.block", (F.col("p.scored") & (F.col("window") > 0)).alias("scored"))
    score = mass_scorer(*grow_trees(len(columns), trees, height, seed), window)

    def many_windows(batches):
        held = None

        def changes(table: pa.Table, *names: str) -> np.ndarray:
            """Whether each row but the first differs from the one before."""
            return np.logical_or.reduce([pc.not_equal(table.column(c).slice(1), table.column(c).slice(0, table.num_rows - 1)).to_numpy() for c in names])

        def emit(table: pa.Table) -> pa.RecordBatch:
            number = np.append(0, np.cumsum(changes(table, "subnet", "process", "block", "window")))
            wanted = pa.array(table.column("scored").to_numpy())
            x = np.column_stack([table.column(c).to_numpy() for c in columns])
            values = pa.array(score(x, number))
            return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().filter(wanted) for c in ("event_id", "subnet", "process")), values.filter(wanted)], ["event_id", "subnet", "process", "anomaly_score"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while table.num_rows > PASS_ROWS:
                # Up to a border of blocks: a block's rows stay together.
                borders = np.flatnonzero(changes(table, "subnet", "process", "block")) + 1
                borders = borders[borders >= PASS_ROWS // 2]
                if not len(borders):
                    break
                cut = int(borders[0])
                yield emit(table.slice(0, cut))
                table = table.slice(cut)
            held = table
        if held is not None and held.num_rows:
            yield emit(held)

    later = pieces.repartition("subnet", "process", "block").sortWithinPartitions("subnet", "process", "block", "position") \
        .mapInArrow(many_windows, "event_id string, subnet string, process string, anomaly_score double")
    return early.unionByName(later)


def score_new(events: DataFrame, state: DataFrame | None, window: int = 50, trees: int = 25, height: int = 8, seed: int = 7, chunk: str = "day") -> tuple[DataFrame, DataFrame]:
    """(scores, new state) of events that arrive after those the state has seen; in one batch they count in time order.

    A peer group's state is its rows since the start of its last full window, fewer than two windows, with their positions. Given no state and
    all events this is :func:`score_anomalies`. Groups without new rows have no row in the new state.
    """
    group = ["subnet", "process"]
    base = peer_features(events).drop("timestamp")
    placed = with_position(peer_features(events), group, "timestamp", "event_id", "position", chunk).withColumn("scored", F.lit(True)).drop("timestamp")
    if state is not None:
        known = state.join(base.select(*group).distinct(), group, "left_semi").withColumn("scored", F.lit(False))
        start = known.groupBy(*group).agg((F.max("position") + 1).alias("_start"))
        placed = placed.join(start, group, "left").withColumn("position", F.col("position") + F.coalesce("_start", F.lit(0))).drop("_start").unionByName(known)
    ends = placed.groupBy(*group).agg(((F.floor((F.max("position") + 1) / window) - 1) * window).alias("_from"))
    kept = placed.join(ends, group).filter("position >= _from").drop("_from", "scored")
    return _scored(placed, window, trees, height, seed), kept


def anomaly_detections(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Synthetic detections for scores above the threshold; high above 0.85. Needs event_id, subnet, process, anomaly_score."""
    s = F.col("anomaly_score")
    return scored.filter(s > threshold).select(
        F.concat(F.lit("anomaly-"), "event_id").alias("id"), F.concat(F.lit("anomaly-"), "subnet", F.lit("__"), "process").alias("rule_id"),
        F.format_string("Anomaly: %s / %s (score=%.2f)", "subnet", "process", s).alias("rule_name"),
        F.when(s > 0.85, "high").otherwise("medium").alias("severity"), "event_id",
        F.format_string(f"Behavioral anomaly score %.2f exceeds threshold {threshold}", s).alias("explanation"))


def _peers(events: DataFrame, subnet: str, process: str) -> DataFrame:
    return events.filter((peer_subnet(F.col("src_ip")) == f"{subnet}.subnet") & (peer_process(F.col("process_name")) == process.lower().strip())
                         & F.col("anomaly_score").isNotNull())


def peer_profile(events: DataFrame, subnet: str, process: str, limit: int = 500) -> DataFrame:
    """Count, mean and maximum of a peer group's last scores."""
    last = _peers(events, subnet, process).orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(limit)
    return last.agg(F.count(F.lit(1)).alias("event_count"), F.coalesce(F.round(F.avg("anomaly_score"), 4), F.lit(0.0)).alias("avg_score"),
                    F.coalesce(F.round(F.max("anomaly_score"), 4), F.lit(0.0)).alias("max_score"))


def score_trend(events: DataFrame, subnet: str, process: str, as_of: str, hours: int = 24, limit: int = 500) -> DataFrame:
    start = F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours))
    return _peers(events, subnet, process).filter(F.col("timestamp") >= start).select("timestamp", "event_id", "anomaly_score") \
        .orderBy("timestamp", "event_id").limit(limit)


# ---- verdict classifier ---------------------------------------------------------------------------------

def verdict_features(detections: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """(id, created_at, features, label): severity level and rule hash."""
    code = F.coalesce(lookup({k: v / 40 for k, v in SEVERITY_BASE.items()}, F.col("severity")), F.lit(0.0))
    hashed = (F.conv(F.substring(F.md5("rule_id"), 1, 8), 16, 10).cast("bigint") % 100) / 100.0
    rows = detections.select("id", "created_at", code.alias("severity_level"), hashed.alias("rule_hash"))
    if feedback is not None:
        rows = rows.join(feedback.select(F.col("detection_id").alias("id"), (F.col("verdict") == "TP").cast("double").alias("label")), "id")
    return VectorAssembler(inputCols=["severity_level", "rule_hash"], outputCol="features").transform(rows)


def train_verdicts(labelled: DataFrame):
    return LogisticRegression(maxIter=20, regParam=0.01).fit(labelled)


def true_positive_probability(model, detections: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    return model.transform(verdict_features(detections)).select("id", vector_to_array("probability")[1].alias("p_tp"))


def progressive_accuracy(labelled: DataFrame, folds: int = 5, min_samples: int = 10) -> float | None:
    """Each fold in time order is predicted by a model of all earlier folds; None below ``min_samples``."""
    n = labelled.count()
    if n < min_samples:
        return None
    placed = with_position(labelled.withColumn("_all", F.lit(1)), ["_all"], "created_at", "id", "_pos", "day") \
        .withColumn("_fold", F.floor(F.col("_pos") * folds / n)).cache()
    right = seen = 0
    for k in range(1, folds):
        past = placed.filter(F.col("_fold") < k)
        if past.select("label").distinct().count() < 2:
            continue
        judged = train_verdicts(past).transform(placed.filter(F.col("_fold") == k))
        row = judged.agg(F.count_if(F.col("prediction") == F.col("label")), F.count(F.lit(1))).first()
        right, seen = right + row[0], seen + row[1]
    placed.unpersist()
    return round(right / seen, 4) if seen else None


def online_verdicts(labelled: DataFrame, batches: int = 20, rate: float = 1.0) -> list[dict]:
    """One row a batch of verdicts in time order: how many the model of all earlier batches got right, and the model after it.

    Logistic regression by gradient steps: each batch is judged, then moves the weights by its mean gradient. The verdicts are placed
    in order once and stored by batch, so a step reads its own rows and brings five sums to the driver.
    """
    spark, n = labelled.sparkSession, labelled.count()
    placed = with_position(labelled.withColumn("_all", F.lit(1)), ["_all"], "created_at", "id", "_pos", "day")
    folder = scratch_folder(spark) + "/verdicts"
    placed.select("severity_level", "rule_hash", "label", F.floor(F.col("_pos") * batches / F.lit(max(n, 1))).cast("int").alias("batch")).write.partitionBy("batch").parquet(folder)
    rows = spark.read.schema("severity_level double, rule_hash double, label double, batch int").parquet(folder)
    weights, out = [0.0, 0.0, 0.0], []
    for k in range(batches):
        inputs = [F.col("severity_level"), F.col("rule_hash"), F.lit(1.0)]
        chance = 1 / (1 + F.exp(-sum((F.lit(w) * x for w, x in zip(weights, inputs)), F.lit(0.0))))
        judged = rows.filter(F.col("batch") == k).withColumn("p", chance)
        step = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("p") > 0.5) == (F.col("label") == 1)).alias("right"), *[F.avg((F.col("p") - F.col("label")) * x).alias(f"g{i}") for i, x in enumerate(inputs)]).first()
        if step["n"]:
            weights = [w - rate * step[f"g{i}"] for i, w in enumerate(weights)]
            out.append({"batch": k, "n": step["n"], "right": step["right"], "severity_weight": weights[0], "rule_weight": weights[1], "bias": weights[2]})
    return out


def running_accuracy(steps: list[dict], min_samples: int = 10) -> list[dict]:
    """Adds ``accuracy``: the share of right answers so far, None below ``min_samples``."""
    seen = right = 0
    out = []
    for step in steps:
        seen, right = seen + step["n"], right + step["right"]
        out.append({**step, "accuracy": right / seen if seen >= min_samples else None})
    return out


def online_probability(steps: list[dict], detections: DataFrame) -> DataFrame:
    """(id, p_tp) by the last model of :func:`online_verdicts`; 0.5 by one that has seen nothing."""
    last = steps[-1] if steps else {"severity_weight": 0.0, "rule_weight": 0.0, "bias": 0.0}
    z = F.lit(last["severity_weight"]) * F.col("severity_level") + F.lit(last["rule_weight"]) * F.col("rule_hash") + F.lit(last["bias"])
    return verdict_features(detections).select("id", (1 / (1 + F.exp(-z))).alias("p_tp"))
