"""Quality classifier: Gaussian-kernel ridge regression on document statistics by random Fourier features, calibrated isotonically.

The statistics of a text are computed once, in one pass, and stored; fitting and scoring read that narrow table. Fitting sums the
normal equations per partition and adds the few partial sums; calibration pools adjacent violators over score bins.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import byte_table, held_out, stored, with_ids

FEATURES, RIDGE, BINS, SEED, PARTS = 256, 1e-2, 1024, 7, 16
MAX_TRAIN_ROWS = 200_000       # documented bound of the labelled rows a fit uses, chosen by a hash of the id
ACCEPT = 0.3
STATISTICS = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "line", "punctuation", "symbol", "wide", "capital_words", "ending_symbols",
              "distinct_words", "distinct_pairs", "distinct_lines", "line_words", "top_word", "short_words", "long_words", "bare_marks")
# Byte classes in this order: lower, upper, digit, blank, line end, sentence punctuation, other ASCII, beyond ASCII.
CLASS = np.full(256, 6, dtype=np.uint8)
for _k, _keep in enumerate((lambda b: 97 <= b <= 122, lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b in (32, 9), lambda b: b in (10, 13), lambda b: b in b".,;:'\"()?-", None, lambda b: b >= 128)):
    if _keep:
        CLASS[byte_table(_keep)] = _k


def statistics(text: str | None) -> list[float]:
    """The values named in STATISTICS; a null or empty text has zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = text.encode("utf-8", "replace")
    counts = np.bincount(CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=8) / len(data)
    words = text.split()
    n = max(1, len(words))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = text.split("\n")
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    distinct = list(seen)
    share = lambda keep: sum(seen[w] for w in distinct if keep(w)) / n
    return [np.log1p(len(data)), np.log1p(len(words)), min(40.0, float(sizes.mean())), counts[1], counts[2], counts[3], counts[4], counts[5], counts[6], counts[7],
            share(str.isupper), share(lambda w: w[-1] in "!#$%&*+<=>@^_`{|}~"), len(seen) / n, len(set(zip(words, words[1:]))) / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)),
            max(seen.values(), default=0) / n, float((sizes <= 3).mean()), float((sizes > 15).mean()), share(lambda w: not any(map(str.isalnum, w)))]


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x)"""
    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = pa.array([statistics(t) for t in part.column("text").to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), x], ["doc_id", "held_out", "x"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, x array<double>")


def matrix(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS)) if len(column) else np.zeros((0, len(STATISTICS)))


class Model:
    """Scores rows of statistics; ``fallback`` is the score when nothing could be learned."""

    def __init__(self, mean, scale, fallback=0.5):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale, self.fallback, self.weights = mean, scale, fallback, None
        self.directions = rng.normal(size=(len(STATISTICS), FEATURES)) / (2 * np.sqrt(len(STATISTICS)))     # kernel width: twice the root of the dimension
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.edges, self.values = np.zeros(0), np.zeros(1)

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phase), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.fallback)
        return self.values[np.searchsorted(self.edges, self.raw(x), side="right")]


def partial_sums(train: DataFrame, per_batch, schema_names: list[str]) -> list[np.ndarray]:
    """Adds up per_batch(x, y), a list of arrays, over PARTS partitions; only PARTS rows of fixed size reach the driver."""
    def scan(batches):
        total = None
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            part = per_batch(matrix(batch.column("x")), y)
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([a.astype(np.float64).tobytes()], pa.binary()) for a in total], schema_names)

    rows = train.mapInArrow(scan, ", ".join(f"{n} binary" for n in schema_names)).collect()
    return [sum(np.frombuffer(r[n], dtype=np.float64) for r in rows) for n in schema_names]


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Nondecreasing shares per bin by pooling adjacent violators; empty bins take the pool they fall in."""
    pools: list[list[float]] = []
    for p, n in zip(positive, total):
        pools.append([p, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            p1, n1, k1 = pools.pop()
            pools[-1] = [pools[-1][0] + p1, pools[-1][1] + n1, pools[-1][2] + k1]
    return np.concatenate([np.full(int(k), p / n if n else 0.0) for p, n, k in pools])


def fit(table: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows outside the held-out fold. A label that is null is ignored; several labels of a document all count."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter("y in (0, 1)")
    train = stored(table.filter("not held_out").join(known, "doc_id").select("doc_id", "x", "y"))
    n = train.count()
    if n > MAX_TRAIN_ROWS:
        train = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * MAX_TRAIN_ROWS / n))
    train = train.repartition(PARTS)
    if not n:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    count, first, second, positive = partial_sums(train, lambda x, y: [np.array([len(x)]), x.sum(0), (x * x).sum(0), np.array([y.sum()])], ["n", "a", "b", "p"])
    mean = first / count
    model = Model(mean, np.sqrt(np.maximum(second / count - mean * mean, 1e-6)), float(positive[0] / count[0]))
    if not 0 < positive[0] < count[0]:
        return model
    def equations(x, y):
        f = model.features(x)
        return [(f.T @ f).ravel(), f.T @ y]
    left, right = partial_sums(train, equations, ["l", "r"])
    size = FEATURES + 1
    model.weights = np.linalg.solve(left.reshape(size, size) + RIDGE * count[0] * np.eye(size) / size, right)
    edges = np.linspace(-0.5, 1.5, BINS - 1)

    def binned(x, y):
        at = np.searchsorted(edges, model.raw(x), side="right")
        return [np.bincount(at, weights=y, minlength=BINS), np.bincount(at, minlength=BINS)]
    hits, rows = partial_sums(train, binned, ["h", "t"])
    model.edges, model.values = edges, isotonic(hits, rows)
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; score estimates P(quality = 1), predicted is 1 from ACCEPT on.

    Null texts count as empty and are scored like any. Without usable labels every score is 0.5, with one class its share.
    Repeated documents each get a row; a null doc_id is held out. Other columns are ignored.
    """
    table = stored(statistics_table(docs))
    model = table.sparkSession.sparkContext.broadcast(fit(table, labels))       # fixed size: FEATURES x STATISTICS numbers

    def scan(batches):
        for batch in batches:
            score = np.clip(model.value.score(matrix(batch.column("x"))), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= ACCEPT).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return table.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored at ACCEPT or more, all columns kept: learns as score_quality does, then scores inside one scan."""
    known = stored(labels.filter("quality is not null").select("doc_id").distinct())
    model = docs.sparkSession.sparkContext.broadcast(fit(statistics_table(with_ids(docs, known, "doc_id")), labels))

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.array([statistics(t) for t in part.column("text").to_pylist()]).reshape(-1, len(STATISTICS))
                yield part.filter(pa.array(model.value.score(x) >= ACCEPT))

    return docs.mapInArrow(scan, docs.schema)
