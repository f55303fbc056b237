"""Language identification by blended-spectrum string kernels.

A text is the set of its byte n-grams (2 to 4 bytes, letters lower-cased, everything else one blank), hashed to ``SPACE`` slots:
the kernel of two texts is the number of common slots over the root of the product of their counts. Landmarks give the Nystroem
map, one-versus-rest ridge regression is fitted on kernel values to the landmarks, and scoring is one matrix product a batch:
presence x (landmarks x weights), the second factor multiplied out once.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import held_out, stored

SPACE, GRAMS, LANDMARKS, RIDGE, ROWS, PARTS, SHARPNESS = 1 << 14, (2, 3, 4), 48, 1e-3, 64, 16, 8.0
MAX_ROWS_PER_LANGUAGE = 2000      # documented bound of the rows a fit uses of one language, chosen by a hash of the id
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def presence(texts: list[str | None]) -> np.ndarray:
    """One row of zeros and ones a text."""
    out = np.zeros((len(texts), SPACE), dtype=np.float32)
    for row, text in zip(out, texts):
        data = np.frombuffer((" " + NOT_LETTERS.sub(" ", (text or "").lower()).strip() + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
        gram = data
        for n in range(2, max(GRAMS) + 1):
            if len(data) < n:
                break
            gram = (gram[:-1] << np.uint32(8)) | data[n - 1:]
            if n in GRAMS:
                slot = (gram + np.uint32(n)) * np.uint32(0x9E3779B1)
                row[(slot ^ (slot >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(18)] = 1
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def sample(docs: DataFrame, bound: int) -> DataFrame:
    """(doc_id, text, lang) of learnable rows, about ``bound`` of each language at most, by a hash of the id."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}      # one row a language, as the model has
    if not counts:
        return known.select("doc_id", "text", "lang")
    limit = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 20, -(-bound * (1 << 20) // n)))]), F.col("lang"))
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit).select("doc_id", "text", "lang")


class Model:
    def __init__(self, languages: list[str], product: np.ndarray, shift: np.ndarray):
        self.languages, self.product, self.shift = languages, product, shift

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        value = unit(presence(texts)) @ self.product + self.shift
        share = np.exp(SHARPNESS * (value - value.max(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = value.argmax(axis=1)
        named = [bool(t and LETTER.search(t)) for t in texts]
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), named)], np.where(named, share.max(axis=1), 0.0)


def fit(docs: DataFrame) -> Model:
    train = stored(sample(docs, MAX_ROWS_PER_LANGUAGE).repartition(PARTS))
    order = F.xxhash64("doc_id", F.lit(1))
    marks = train.withColumn("rank", F.expr("row_number() over (partition by lang order by xxhash64(doc_id, 1), doc_id, text)")).filter(F.col("rank") <= LANDMARKS).orderBy("lang", order).collect()   # LANDMARKS texts a language
    languages = sorted({r["lang"] for r in marks})
    if not languages:
        return Model([], np.zeros((SPACE, 0), dtype=np.float32), np.zeros(0))
    landmarks = unit(presence([r["text"] for r in marks]))
    kernel = (landmarks @ landmarks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    keep = values > 1e-6 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])             # Nystroem map of kernel values
    shared = docs.sparkSession.sparkContext.broadcast(landmarks.T @ whiten.astype(np.float32))
    column = {lang: k for k, lang in enumerate(languages)}

    def scan(batches):
        width = int(keep.sum()) + 1
        left, right = np.zeros((width, width)), np.zeros((width, len(languages)))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                f = np.hstack([unit(presence(part.column("text").to_pylist())) @ shared.value, np.ones((part.num_rows, 1), dtype=np.float32)]).astype(np.float64)
                y = np.full((part.num_rows, len(languages)), -1.0)
                y[np.arange(part.num_rows), [column[x] for x in part.column("lang").to_pylist()]] = 1
                left += f.T @ f
                right += f.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], ["l", "r"])

    sums = train.mapInArrow(scan, "l binary, r binary").collect()       # PARTS rows of fixed size
    width = int(keep.sum()) + 1
    left = sum(np.frombuffer(s["l"]) for s in sums).reshape(width, width)
    right = sum(np.frombuffer(s["r"]) for s in sums).reshape(width, len(languages))
    weights = np.linalg.solve(left + RIDGE * left[-1, -1] / width * np.eye(width), right)
    return Model(languages, (shared.value @ weights[:-1]).astype(np.float32), weights[-1])


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document; score is the softmax share of the best language.

    Texts that are null or have no letter are ``und`` with score 0, and so is every text when no language could be learned.
    Repeated documents each get a row; a null doc_id is held out. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))         # SPACE x languages numbers

    def scan(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names, score = model.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
