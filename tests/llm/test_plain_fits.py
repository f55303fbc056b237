"""The two classifiers against plain fits of the same equations: no partial sums, batches or bins in the way, every score compared."""
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_text_operators import SF
from tidewatch.llm import language, quality


def learned(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 != 0


def test_quality_scores_equal_a_plain_fit(spark):
    """Least squares on stacked equations, isotonic regression by its min-max formula."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts.update({10 ** 9: None, 10 ** 9 + 1: "", 10 ** 9 + 2: "x" * 200_000})
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    x = np.array([quality.statistics(t) for t in texts.values()])
    rows = [k for k, d in enumerate(texts) if d in marks and learned(d)]
    y = np.array([float(marks[d]) for d in texts if d in marks and learned(d)])
    mean, scale = x[rows].mean(0), np.sqrt(np.maximum(x[rows].var(0), 1e-6))
    rng = np.random.default_rng(quality.SEED)
    directions = rng.normal(size=(x.shape[1], quality.FEATURES)) / (2 * np.sqrt(x.shape[1]))
    phase = rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.clip((x - mean) / scale, -8, 8)
    f = np.array([[np.sqrt(2 / quality.FEATURES) * np.cos(row @ directions[:, j] + phase[j]) for j in range(quality.FEATURES)] + [1.0] for row in z])
    size = quality.FEATURES + 1
    damping = np.sqrt(quality.RIDGE * len(rows) / size) * np.eye(size)
    weights = np.linalg.lstsq(np.vstack([f[rows], damping]), np.concatenate([y, np.zeros(size)]), rcond=None)[0]
    step = 2 / (quality.BINS - 2)
    place = np.clip(np.floor((f @ weights + 0.5) / step) + 1, 0, quality.BINS - 1).astype(int)
    used = sorted(set(place[rows]))
    hits = np.array([y[place[rows] == b].sum() for b in used])
    total = np.array([(place[rows] == b).sum() for b in used])
    shares = [max(min(hits[a:b + 1].sum() / total[a:b + 1].sum() for b in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))]
    want = {d: shares[max(0, np.searchsorted(used, p, side="right") - 1)] for d, p in zip(texts, place)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert got.keys() == want.keys() and len(used) > 5
    assert all(abs(got[d]["score"] - want[d]) < 1e-6 and got[d]["predicted"] == int(want[d] >= 0.3) for d in want)


def slots(text):
    """Hashed 2- to 4-byte strings of a text, one at a time."""
    kept = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    data, out = f" {kept} ".encode(), set()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            h = ((int.from_bytes(data[i:i + n], "big") + n) * 0x9E3779B1) & 0xFFFFFFFF
            out.add((((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF) >> 18)
    return out


def test_languages_equal_a_plain_kernel_fit(spark):
    """Set intersections as the kernel, its matrix on all learnable texts, ridge on the Nystroem map; every text is a landmark here."""
    few = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").withColumn("n", F.expr("row_number() over (partition by lang order by doc_id)"))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in few.filter("n <= 40").orderBy("doc_id").collect()]
    rows += [(10 ** 9, None, None), (10 ** 9 + 1, "", "en"), (10 ** 9 + 2, "12 34 - 56", None)]
    sets = [slots(t) for _, t, _ in rows]
    kernel = lambda a, b: np.array([[len(p & q) / np.sqrt(max(1, len(p)) * max(1, len(q))) for q in b] for p in a])
    train = [k for k, (d, t, lang) in enumerate(rows) if learned(d) and t is not None and lang is not None]
    marks = [sets[k] for k in train]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6 * values[-1]
    f = np.hstack([kernel(sets, marks) @ vectors[:, keep] / np.sqrt(values[keep]), np.ones((len(rows), 1))])
    languages = sorted({rows[k][2] for k in train})
    y = np.array([[1.0 if rows[k][2] == lang else -1.0 for lang in languages] for k in train])
    size = f.shape[1]
    weights = np.linalg.solve(f[train].T @ f[train] + language.RIDGE * len(train) / size * np.eye(size), f[train].T @ y)
    value = f @ weights
    share = np.exp(language.SHARPNESS * value)
    share /= share.sum(axis=1, keepdims=True)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(got) == len(rows)
    for (d, text, _), v, s in zip(rows, value, share):
        if not re.search(r"[^\W\d_]", text or ""):
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
        else:
            assert abs(got[d]["score"] - s.max()) < 1e-3
            assert got[d]["lang_pred"] == languages[int(v.argmax())] or np.sort(v)[-1] - np.sort(v)[-2] < 1e-3
