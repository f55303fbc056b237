"""Spelling variants against brute force over all pairs of the vocabulary."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import AWKWARD, frame
from tidewatch.llm import spelling


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def edits(w):
        letters = set("".join(words))
        return {x for i in range(len(w) + 1) for x in [w[:i] + w[i + 1:], *(w[:i] + c + w[i:] for c in letters), *(w[:i] + c + w[i + 1:] for c in letters)]} - {w}

    out = {}
    for w, n in words.items():
        near = sorted(((-words[x], x) for x in edits(w) if x in words))
        strong = near and -near[0][0] >= 5 * n
        out[w] = (near[0][1] if strong else None, n, len(near), -near[0][0] if strong else None)
    roots = {}
    for w in words:
        roots[w] = w
        while out[roots[w]][0]:
            roots[w] = out[roots[w]][0]
    return sorted(repr((w, form, roots[w], n, k, form_n)) for w, (form, n, k, form_n) in out.items())


def found(spark, rows):
    docs = frame(spark, rows).withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).withColumn("form", F.lit(None))
    return sorted(repr(tuple(r)) for r in spelling.variants(docs).collect())


def crowded(seed, n=4000):
    """Few letters and lengths, so that words have many neighbours, long chains of forms and ties."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abÀ÷é", k=rng.choice([5, 6, 7, 8]))) for _ in range(40)]
    while len(stems) < 300:                                                   # one edit away from another
        word = rng.choice(stems)
        at = rng.randrange(len(word))
        stems.append(word[:at] + rng.choice(["", "a", "Àb", "é"]) + word[at + rng.randint(0, 1):])
    weights = [5 ** rng.randint(0, 5) for _ in stems]
    return [(k if k % 50 else None, rng.choice([" ", "-", "Ā", "1"]).join(x.upper() if rng.random() < .2 else x for x in rng.choices(stems, weights, k=12))) for k in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_variants(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD_WORDS", 40), ("FILTER_BYTES", 300), ("PROBES", 500), ("TASK_WORDS", 100), ("CHUNK", 7), ("COUNTED_WORDS", 20)):
            monkeypatch.setattr(spelling, name, value)
    rows = [*crowded(1 + small), *AWKWARD, *[(500 + k, "variant variants variat " * 3 + "varian") for k in range(9)], (600, "q" * 3000 + " " + "q" * 2999 + "z")] + [(601 + k, "q" * 3000 + " " + "q" * 2999 + "z") for k in range(6)]
    expected = brute(rows)
    assert found(spark, rows) == expected and sum("None, " not in x for x in expected) > 20


def test_no_words(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, ""), (3, "a few words once")]) == []


def test_every_word_is_in_its_filter_and_few_others_are():
    rng = np.random.default_rng(2)
    words = rng.integers(97, 123, (20_000, 9), dtype=np.uint8)
    shape = spelling.Shape({9: 10_000})
    h = spelling.mixed(spelling.raw_hash(words))
    bits = np.zeros((shape.blocks[9], 8), dtype=np.uint64)
    block = shape.place(9, h[:10_000])[1]
    for k in range(8):
        np.bitwise_or.at(bits[:, k], block, spelling.bit(spelling.mixed(h[:10_000]), k))
    hits = spelling.known(shape, {(9, 0): bits}, 9, spelling.raw_hash(words))
    assert set(range(10_000)) <= set(hits.tolist()) and len(hits) < 10_200
