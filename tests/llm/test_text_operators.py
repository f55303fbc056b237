"""The operators over text against brute force, on a small table and on rows made to be awkward."""
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from tidewatch.llm import bpe, decontaminate, dedup, fingerprints, language, pii, quality, sharding, token_files
from tidewatch.llm.queries import BYTE_BPE, QUERIES, SQL, WORD_BPE

SF = "/root/testdata/sf0.01"
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
LABELS = "doc_id long, quality int, toxic int"
LONG = "word " * 30000 + "x" * 50000 + " \n\t  " * 4000 + "end's"
AWKWARD = [(1, None), (2, ""), (3, "  \n "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "no id at all here"), (None, None), (6, "é́   ² ½ don't 'RE 're ''s  <|endoftext|> a<|endoftext|>"),
           (7, "ONE TWO three four five six seven eight nine ten"), (8, LONG), (9, LONG), (10, "日本語 текст 🙂🙂 \x1c\x85 end  "), (11, "!" * 3000)]


def frame(spark, rows, schema=DOCS):
    width = len(schema) - 2
    return spark.createDataFrame([(*r, *[None] * width) for r in rows], schema)


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def check_tokens(rows, found):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    expected = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in found.collect())


def test_bpe_equals_the_library(spark, documents):
    check_tokens(documents, QUERIES["op2_bpe_round_trip"](spark, SF))
    check_tokens(AWKWARD, bpe.round_trip(frame(spark, AWKWARD), BYTE_BPE))
    assert bpe.round_trip(frame(spark, []), BYTE_BPE).count() == 0


def test_bpe_streams_long_words():
    vocabulary = bpe.Vocabulary(BYTE_BPE)
    encoder, tokenizer, rng = bpe.Encoder(vocabulary), Tokenizer.from_file(BYTE_BPE), random.Random(3)
    assert vocabulary.lookahead < 2000
    for alphabet in ("ab", "the", " ", " \n", "0123", "-=", "aA", "é ", "a'", "'s t", "e.", "<|endoftext|>"):
        for n in (5, 40000, 70001):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            got = b"".join(encoder.chunks(bpe.in_pieces(text)))
            assert got == b"".join(x.to_bytes(4, "little") for x in tokenizer.encode(text, add_special_tokens=False).ids), (alphabet, n)


def test_special_token_right_after_a_long_run():
    encoder, tokenizer = bpe.Encoder(bpe.Vocabulary(BYTE_BPE)), Tokenizer.from_file(BYTE_BPE)
    for mark in "! -":
        for n in (40000, 3 * bpe.CHUNK - 5, 3 * bpe.CHUNK - 1):
            text = mark * n + "<|endoftext|>" + mark * 3 + "tail"
            want = b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)
            assert b"".join(encoder.chunks(bpe.in_pieces(text))) == want, (mark, n)


def test_bpe_ids_decode(spark):
    rows = frame(spark, [(i, t) for i, t in AWKWARD if t and len(t) < 5000])
    back = bpe.decode_documents(bpe.encode_documents(rows, BYTE_BPE), BYTE_BPE)
    assert sorted(map(repr, rows.select("doc_id", "text").collect())) == sorted(map(repr, back.collect()))


def words4(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items):
    windows = {}
    for item, text in items:
        w = words4(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(item))
    sizes = sorted({len(k) for k in windows})
    out = []
    for i, text in rows:
        w, hit, found = words4(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (o := windows.get(tuple(w[k:k + n]))):
                    hit.update(range(k, k + n))
                    found |= o
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_benchmark_hits(spark, documents, monkeypatch):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = QUERIES["op4_benchmark_hits"](spark, SF)
    assert rows_of(found) == brute_hits(documents, items) and found.filter("contaminated").count() > 0
    odd = [(90, "one two"), (91, None), (92, "!!"), (93, "word word word word word word word word word word word"), (94, "two three four"), (95, "x" * 50000)]
    bench = spark.createDataFrame(odd, "item_id long, text string")
    assert rows_of(decontaminate.report(decontaminate.decontaminate(frame(spark, AWKWARD), bench))) == brute_hits(AWKWARD, odd)
    assert decontaminate.drop_contaminated(frame(spark, AWKWARD), bench).filter("doc_id in (4, 5, 7, 8, 9)").count() == 0
    assert rows_of(decontaminate.report(decontaminate.decontaminate(frame(spark, AWKWARD), bench.limit(0)))) == brute_hits(AWKWARD, [])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60000)
    assert rows_of(decontaminate.report(decontaminate.decontaminate(frame(spark, AWKWARD), bench.unionByName(bench)))) == brute_hits(AWKWARD, odd)


def brute_components(rows):
    sets, parent = {}, {}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        parent[i] = i
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for ids in where.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return sorted(repr((i, len(s), root(i), root(i) == i)) for i, s in sets.items())


def test_near_duplicates(spark, documents):
    found = QUERIES["op5_near_duplicates"](spark, SF)
    assert rows_of(found) == brute_components(documents) and found.filter("not kept").count() > 0
    plain = [r for r in AWKWARD if r[0] not in (None, 5)]
    assert rows_of(dedup.components(frame(spark, plain))) == brute_components(plain)
    got = dedup.keep_one(frame(spark, AWKWARD))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(map(str, [1, 2, 3, 4, None, None, 6, 7, 8, 10, 11]))
    assert dedup.components(frame(spark, [])).count() == 0


def test_near_duplicates_of_one_large_loose_group(spark, monkeypatch):
    """Chains of edits of one text that share a passage, with tiny leaves: all nodes stay large and go through the blocks."""
    monkeypatch.setattr(dedup, "SMALL", 4)
    rng, rows = random.Random(5), []
    passage = [f"p{k}" for k in range(40)]
    for chain in range(6):
        text = [f"c{chain}w{k}" for k in range(60)]
        for step in range(25):
            text = list(text)
            text[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(passage + text)))
    rng.shuffle(rows)
    assert rows_of(dedup.components(frame(spark, rows))) == brute_components(rows)


def test_clashing_extra_columns_are_ignored(spark):
    """Columns that bear the names of the operators' own."""
    rows = [r for r in AWKWARD if r[0] not in (5, None)]
    plain = frame(spark, rows)
    busy = plain
    for name in ("ids", "node", "id", "class", "label", "held_out", "x", "y", "digest", "shard", "size", "text_key", "rank", "chunk", "base", "kind", "row", "n_tokens", "key"):
        busy = busy.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, None, None)], LABELS).withColumn("text", F.lit("z")).withColumn("x", F.lit(1))
    bench = spark.createDataFrame([(90, "one two", 1)], "item_id long, text string, doc_id long")
    jobs = [lambda d: bpe.round_trip(d, BYTE_BPE), lambda d: quality.score_quality(d, labels), lambda d: decontaminate.report(decontaminate.decontaminate(d, bench)), dedup.components, language.identify,
            sharding.shard_by_bytes, lambda d: pii.report(pii.find_spans(d)), lambda d: token_files.written_and_read(d, WORD_BPE), fingerprints.edited_and_next]
    for job in jobs:
        assert rows_of(job(busy)) == rows_of(job(plain))
    for job in (lambda d: quality.accept(d, labels), dedup.keep_one, lambda d: decontaminate.drop_contaminated(d, bench), pii.redact):
        assert job(busy).columns == busy.columns and rows_of(job(busy).select("doc_id", "text")) == rows_of(job(plain).select("doc_id", "text"))


def test_sql_of_benchmark_hits(spark):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(SQL["op4_benchmark_hits"])
    names = [d[0] for d in found.description]
    assert sorted(map(repr, found.fetchall())) == rows_of(QUERIES["op4_benchmark_hits"](spark, SF).select(*names))


def test_quality_on_held_out_rows(spark):
    found = QUERIES["op3_quality_scores"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows) > 20
    odd = quality.score_quality(frame(spark, AWKWARD), labels)
    assert odd.count() == len(AWKWARD) and odd.filter("score is null or score < 0 or score > 1").count() == 0
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.score_quality(frame(spark, AWKWARD), none).collect()} == {0.5}
    assert quality.score_quality(frame(spark, []), labels).count() == 0
    assert quality.accept(frame(spark, AWKWARD), none).count() == len(AWKWARD)


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op10_languages"](spark, SF).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows) > 20
    odd = {r["doc_id"]: r for r in language.identify(frame(spark, AWKWARD[:5])).collect()}
    assert all(r["lang_pred"] == "und" for r in odd.values())
    mixed = docs.unionByName(frame(spark, [(10**6, None), (10**6 + 1, "12 !!"), (10**6 + 2, "the and of")]))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(mixed).filter(F.col("doc_id") >= 10**6).collect()}
    assert got == {10**6: "und", 10**6 + 1: "und", 10**6 + 2: "en"}
