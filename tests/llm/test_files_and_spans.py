"""Sharding, token files, fingerprints and personal data against brute force."""
import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_text_operators import AWKWARD, SF, frame, rows_of
from tidewatch.llm import fingerprints, pii, sharding, token_files
from tidewatch.llm.queries import QUERIES, WORD_BPE


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# ---- sharding ----------------------------------------------------------------------------------------

def check_shards(rows, found, tolerance):
    got = [tuple(r)[:7] for r in found.collect()]
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(map(repr, ((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows))) == sorted(map(repr, (g[:3] for g in got)))
    slots, sums = {}, {}
    for _, n, _, law, shard, slot, grown in got:
        assert law == "bytes" and 0 <= shard < 16 and grown is None
        slots.setdefault(shard, []).append(slot)
        sums[shard] = sums.get(shard, 0) + n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for g in got:
        groups.setdefault((g[1], g[2]), set()).add(g[4])
    assert tolerance is None or all(len(s) == 1 for s in groups.values()) and max(sums.values()) - min(sums.values()) <= tolerance


def test_shards(spark, documents, monkeypatch):
    check_shards(documents, QUERIES["op1_shards"](spark, SF), 64)
    monkeypatch.setattr(sharding, "BUCKET", 40)
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    check_shards(documents, QUERIES["op1_shards"](spark, SF), 40000)
    check_shards(AWKWARD, sharding.shard_by_bytes(frame(spark, AWKWARD)), None)
    assert sharding.shard_by_bytes(frame(spark, [])).count() == 0


def test_differencing_by_hand():
    """The textbook case: 8, 7, 6, 5, 4 differ by 2 after two-way differencing."""
    sums = np.array([[n, 0] for n in (8, 7, 6, 5, 4)])
    total, where = sharding.difference(sums)
    assert sorted(total) == [14, 16]
    assert sorted(sum(n for n, w in zip((8, 7, 6, 5, 4), where[:, 0]) if w == s) for s in (0, 1)) == [14, 16]
    heap = [-8, -7, -6, -5, -4]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = -heapq.heappop(heap), -heapq.heappop(heap)
        heapq.heappush(heap, b - a)
    assert -heap[0] == 2


# ---- token files -------------------------------------------------------------------------------------

def check_token_files(rows, found):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    encoded = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows]
    crc = lambda ids: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: r[1])
    assert sorted(map(repr, ((i, len(ids), crc(ids)) for i, ids in encoded))) == sorted(repr((g[0], g[2], g[3])) for g in got)
    at = 0
    for g in got:
        assert g[1] == at
        at += g[2]
    ids = [g[0] for g in got if g[0] is not None]
    assert ids == sorted(ids) and all(g[0] is None for g in got[:len(got) - len(ids)])


def test_token_files(spark, documents, monkeypatch):
    check_token_files(documents, QUERIES["op7_token_files"](spark, SF))
    monkeypatch.setattr(token_files, "BLOCK", 300)
    monkeypatch.setattr(token_files, "PART_IDS", 5000)
    odd = [*AWKWARD, (20, "\x00 ΑΣ ΣΟΦΟΣ İstanbul <|startoftext|>don't<|endoftext|> É é ǅ ½²")]
    check_token_files(odd, token_files.written_and_read(frame(spark, odd), WORD_BPE))
    assert token_files.written_and_read(frame(spark, []), WORD_BPE).count() == 0


def test_codes_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n, limit in ((2, 16), (5, 3), (40, 6), (300, 16)):
        counts = rng.integers(1, 10**6, n) ** rng.integers(1, 3, n)
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and abs(sum(2.0 ** -lengths) - 1) < 1e-12
        if limit == 16:
            heap = [(int(c), [k]) for k, c in enumerate(counts)]
            depth = [0] * n
            heapq.heapify(heap)
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                for k in a[1] + b[1]:
                    depth[k] += 1
                heapq.heappush(heap, (a[0] + b[0], a[1] + b[1]))
            assert max(depth) > limit or sum(counts * lengths) == sum(c * d for c, d in zip(counts.tolist(), depth))
    assert token_files.code_lengths(np.array([7])).tolist() == [1]
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, dtype=np.int64), 3)


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.minimum(rng.zipf(1.2, 200000), 49407), minlength=49408) + 1
    book = token_files.Codebook(np.arange(49408), token_files.code_lengths(counts))
    for n in (0, 1, 127, 128, 129, 5000):
        ids = rng.integers(0, 49408, n)
        bits, checkpoints = book.pack(ids)
        assert (book.unpack(bits, checkpoints, n) == ids).all()


# ---- fingerprints ------------------------------------------------------------------------------------

def check_fingerprints(rows, found):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    expected = []
    for (i, text), (_, following) in zip(rows, [*rows[1:], *rows[:1]]):
        text, following = text or "", following or ""
        k = len(text) // 4
        expected.append((i, len(text), hashlib.sha256((text[:len(text) - k] + following[:k]).encode()).hexdigest()))
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)[:3]) for r in found.collect())


def test_fingerprints(spark, documents, monkeypatch):
    found = QUERIES["op8_fingerprints"](spark, SF)
    check_fingerprints(documents, found)
    check_search(found.collect())
    monkeypatch.setattr(fingerprints, "CHUNK_ROWS", 7)
    monkeypatch.setattr(fingerprints, "PART_ROWS", 100)
    again = fingerprints.edited_and_next(spark.read.parquet(f"{SF}/documents.parquet"))
    check_fingerprints(documents, again)
    assert rows_of(again) == rows_of(found)
    unique = [r for r in AWKWARD if r[0] is not None]
    check_fingerprints(unique, fingerprints.edited_and_next(frame(spark, unique)))
    check_fingerprints([(3, "only one here")], fingerprints.edited_and_next(frame(spark, [(3, "only one here")])))
    assert fingerprints.edited_and_next(frame(spark, AWKWARD)).count() == len(AWKWARD)
    assert fingerprints.edited_and_next(frame(spark, [])).count() == 0
    stats = found.filter("n_chars > 1500").agg(F.avg("near_edited"), F.avg("near_next"), F.min("near_edited"), F.max("near_edited")).first()
    assert stats[0] > 0.6 and stats[1] < 0.2 and 0 <= stats[2] and stats[3] <= 1


def test_equal_texts_have_equal_fingerprints_and_votes_are_majorities(spark):
    rows = [(1, "A b c d"), (2, "a B  C\td"), (3, "x y"), (4, None), (5, "")]
    got = {r["doc_id"]: (r["f0"], r["f1"]) for r in fingerprints.fingerprints(frame(spark, rows)).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5]
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", None)], "a string, b string").select(F.xxhash64("a", "b").alias("h")).withColumn("g", F.xxhash64("h")).collect()
    for word, column in zip(got[1], "hg"):
        expected = sum(1 << k for k in range(64) if sum((r[column] >> k) & 1 for r in pairs) * 2 > 4)
        assert word & ((1 << 64) - 1) == expected


def test_all_pairs_within_a_radius(spark):
    rng, prints = random.Random(4), []
    for _ in range(60):
        base = rng.getrandbits(128)
        prints.append(base)
        for _ in range(4):
            for bit in rng.sample(range(128), rng.randrange(6)):
                base ^= 1 << bit
            prints.append(base)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame_ = spark.createDataFrame([(signed(p & ((1 << 64) - 1)), signed(p >> 64)) for p in prints], "f0 long, f1 long")
    for radius in (0, 3):
        got = {(frozenset([(r["a0"], r["a1"]), (r["b0"], r["b1"])]), r["distance"]) for r in fingerprints.within_radius(frame_, radius).collect()}
        pair = lambda p: (signed(p & ((1 << 64) - 1)), signed(p >> 64))
        assert got == {(frozenset([pair(a), pair(b)]), (a ^ b).bit_count()) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= radius}


def check_search(rows):
    """n_within against the distances of all fingerprints of the rows."""
    prints = [int(r["fingerprint"], 16) for r in rows]
    for r, own in zip(rows, prints):
        asked = r["doc_id"] is not None and r["doc_id"] % fingerprints.QUERY_STEP == 0
        assert r["n_within"] == (sum((own ^ p).bit_count() <= fingerprints.RADIUS for p in prints) - 1 if asked else None)


def test_search_of_the_query_documents(spark, monkeypatch):
    """Equal and close texts, a third of the rows copies of one text, repeated and missing ids; broadcast and shuffled queries agree."""
    rng = random.Random(4)
    long = [f"w{rng.randrange(9000)}" for _ in range(400)]
    rows = [(None, "no id"), (0, " ".join(long)), (0, " ".join(long)), (100, None), (100, "")]
    rows += [(k, "the same text in many rows") for k in range(1, 200)]
    rows += [(200 + k, " ".join([*long[:k], "changed", *long[k + 1:]])) for k in range(301)]
    found = fingerprints.edited_and_next(frame(spark, rows)).collect()
    check_search(found)
    assert sum(r["n_within"] or 0 for r in found) > 200
    monkeypatch.setattr(fingerprints, "MAX_BROADCAST_LEADS", 3)
    assert sorted(map(repr, fingerprints.edited_and_next(frame(spark, rows)).collect())) == sorted(map(repr, found))


@pytest.mark.parametrize("radius", [0, 3, 12])
def test_near_counts_equal_all_distances(spark, radius):
    rng = random.Random(radius)
    prints = [rng.getrandbits(128) for _ in range(40)]
    for _ in range(300):
        p = rng.choice(prints)
        for bit in rng.sample(range(128), rng.randrange(0, radius + 3)):
            p ^= 1 << bit
        prints.append(p)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pair = lambda p: (signed(p & ((1 << 64) - 1)), signed(p >> 64))
    df = spark.createDataFrame([pair(p) for p in prints], "f0 long, f1 long")
    asked = prints[::5] + [rng.getrandbits(128)]
    got = {(r["f0"], r["f1"]): r["n"] for r in fingerprints.near_counts(df, spark.createDataFrame([pair(p) for p in asked], "f0 long, f1 long"), radius).collect()}
    want = {pair(a): sum((a ^ p).bit_count() <= radius for p in prints) for a in asked}
    assert got == {k: n for k, n in want.items() if n}


# ---- personal data -----------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + j % 2), 10)) for j, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def check_base(rows, found):
    expected = []
    for i, text in rows:
        spans = base_spans(text)
        joined = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
        expected.append((i, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest()))
    got = found.collect()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)[:6]) for r in got)
    return got


PIECES = ["a@b.c_d@e.f", "x..y@z-.q.", "@", "a@b", "+1 (017) 555-7713", "+1+22 333 4444 5555", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.1.1.1", "4845168114407329", "4845 1681-1440 7329", "9 9 9", "é", "🙂", " ", ".", "-", "0", "\n", "bob@mail.example.com",
          "99999999999999999999.1.1.1", "a.b@c.d.e-f"]


def test_base_spans(spark, documents, monkeypatch):
    got = check_base(documents, QUERIES["op6_personal_data"](spark, SF))
    assert sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got) > 10
    rng = random.Random(6)
    odd = [*AWKWARD, *((100 + k, "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 12)))) for k in range(400)),
           (900, "1 " * 30000), (901, "a" * 100000), (902, "a@b" + ".c" * 30000), (903, "+1" + " " * 50000), (904, "9" * 40000), (905, " a@b.cc 10.1.2.3" * 1500)]
    check_base(odd, pii.report(pii.find_spans(frame(spark, odd))))
    assert pii.find_spans(frame(spark, [])).count() == 0


def test_patterns_discover_identifiers(spark):
    rows = [(k, f"text {k} call me +1 (200) 555-{1000 + k} bye") for k in range(12)] + [(50, "please call me 555-0199x today"), (51, "call me maybe"), (52, "number is 555-0199y today")]
    found = {r["doc_id"]: r for r in pii.report(pii.find_spans(frame(spark, rows))).collect()}
    assert found[50]["spans"] == "phone:15:24" and found[50]["n_phone"] == 0
    assert found[51]["spans"] == found[52]["spans"] == "" and all(found[k]["n_phone"] == 1 for k in range(12))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    assert clean[50] == "please call me <phone> today" and clean[0] == "text 0 call me <phone> bye" and clean[51] == "call me maybe"


def test_three_generations_of_patterns(spark):
    """Seeds stand after "call me"; badges there and before "on duty"; tags there and between "room" and "today"; the last ones only
    in that. Decoys stand in contexts of their own, or where seeds are rare."""
    rng, rows, wanted, decoys = random.Random(9), [], set(), set()

    def put(text, value=None, kind=None):
        noise = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4)]
        text = f"{noise[0]} {noise[1]} {text} {noise[2]} {noise[3]}"
        if value:
            (wanted if kind else decoys).add((len(rows), text.index(value), text.index(value) + len(value)))
        rows.append((len(rows), text))

    for k in range(900):
        put(f"call me +1 (200) 555-{1000 + k}")
    for k in range(160):
        badge, tag = f"x-{70000 + k}", f"{k + 100}t{5000 + k}"
        put(f"call me {badge}", badge, "phone")
        put(f"{badge} on duty", badge, "phone")
        if k < 30:
            put(f"{tag} on duty", tag, "phone")
            put(f"room {tag} today", tag, "phone")
        if k < 2:
            put(f"room qq{8800 + k} today", f"qq{8800 + k}", "phone")
        put(f"page number {20000 + k}", f"{20000 + k}", None)
        if k < 40:
            put(f"see also {30000 + k}", f"{30000 + k}", None)
            put(f"see also +1 (300) 555-{1000 + k}")
    got = {(r["doc_id"], s["start"], s["end"]) for r in pii.find_spans(frame(spark, rows)).collect() for s in r["spans"] if s not in r["base"]}
    assert len(got & wanted) > 0.95 * len(wanted) and not got & decoys and got <= wanted
    assert {w for w in wanted if "qq" in rows[w[0]][1]} <= got


def test_redaction_keeps_the_rest(spark):
    rows = [*AWKWARD, (30, "🙂 a@b.cc 1.2.3.4 é"), (31, None)]
    got = pii.redact(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"] and got.count() == len(rows)
    assert got.filter("doc_id = 30").first()["text"] == "🙂 <email> <ip> é"
    assert got.filter("doc_id = 30").first()["n_chars"] == len("🙂 <email> <ip> é")
    untouched = sorted(repr((r["doc_id"], r["text"])) for r in got.filter("doc_id is null or doc_id < 20").collect())
    assert untouched == sorted(repr(r) for r in AWKWARD)


def test_many_texts_at_once_equal_the_library(monkeypatch):
    """Random strings of awkward pieces in batches, with a table so small that it is emptied often."""
    monkeypatch.setattr(token_files, "SLOT_BITS", 8)
    monkeypatch.setattr(token_files, "SLOTS", 256)
    library, table, rng = Tokenizer.from_file(WORD_BPE), token_files.WordTable(WORD_BPE), random.Random(3)
    bits = ["'", "'s", "'re", "'ll", "'v", "'d", "'m", "'t", " ", "  ", "\n", "a", "b", "é", "ß", "İ", "Σ", "ς", "x1", "22", "!", "?!", "''", "'S", "'LL", "<|", "<|endoftext|>", "|>", "²", "½", "日本", "🙂", "ª", "µ", "º", "×",
            "÷", "¡", "\xa0", "\xad", "\x1c", "\x85", "word", "Longerwordthansixteenbytes", "z" * 49, "ñañañañaña", "ǅ", "ɏ", "Ā", "\x00", "'é", "'ſ", "K", "Å"]
    for _ in range(400):
        texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) or None for _ in range(rng.randint(1, 30))]
        got = [np.frombuffer(x, dtype="<u2").tolist() for x in table.encode(texts)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
