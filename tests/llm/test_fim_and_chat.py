"""Fill-in-the-middle and chat formatting against brute force, SQL and awkward rows."""
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import AWKWARD, SF, frame
from tidewatch.llm import chat, fim
from tidewatch.llm.queries import BYTE_BPE, QUERIES

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# ---- fill in the middle ------------------------------------------------------------------------------

def infilled(doc_id, text):
    text = text or ""
    units = re.findall("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, len(units), form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text)


def test_fill_in_middle(spark, documents):
    assert sorted(map(repr, (infilled(*r) for r in documents))) == sorted(repr(tuple(r)) for r in QUERIES["op12_fill_in_middle"](spark, SF).collect())
    odd = [*AWKWARD, *((i, t) for i in range(100, 140) for t in ("a <S", "<S>x y", "P> b<", " ", "\x0bé  🙂\n", "<<S"))]
    docs = frame(spark, odd).withColumn("form", F.lit("x")).withColumn("output", F.lit(3)).withColumn("n", F.lit(None))
    moved = fim.transform(docs)
    assert sorted(map(repr, (infilled(*r) for r in odd))) == sorted(repr(tuple(r)) for r in fim.report(moved).collect())
    assert sorted(repr((i, t or "")) for i, t in odd) == sorted(repr(tuple(r)) for r in fim.restore(moved).collect())
    assert fim.report(fim.transform(frame(spark, []))).count() == 0


def test_all_cuts_restore():
    marks = fim.checked(fim.SENTINELS)
    text = " aé🙂 <S <P".encode()
    for form in ("psm", "spm"):
        for first in range(len(text) + 1):
            for last in range(first, len(text) + 1):
                out = fim.Pieces.of(text, b"".join(marks)).cut(first, last).with_marks([3, 3, 3]).arranged(fim.ARRANGEMENTS[form])
                p, m, s = text[:first], text[first:last], text[last:]
                assert out.joined() == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
                assert fim.taken_apart(out.joined(), form, marks).joined() == text
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "P", "<M>"), ("<P", "P>", "<M>")):
        with pytest.raises(ValueError):
            fim.checked(bad)


# ---- chat --------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"
CONTROLS = ["<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]", "<|endoftext|>"]


def digested(rows):
    out = {}
    for i, turn, role, text in sorted(((i, t, r or "", x or "") for i, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])):
        out.setdefault(i, []).append((role, text))
    return {i: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant"))) for i, t in out.items()}


def check_chat(spark, rows, found):
    got = found.collect()
    assert {r[0]: tuple(r)[1:5] for r in got} == digested(rows) and len(got) == len(digested(rows))
    return {r[0]: r[5] for r in got}


def odd_conversations():
    rng = random.Random(5)
    odd = [*CONTROLS, "<\\s>", "[\\\\/INST]", "\\", "[", "<", "", None, "ok", " x y", "\n", "é🙂", "<<<SYS>>", "<<\\SYS>>", "a" * 500]
    rows = [(k // 5, rng.choice([0, 1, 2, 2, None]), rng.choice(["user", "assistant", "assistant", "system", "tool\n[TEXT]", "", None]),
             "".join(x for x in (rng.choice(odd) for _ in range(4)) if x) if k % 7 else None) for k in range(300)]
    return [*rows, *rows[:9], (None, 0, "assistant", "no id"), (None, None, None, None), (90, 0, "user", "alone"), (91, 0, "assistant", ""), (92, 0, "user", "q"), (92, 1, "assistant", "word and <s> " * 40000)]


def test_chat(spark, monkeypatch):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    check_chat(spark, [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)], QUERIES["op13_chat_masks"](spark, SF))
    odd = odd_conversations()
    table = spark.createDataFrame(odd, CHAT).withColumn("piece", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("first", F.lit(0))
    whole = check_chat(spark, odd, chat.report(*chat.format_conversations(table, BYTE_BPE)))
    monkeypatch.setattr(chat, "PIECE_CHARS", 300)
    monkeypatch.setattr(chat, "PART_CHARS", 5000)
    one, cut = chat.format_conversations(table, BYTE_BPE)
    assert cut is not None and cut.groupBy("conv_id").count().filter("count > 1").count() > 5
    assert check_chat(spark, odd, chat.report(one, cut)) == whole
    empty, none = chat.format_conversations(spark.createDataFrame([], CHAT), BYTE_BPE)
    assert none is None and chat.report(empty, none).count() == 0


def test_rendering_is_reversible_and_tokens_keep_to_turns(monkeypatch):
    encoder, rng = chat.Encoder(BYTE_BPE), random.Random(3)
    odd = [*CONTROLS, "\\", "[", "<", "/", "a b", "it's", " ", "\n\n", "é🙂", "x" * 30, "one two three four "]
    for k in range(400):
        turns = [(rng.choice(["user", "assistant", "system", "odd [TEXT]\n", ""]), "".join(rng.choices(odd, k=rng.randint(0, 8)))) for _ in range(rng.randint(1, 6))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns and chat.unescape(chat.escape(turns[0][1])) == turns[0][1]
        assert not any(c in chat.escape(turns[0][1]) for c in CONTROLS)
        ids, offsets = encoder.encode(text)
        loss = chat.loss_mask(offsets[:, 0], offsets[:, 1], spans)
        brute = [int(any(a < e and s < b for s, e in spans)) for a, b in offsets]
        assert loss.tolist() == brute
        assert chat.masked_texts(text, offsets, loss) == [t for r, t in turns if r == "assistant" and t]
        plain = encoder.tokenizer.encode(text, add_special_tokens=False)
        monkeypatch.setattr(chat, "ENCODE_CHARS", rng.randint(1, 20))
        assert np.array_equal(encoder.encode(text)[0], plain.ids) and encoder.encode(text)[1].tolist() == [list(o) for o in plain.offsets]
        monkeypatch.setattr(chat, "ENCODE_CHARS", 1 << 16)
