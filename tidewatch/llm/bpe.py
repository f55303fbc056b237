"""Byte-level BPE encoding as a streaming transducer with bounded lookahead, and decoding with a byte-to-text state machine.

Lookahead. Let two texts share a prefix. While merges are applied in rank order their segmentations agree up to a frontier that
starts at the end of the shared prefix. The frontier only moves when a merge (u, v) joins the token before it with the token
after it in one of the texts, and then by len(u). For the next such merge (u', v') of higher rank, v' must have grown from a
token that starts with u, so u is on the left spine of v'. The longest chain of this kind, found by one pass over the merge list,
bounds how far back unread text can reach: tokens that end at least that many bytes before the end of what was read are final.
This needs a proper list (the parts of a merge are made by earlier merges), which is checked.
"""
from __future__ import annotations

import codecs
import gc
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CHUNK = 1 << 14                # characters of text handled at a time
MEMO = 1 << 19                 # words whose ids a worker remembers
PAIRS = 1 << 19                # neighbouring tokens that it remembers
MEMO_WORD = 48
# The pattern that splits text before the merges.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
# The same on text of this alphabet (Latin letters, ASCII digits, no other numbers), where the faster engine agrees.
OTHER_ALPHABET = re.compile("[^\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
LATIN_PATTERN = re.compile(rf" ?[{LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{LATIN}]+|\s+(?!\S)|\s+")
CUT = re.compile(r"(?<=\S)(?= )")
TAIL = 16                      # characters kept back at the end of a chunk: the longest contraction or special token that may go on


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        symbols = byte_symbols()
        self.bytes_of = {i: bytes(symbols[c] for c in token) for token, i in data["model"]["vocab"].items()}
        self.ids = ids = {b: i for i, b in self.bytes_of.items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        parts = [tuple(bytes(symbols[c] for c in side) for side in pair) for pair in pairs]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(parts)))}
        self.lookahead = lookahead(parts)
        self.agree = Neighbours(self)
        self.longest = [1] * 256
        for token in ids:
            self.longest[token[0]] = max(self.longest[token[0]], len(token))
        size = max(self.bytes_of) + 1
        self.table = [self.bytes_of.get(i, b"") for i in range(size)]
        self.splitter = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None


class Neighbours(dict):
    """(token, token) to whether the merges of their joined bytes give back just these two, token to whether they give it alone.

    Up to PAIRS answers are remembered.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary

    def __missing__(self, tokens: tuple[int, int] | int) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        alone = isinstance(tokens, int)
        expected = [tokens] if alone else list(tokens)
        self[tokens] = found = self.merged(b"".join(self.v.bytes_of[t] for t in expected)) == expected
        return found

    def merged(self, data: bytes) -> list[int]:
        """Merges applied one rank at a time."""
        ids, merges = [self.v.byte_ids[b] for b in data], self.v.merges
        while len(ids) > 1:
            found = [(merges[p], p) for p in zip(ids, ids[1:]) if p in merges]
            if not found:
                break
            (_, made), (a, b) = min(found)
            out, k, n = [], 0, len(ids)
            while k < n:
                if ids[k] == a and k + 1 < n and ids[k + 1] == b:
                    out.append(made)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids


def lookahead(parts: list[tuple[bytes, bytes]]) -> int:
    """Bytes that a proper merge list may need to read past a token before the token is final."""
    made: dict[bytes, tuple[bytes, bytes]] = {}
    best: dict[bytes, int] = {}
    most = 0
    for left, right in parts:
        for side in (left, right):
            if len(side) > 1 and side not in made:
                raise ValueError("the merge list is not proper: a part of a merge is made later")
        spine, reach = right, best.get(right, 0)
        while spine in made:
            spine = made[spine][0]
            reach = max(reach, best.get(spine, 0))
        chain = len(left) + reach
        best[left] = max(best.get(left, 0), chain)
        most = max(most, chain)
        made.setdefault(left + right, (left, right))
    return most


class WordTransducer:
    """Bytes of one word in, final token ids out; holds at most lookahead + longest token + one feed."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.pending, self.agree = vocabulary, b"", vocabulary.agree

    def segment(self, data: bytes) -> list[int]:
        """The ids of one run of bytes: longest token first, going back where neighbours would have merged differently.

        A sequence of tokens is what the merges make of their bytes exactly if that holds for every two neighbours, and at most
        one token can end at a position, so an end that led nowhere is never tried again.
        """
        ids, longest, agree, n = self.v.ids, self.v.longest, self.agree, len(data)
        out: list[int] = []
        ends, dead, at, limit = [0], set(), 0, n
        while at < n:
            end = min(limit, at + longest[data[at]])
            while end > at:
                token = ids.get(data[at:end])
                if token is not None and end not in dead and (agree[out[-1], token] if out else end < n or agree[token]):
                    break
                end -= 1
            if end > at:
                out.append(token)
                ends.append(end)
                at = limit = end
                limit = n
            else:                                               # nothing fits after the last token: shorten it
                dead.add(at)
                limit = at - 1
                out.pop()
                ends.pop()
                at = ends[-1]
        return out

    def feed(self, data: bytes) -> list[int]:
        self.pending += data
        if len(self.pending) < 2 * self.v.lookahead + 256:
            return []
        final, out, at = len(self.pending) - self.v.lookahead, [], 0
        for token in self.segment(self.pending):
            end = at + len(self.v.table[token])
            if end > final:
                break
            out.append(token)
            at = end
        self.pending = self.pending[at:]
        return out

    def finish(self) -> list[int]:
        out, self.pending = self.segment(self.pending), b""
        return out

    def whole(self, data: bytes) -> list[int]:
        out = []
        for at in range(0, len(data), 256):
            out += self.feed(data[at:at + 256])
        return out + self.finish()


class Encoder:
    """Text to ids; words seen before are looked up. ``chunks`` streams a text in bounded memory."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.memo = vocabulary, Memo(vocabulary)

    def words(self, text: str, pattern=None) -> list[str]:
        return (PATTERN if OTHER_ALPHABET.search(text) else LATIN_PATTERN).findall(text)

    def ids_of(self, text: str) -> bytes:
        """Ids of text that begins and ends at word boundaries, as little-endian 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.words(text)))

    def chunks(self, pieces: Iterator[str]) -> Iterator[bytes]:
        """Ids of a text that arrives in pieces. Holds a piece, and of a word that goes on only what is not final."""
        held = ""
        for piece in pieces:
            held += piece
            if len(held) < CHUNK:
                continue
            ready, held = self.cut(held)
            if ready is None:                                   # no word ends here: pass the open word through the transducer
                rest = yield from self.long_word(held, pieces)
                held = rest
            else:
                yield self.plain(ready)
        if held:
            yield self.plain(held)

    def cut(self, text: str) -> tuple[str | None, str]:
        """Split before a blank that follows a non-blank, where a word always begins, outside the tail."""
        at = text.rfind(" ", 1, len(text) - TAIL)
        while at > 0 and text[at - 1].isspace():
            at = text.rfind(" ", 1, at)
        return (None, text) if at <= 0 else (text[:at], text[at:])

    def long_word(self, held: str, pieces: Iterator[str]):
        """Words of a run without a safe blank, one at a time; returns what is left once it is short."""
        transducer = WordTransducer(self.v)
        ended = False
        while True:
            while len(held) < 2 * CHUNK and not ended:
                more = next(pieces, None)
                ended = more is None
                held += more or ""
            for special in self.v.special:
                at = held.find(special)
                if 0 <= at:
                    yield self.plain(held[:at + len(special)])
                    return held[at + len(special):]
            word = PATTERN.match(held).group()
            if len(word) < CHUNK or ended:
                if ended:
                    yield self.plain(held)
                    return ""
                yield np.asarray(transducer.whole(word.encode()), dtype="<u4").tobytes()
                held = held[len(word):]
                if self.cut(held)[0] is not None or len(held) < CHUNK:
                    return held
                continue
            kind = next(c for c in (r"\p{L}", r"\p{N}", r"\p{White_Space}", r"[^\p{White_Space}\p{L}\p{N}]") if regex.match(c, word[-1]))
            run = regex.compile(kind + "*")
            part = len(word) - TAIL
            yield np.asarray(transducer.feed(word[:part].encode()), dtype="<u4").tobytes()
            held = held[part:]
            while True:                                         # the open word: whole pieces of its class go straight through
                special = min((at for at in map(held.find, self.v.special) if at >= 0), default=len(held))
                n = min(run.match(held).end(), special)         # a special token ends the run, even one of its own class
                back = 1 if kind == r"\p{White_Space}" and n < special else 0      # the last blank of a run may belong to the next word
                if special == len(held) and n + TAIL > len(held) and not ended:
                    safe = max(0, n - TAIL)
                    yield np.asarray(transducer.feed(held[:safe].encode()), dtype="<u4").tobytes()
                    held = held[safe:]
                    more = next(pieces, None)
                    ended = more is None
                    held += more or ""
                    continue
                stop = n if n == len(held) else n - back
                yield np.asarray(transducer.feed(held[:stop].encode()) + transducer.finish(), dtype="<u4").tobytes()
                held = held[stop:]
                break
            if ended:
                yield self.plain(held)
                return ""
            if self.cut(held)[0] is not None or len(held) < CHUNK:
                return held

    def plain(self, text: str) -> bytes:
        if self.v.splitter is None or not any(s in text for s in self.v.special):
            return self.ids_of(text)
        return b"".join(np.asarray([self.v.special[p]], dtype="<u4").tobytes() if p in self.v.special else self.ids_of(p) for p in self.v.splitter.split(text) if p)


class Memo(dict):
    """Word to ids in bytes; misses go through the transducer. Starts over when full."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.transducer = WordTransducer(vocabulary)

    def __missing__(self, word: str) -> bytes:
        ids = np.asarray(self.transducer.whole(word.encode("utf-8", "replace")), dtype="<u4").tobytes()
        if len(word) <= MEMO_WORD:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids


def in_pieces(text: str) -> Iterator[str]:
    return (text[at:at + CHUNK] for at in range(0, len(text), CHUNK))


class Decoder:
    """Ids to text: token bytes run through an incremental UTF-8 state machine, bad bytes become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = vocabulary.table
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())))

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


_LOADED: dict[str, tuple[Vocabulary, Encoder]] = {}


def loaded(path: str) -> tuple[Vocabulary, Encoder]:
    """One vocabulary a worker; the path is read on the executors."""
    if path not in _LOADED:
        v = Vocabulary(path)
        _LOADED[path] = v, Encoder(v)
    return _LOADED[path]


def holds(path: str) -> bool:
    return path in _LOADED


def forget(path: str) -> None:
    _LOADED.pop(path, None)
    gc.collect()               # a vocabulary and its neighbours refer to each other


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the text as an array of token ids; null texts have none. Other columns are ignored."""
    def scan(batches):
        _, encoder = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [np.frombuffer(b"".join(encoder.chunks(in_pieces(t or ""))), dtype="<u4").astype(np.int32) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    def scan(batches):
        v, _ = loaded(path)
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                decoder = Decoder(v)
                texts.append(decoder.feed(np.asarray(ids or [], dtype="<u4").tobytes()) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "ids").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), streamed: neither ids nor decoded text of a document are held whole.

    Null texts count as empty: no tokens and the digests of nothing. Repeated documents each get a row, other columns are ignored.
    Workers outlive their tasks; unless ``keep``, they give up vocabulary and memos after each, as other work on them needs the memory.
    """
    def scan(batches):
        v, encoder = loaded(path)
        for batch in batches:
            out: list[list] = [[], [], []]
            for text in batch.column("text").to_pylist():
                decoder, ids_digest, text_digest, n = Decoder(v), hashlib.sha256(), hashlib.sha256(), 0
                for ids in encoder.chunks(in_pieces(text or "")):
                    n += len(ids) // 4
                    ids_digest.update(ids)
                    text_digest.update(decoder.feed(ids).encode())
                text_digest.update(decoder.finish().encode())
                for column, value in zip(out, (n, ids_digest.hexdigest(), text_digest.hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if not keep:
            del v, encoder
            forget(path)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
