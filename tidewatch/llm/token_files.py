"""Token ids in files: canonical length-limited Huffman codes in independent blocks.

A token folder holds three tables. ``codebook``: one row an id with its code length (at most CODE_BITS); codes follow from the
lengths in the canonical order (length, id). ``blocks``: whole documents in ascending order, about BLOCK ids a block, as one
big-endian bit string with the bit offset of every STRIDE-th id, so that a block is decoded from all checkpoints at once by table
look-up and without any other block. ``parts``: the ids of all parts before each part.
"""
from __future__ import annotations

import re
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.bpe import LATIN, OTHER_ALPHABET, byte_symbols
from tidewatch.llm.common import BASE, BATCH_BYTES, mixed, stored
from tidewatch.sources.sinks import scratch_folder

CODE_BITS, BLOCK, STRIDE, PART_IDS, MEMO = 16, 1 << 17, 128, 1 << 21, 1 << 17
SLOT_BITS, LONG = 21, 48
SLOTS = 1 << SLOT_BITS
# The pattern of the vocabulary's words, and the same on text of the plain Latin alphabet.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
LATIN_PATTERN = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LATIN}]+|[0-9]|[^\s0-9{LATIN}]+")
BLANK, LETTER, DIGIT, OTHER = range(4)
SHORT_ONE, SHORT_TWO = [ord(c) for c in "stmd"], [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]
LATIN_KINDS = np.array([BLANK if chr(c).isspace() else LETTER if re.match(f"[{LATIN}]", chr(c)) else DIGIT if 48 <= c < 58 else OTHER for c in range(1 << 11)], dtype=np.uint8)
KINDS = np.concatenate([LATIN_KINDS[:128], np.full(128, LETTER, dtype=np.uint8)])
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
BLOCK_SCHEMA = "part int, block int, start long, doc_ids array<long>, sizes array<int>, bits binary, checkpoints binary"


class WordEncoder(dict):
    """Normalized word to ids as little-endian 16-bit integers; the library's model is asked once a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        self.symbols = {b: c for c, b in byte_symbols().items()}
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {t: i.to_bytes(2, "little") for t, i in special.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, special)) + ")")

    def ids_of(self, word: bytes) -> list[int]:
        """Ids of a normalized word; printable ASCII stands for itself in the vocabulary."""
        text = word.decode("latin-1")
        return [t.id for t in self.tokenizer.model.tokenize(text if text.isascii() and text.isprintable() else text.translate(self.symbols))]

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.ids_of(word.encode("utf-8", "replace")), dtype="<u2").tobytes()
        if len(word) <= 48:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, (PATTERN if OTHER_ALPHABET.search(text) else LATIN_PATTERN).findall(normalized(text))))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            return self.plain(text)
        return b"".join(self.special[p] if p in self.special else self.plain(p) for p in self.splitter.split(text) if p)


def normalized(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))          # character by character: no final sigma


class WordTable:
    """Ids of the words of many texts at once.

    Texts of plain Latin letters are split by byte classes; words of up to 16 bytes, as two 64-bit numbers, are looked up in an open
    table of SLOTS places whose rows point into a pool of ids. Only words that it does not hold are taken one by one. Other texts,
    and those with a longer word of over LONG bytes or a special token, go through the word-by-word encoder.
    """

    def __init__(self, path: str):
        self.words = WordEncoder(path)
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.uint64)
        self.first, self.count = np.zeros(SLOTS, dtype=np.int64), np.zeros(SLOTS, dtype=np.int64)
        self.pool, self.pooled, self.held, self.long = np.zeros(1 << 16, dtype=np.uint16), 0, 0, {}

    def add_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Puts the ids of new words into the pool: (first, count)."""
        ids = [self.words.ids_of(w) for w in words]
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.uint16, count=int(count.sum()))
        if self.pooled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.pooled], np.zeros(max(len(flat), len(self.pool)), dtype=np.uint16)])
        self.pool[self.pooled:self.pooled + len(flat)] = flat
        first = self.pooled + np.cumsum(count) - count
        self.pooled += len(flat)
        return first, count

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of each word in the table, -1 if it is not there."""
        place = (mixed(low + high * np.uint64(BASE)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out, left = np.full(len(low), -1, dtype=np.int64), np.arange(len(low))
        while len(left):
            at = place[left]
            mine = (self.low[at] == low[left]) & (self.high[at] == high[left])
            out[left[mine]] = at[mine]
            left = left[~mine & (self.low[at] != 0)]
            place[left] = (place[left] + 1) & (SLOTS - 1)
        return out

    def insert(self, low: np.ndarray, high: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Adds distinct words that are not there."""
        place = (mixed(low + high * np.uint64(BASE)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        left = np.arange(len(low))
        while len(left):
            free = left[self.low[place[left]] == 0]
            _, one = np.unique(place[free], return_index=True)              # one word a free place
            free = free[one]
            at = place[free]
            self.low[at], self.high[at], self.first[at], self.count[at] = low[free], high[free], first[free], count[free]
            left = left[(self.low[place[left]] != low[left]) | (self.high[place[left]] != high[left])]
            place[left] = (place[left] + 1) & (SLOTS - 1)
        self.held += len(low)

    def split(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the words in normalized UTF-8 text of plain Latin letters that ends with white space."""
        kind = KINDS[data]
        if (data >= 128).any():                                             # a second byte is of its first one's kind
            lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
            code = ((data[lead].astype(np.int64) & 31) << 6) | (data[lead + 1] & 63)
            kind[lead] = kind[lead + 1] = LATIN_KINDS[code]
        change = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) + 1
        start, end = np.append(0, change), np.append(change, len(data))
        mark = np.flatnonzero((data[start] == 0x27) & (end - start == 1))
        mark = mark[kind[end[mark] % len(data)] == LETTER]                  # a lone ' before a letter may begin a short form
        if len(mark):
            one, two = data[end[mark]], data[np.minimum(end[mark] + 1, len(data) - 1)]
            rest = np.where(np.isin(one, SHORT_ONE), 1, np.where(np.isin(one.astype(np.int64) << 8 | two, SHORT_TWO) & (end[mark + 1] - start[mark + 1] > 1), 2, 0))
            end[mark] += rest
            start[mark + 1] += rest
        keep = (kind[start % len(data)] != BLANK) & (end > start)
        return start[keep], end[keep]

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, count) in the pool for each word of the text, which is followed by 16 further bytes."""
        size = end - start
        numbers = np.ndarray(len(data) - 15, dtype="<u8", buffer=data, strides=(1,))
        low, high = numbers[start] & LOW_BYTES[np.minimum(size, 8)], np.where(size > 8, numbers[start + np.minimum(size, 8)] & LOW_BYTES[np.clip(size - 8, 0, 8)], np.uint64(0))
        place = np.where(size > 16, 0, self.find(low, high))
        new = np.flatnonzero(place < 0)
        if len(new):
            seen: dict[bytes, int] = {}
            for k in new.tolist():
                seen.setdefault(data[start[k]:end[k]].tobytes(), k)
            at = np.fromiter(seen.values(), dtype=np.int64, count=len(seen))
            self.insert(low[at], high[at], *self.add_ids(list(seen)))
            place[new] = self.find(low[new], high[new])
        first, count = self.first[place], self.count[place]
        for k in np.flatnonzero(size > 16).tolist():
            word = data[start[k]:end[k]].tobytes()
            if word not in self.long:
                a, n = self.add_ids([word])
                self.long[word] = int(a[0]), int(n[0])
            first[k], count[k] = self.long[word]
        return first, count

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        some = [(k, normalized(t)) for k, t in enumerate(texts) if t and "<|" not in t and not OTHER_ALPHABET.search(t)]
        some = [(k, t) for k, t in some if not OTHER_ALPHABET.search(t)]
        parts = [t.encode() for _, t in some]
        data = np.frombuffer(b"\n".join(parts) + b"\n" * 17, dtype=np.uint8)
        start, end = self.split(data)
        bounds = np.searchsorted(start, np.cumsum([0] + [len(p) + 1 for p in parts]))
        large = {int(k) for k in np.searchsorted(bounds, np.flatnonzero(end - start > LONG), "right") - 1}
        if large:                                                           # left out here
            keep = np.ones(len(start), dtype=bool)
            for k in large:
                keep[bounds[k]:bounds[k + 1]] = False
            shift = np.append(0, np.cumsum(keep))
            start, end, bounds = start[keep], end[keep], shift[bounds]
        if self.held > SLOTS // 10 * 7 - len(start) or len(self.long) > SLOTS // 8:
            self.clear()
        if len(start) > SLOTS // 2:
            large = set(range(len(some)))
        else:
            first, count = self.lookup(data, start, end)
            at = np.append(0, np.cumsum(count))
            ids = self.pool[np.repeat(first - at[:-1], count) + np.arange(at[-1])].astype("<u2").tobytes()
            edges = (at[bounds] * 2).tolist()
            for (k, _), a, b in zip(some, edges, edges[1:]):
                out[k] = ids[a:b]
        fast = {k for i, (k, _) in enumerate(some) if i not in large}
        for k, text in enumerate(texts):
            if text and k not in fast:
                out[k] = self.words.encode(text)
        return out


_ENCODERS: dict[str, WordTable] = {}


def encode(docs: DataFrame, path: str, end_id: int | None = 1) -> DataFrame:
    """(doc_id, n_tokens, ids): 16-bit ids of each text, the end id appended; null counts as empty."""
    def scan(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = WordTable(path)                   # one a worker; the path is read on the executors
        encoder = _ENCODERS[path]
        end = b"" if end_id is None else end_id.to_bytes(2, "little")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            first, size = 0, 0
            for k, text in enumerate(texts):
                size += len(text or "")
                if size > BATCH_BYTES or k == len(texts) - 1:
                    ids = [x + end for x in encoder.encode(texts[first:k + 1])]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(ids)), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
                    first, size = k + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, n_tokens long, ids binary")


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents; each partition adds up its own first."""
    def scan(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype="<u2"), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    return encoded.select("ids").mapInArrow(scan, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = CODE_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(np.int64)
    packed, levels = np.empty(0, dtype=np.int64), []
    for _ in range(limit):
        row = np.concatenate([coins, packed])
        is_package = np.concatenate([np.zeros(n, dtype=bool), np.ones(len(packed), dtype=bool)])
        by_weight = np.argsort(row, kind="stable")
        row, is_package = row[by_weight], is_package[by_weight]
        levels.append(is_package)
        even = len(row) // 2 * 2
        packed = row[0:even:2] + row[1:even:2]
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for is_package in reversed(levels):
        chosen = is_package[:take]
        packages = int(chosen.sum())
        lengths[order[:take - packages]] += 1
        take = 2 * packages
    return lengths


class Codebook:
    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        steps = np.uint64(1) << (CODE_BITS - lengths).astype(np.uint64)
        first = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(steps)[:-1])) if len(ids) else np.zeros(0, dtype=np.uint64)    # left-aligned codes
        self.code, self.length = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.int64)
        self.code[ids], self.length[ids] = first >> (CODE_BITS - lengths).astype(np.uint64), lengths
        self.symbol = np.zeros(1 << CODE_BITS, dtype=np.uint16)                  # by the next CODE_BITS bits
        self.step = np.ones(1 << CODE_BITS, dtype=np.int64)
        filled = int(steps.sum())
        self.symbol[:filled], self.step[:filled] = np.repeat(ids, steps.astype(np.int64)), np.repeat(lengths, steps.astype(np.int64))

    def pack(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(bits, bit offsets of every STRIDE-th id as 32-bit integers)"""
        length, code = self.length[ids], self.code[ids]
        at = np.cumsum(length) - length
        total = int(at[-1] + length[-1]) if len(ids) else 0
        words = np.zeros(total // 64 + 2, dtype=np.uint64)
        if len(ids):
            word, room = at >> 6, 64 - (at & 63) - length
            inside = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
            starts = np.concatenate(([0], np.flatnonzero(np.diff(word)) + 1))
            words[word[starts]] = np.add.reduceat(inside, starts)
            over = np.flatnonzero(room < 0)
            words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return words.astype(">u8").tobytes()[:(total + 7) // 8], at[::STRIDE].astype("<u4").tobytes()

    def unpack(self, bits: bytes, checkpoints: bytes, n: int) -> np.ndarray:
        data = np.frombuffer(bits + bytes(4), dtype=np.uint8).astype(np.uint32)
        window = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        at, last = np.frombuffer(checkpoints, dtype="<u4").astype(np.int64), len(window) - 1
        out = np.empty((STRIDE, len(at)), dtype=np.uint16)
        for k in range(STRIDE):                                                  # all checkpoints advance together
            code = (window[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32((1 << CODE_BITS) - 1)
            out[k] = self.symbol[code]
            at = at + self.step[code]
        return out.T.reshape(-1)[:n]


def write_tokens(encoded: DataFrame, folder: str) -> None:
    """Write (doc_id, n_tokens, ids) in ascending doc_id order, ties by ids. ``encoded`` is read three times: store it first."""
    spark = encoded.sparkSession
    counts = sorted((r["id"], r["n"]) for r in id_counts(encoded).collect())              # at most 2^16 rows
    ids, n = np.array([c[0] for c in counts], dtype=np.int64), np.array([c[1] for c in counts], dtype=np.int64)
    lengths = code_lengths(n)
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, lengths)], "id int, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    shared = spark.sparkContext.broadcast(Codebook(ids, lengths))
    parts = max(1, -(-int(n.sum()) // PART_IDS))

    def scan(batches):
        part, block, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, sizes, held, size = [], [], [], 0

        def emit():
            data = np.frombuffer(b"".join(held), dtype="<u2")
            bits, checkpoints = shared.value.pack(data)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                                               pa.array([sizes], pa.list_(pa.int32())), pa.array([bits], pa.binary()), pa.array([checkpoints], pa.binary())],
                                              ["part", "block", "start", "doc_ids", "sizes", "bits", "checkpoints"])
        for batch in batches:
            for i, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                doc_ids.append(i)
                sizes.append(len(data) // 2)
                held.append(data)
                size += len(data) // 2
                if size >= BLOCK:
                    yield emit()
                    block, start = block + 1, start + size
                    doc_ids, sizes, held, size = [], [], [], 0
        if doc_ids:
            yield emit()

    ranged = encoded.select("doc_id", "ids").repartitionByRange(parts, "doc_id", F.xxhash64("ids")).sortWithinPartitions("doc_id", "ids")
    ranged.mapInArrow(scan, BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")
    totals = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for row in totals:                                                                    # one row a part
        rows.append((row["part"], before))
        before += row["n"]
    spark.createDataFrame(rows, "part int, before long").coalesce(1).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a token folder; start is the number of ids of all documents before."""
    codes = spark.read.parquet(f"{folder}/codebook").collect()                            # at most 2^16 rows
    shared = spark.sparkContext.broadcast(Codebook(np.array([r["id"] for r in codes], dtype=np.int64), np.array([r["length"] for r in codes], dtype=np.int64)))

    def scan(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                ends = np.cumsum(sizes)
                data = shared.value.unpack(row["bits"], row["checkpoints"], int(ends[-1])).astype("<u2")
                starts = ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"] + row["before"], pa.int64()), pa.array(sizes, pa.int64()),
                                                  pa.array([data[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks").join(spark.read.parquet(f"{folder}/parts"), "part")
    return blocks.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids binary")


def written_and_read(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from a token folder written and read back.

    Null and empty texts hold the end id alone. Rows without id come first; rows that repeat an id are each stored, ordered by
    their ids. An empty table writes empty files and gives no rows. Extra columns are ignored.
    """
    spark, folder = docs.sparkSession, scratch_folder(docs.sparkSession)
    write_tokens(stored(encode(docs, path)), folder)

    def scan(batches):
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x, dtype="<u2").astype("<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, folder).mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")
