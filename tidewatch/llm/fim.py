"""Fill-in-the-middle transformation of whole documents by piece tables.

A document is a list of descriptors (buffer, start, end) over immutable buffers: its own text and one that holds the sentinels.
Cutting splits descriptors, an arrangement permutes them and the inverse permutation restores their order; no text is moved until
an output is written, and digests are streamed from the descriptors. Cuts fall between word units, so never inside a character.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import byte_table, text_batches

SENTINELS = ("<P>", "<S>", "<M>")
# Order of the descriptors prefix, middle, suffix, <P>, <S>, <M> in each form.
ARRANGEMENTS = {"plain": (0, 1, 2, 3, 4, 5), "psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
SPACE = byte_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Pieces:
    """Descriptors over immutable buffers."""

    def __init__(self, buffers: tuple[bytes, ...], descriptors: list[tuple[int, int, int]]):
        self.buffers, self.descriptors = buffers, descriptors

    @classmethod
    def of(cls, text: bytes, marks: bytes = b"") -> "Pieces":
        return cls((text, marks), [(0, 0, len(text))])

    def cut(self, *offsets: int) -> "Pieces":
        """Split so that a descriptor begins at each offset, counted over the whole; an offset given twice makes an empty one."""
        out, at, left = [], 0, sorted(offsets)
        for buffer, start, end in self.descriptors:
            stop = at + end - start
            while left and left[0] <= stop:
                out.append((buffer, start, end - (stop - left[0])))
                start, left = out[-1][2], left[1:]
            out.append((buffer, start, end))
            at = stop
        return Pieces(self.buffers, out)

    def with_marks(self, lengths: list[int]) -> "Pieces":
        ends = np.cumsum(lengths).tolist()
        return Pieces(self.buffers, [*self.descriptors, *((1, b - n, b) for n, b in zip(lengths, ends))])

    def arranged(self, order: tuple[int, ...]) -> "Pieces":
        return Pieces(self.buffers, [self.descriptors[k] for k in order])

    def restored(self, order: tuple[int, ...]) -> "Pieces":
        return self.arranged(tuple(np.argsort(order).tolist()))

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, end in self.descriptors:
            yield memoryview(self.buffers[buffer])[start:end]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def joined(self) -> bytes:
        return b"".join(self.stream())


def unit_ends(text: bytes) -> np.ndarray:
    """Byte offset after each unit: a word with the white space before it, or white space at the end."""
    space = SPACE[np.frombuffer(text, dtype=np.uint8)]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(text)) if len(text) and space[-1] else ends


def n_chars(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80))


def checked(sentinels: tuple[str, str, str]) -> list[bytes]:
    """The sentinels in UTF-8. They must not be able to overlap, or an output could be cut in two ways."""
    marks = [s.encode() for s in sentinels]
    if len(set(marks)) != 3 or not all(marks) or any(a in b for a in marks for b in marks if a is not b):
        raise ValueError("three different sentinels are needed, none inside another")
    if any(a[k:] == b[:len(a) - k] for a in marks for b in marks for k in range(1, len(a))):
        raise ValueError("no sentinel may begin with the end of one")
    return marks


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 that the seed and the id decide; a missing id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in range(0, 16, 4)]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document; ``rate`` and ``spm_rate`` are percentages.

    Null texts count as empty. Empty texts, and texts that hold a sentinel, stay plain, so every output can be taken apart again.
    Rows that repeat an id and text come out alike; a row without id draws as if its id were empty. An empty table gives no rows.
    Extra columns are ignored. One pass, nothing is shuffled.
    """
    marks = checked(sentinels)
    buffer, lengths = b"".join(marks), [len(m) for m in marks]

    def moved(doc_id: int | None, text: bytes) -> tuple:
        ends = unit_ends(text)
        n = len(ends)
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not text or h3 % 100 >= rate or any(m in text for m in marks):
            return n, "plain", None, None, text
        form = "spm" if h4 % 100 < spm_rate else "psm"
        first, last = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        output = Pieces.of(text, buffer).cut(first, last).with_marks(lengths).arranged(ARRANGEMENTS[form])
        return n, form, n_chars(text[:first]), n_chars(text[first:last]), output.joined()

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 256):
                for first, run in text_batches(texts.slice(at, 256).to_pylist()):
                    first += at
                    rows = [moved(i, t) for i, t in zip(ids[first:first + len(run)], run)]
                    n, form, prefix, middle, output = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(run)), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()),
                                                      pa.array(output, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, SCHEMA)


def taken_apart(output: bytes, form: str, marks: list[bytes]) -> Pieces:
    """The text that an output was made from, as descriptors over the output: cut at the sentinels, then the inverse permutation."""
    whole = Pieces.of(output)
    if form == "plain":
        return whole
    order = ARRANGEMENTS[form]
    cuts = []
    for k in order:
        if k > 2:
            at = output.index(marks[k - 3], cuts[-1] if cuts else 0)
            cuts += [at, at + len(marks[k - 3])]
    return Pieces(whole.buffers, whole.cut(*cuts[1:]).restored(order).descriptors[:3])


def restore(transformed: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, text) rebuilt from output and form alone."""
    marks = checked(sentinels)

    def scan(batches):
        for batch in batches:
            for first, run in text_batches(batch.column("output").to_pylist()):
                same = batch.slice(first, len(run))
                texts = [taken_apart(o, f, marks).joined() for o, f in zip(run, same.column("form").to_pylist())]
                yield pa.RecordBatch.from_arrays([same.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return transformed.select("doc_id", "form", "output").mapInArrow(scan, "doc_id long, text string")


def report(transformed: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The digest columns of the registered query; digests of outputs and of restored texts are streamed from descriptors."""
    marks = checked(sentinels)
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]

    def scan(batches):
        for batch in batches:
            for first, run in text_batches(batch.column("output").to_pylist()):
                same = batch.slice(first, len(run))
                digests = [(Pieces.of(o).sha256(), taken_apart(o, f, marks).sha256()) for o, f in zip(run, same.column("form").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(same.column(c) for c in kept), pa.array([d[0] for d in digests]), pa.array([d[1] for d in digests])], [*kept, "output_sha256", "restored_sha256"])

    return transformed.mapInArrow(scan, SCHEMA.replace("output string", "output_sha256 string, restored_sha256 string"))
