"""Chat formatting with loss masks aligned by offsets.

Conversations are rendered whole with a template that marks turns; control strings inside texts and role names are escaped by one
backslash, reversibly. A rendering is encoded once, with the offsets of its tokens, and the sorted spans of the assistant turns
are intersected with the sorted token spans by binary search. Control strings are special tokens of the encoder, so no token
straddles the border of a turn.

A conversation is one row of output unless it holds over PIECE_CHARS characters: such ones, whose number is bounded by the size of
the data, are cut between turns into pieces that are formatted by different tasks.
"""
from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import BATCH_BYTES, MAX_BROADCAST_IDS, running_total

PIECE_CHARS, ENCODE_CHARS, PART_CHARS = 1 << 20, 1 << 16, 1 << 25
# The control strings of the template, and that of the vocabulary.
BEGIN, USER, USER_END, SYSTEM, SYSTEM_END, END, OTHER, OTHER_TEXT, OTHER_END = CONTROLS = ("<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]")
VOCABULARY_CONTROL = "<|endoftext|>"
AROUND = {"user": (USER, USER_END), "system": (SYSTEM, SYSTEM_END), "assistant": ("", END)}
_RESTS = "|".join(re.escape(c[1:]) for c in (*CONTROLS, VOCABULARY_CONTROL))
ESCAPE, UNESCAPE = re.compile(rf"([\[<])(?=\\*(?:{_RESTS}))"), re.compile(rf"([\[<])\\(?=\\*(?:{_RESTS}))")
SAFE_CUT = re.compile(r"(?<=[a-z])(?= [a-z])")          # the vocabulary's pattern always ends a word here
SCHEMA = "conv_id long, piece long, n_turns long, formatted string, ids binary, offsets binary, loss binary"


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]], begin: bool = True) -> tuple[str, np.ndarray]:
    """(formatted text, spans of the assistant texts in it as rows (start, end))"""
    parts, spans, at = [BEGIN if begin else ""], [], len(BEGIN) if begin else 0
    for role, text in turns:
        before, after = AROUND.get(role) or (OTHER + escape(role) + OTHER_TEXT, OTHER_END)
        body = escape(text)
        at += len(before)
        if role == "assistant":
            spans.append((at, at + len(body)))
        at += len(body) + len(after)
        parts += [before, body, after]
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted text. A turn that no opening string begins is the assistant's."""
    turns, at = [], len(BEGIN) if formatted.startswith(BEGIN) else 0
    while at < len(formatted):
        role, before, after = next(((r, b, a) for r, (b, a) in AROUND.items() if b and formatted.startswith(b, at)), ("assistant", "", END))
        if formatted.startswith(OTHER, at):
            middle = formatted.index(OTHER_TEXT, at)
            role, before, after = unescape(formatted[at + len(OTHER):middle]), formatted[at:middle + len(OTHER_TEXT)], OTHER_END
        at += len(before)
        end = formatted.index(after, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(after)
    return turns


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for the tokens whose span meets one of the spans; all are sorted, both borders are found by binary search."""
    first, last = np.searchsorted(ends, spans[:, 0], "right"), np.searchsorted(starts, spans[:, 1], "left")
    steps = np.zeros(len(starts) + 1, dtype=np.int64)
    real = spans[:, 1] > spans[:, 0]
    np.add.at(steps, first[real], 1)
    np.add.at(steps, last[real], -1)
    return (np.cumsum(steps[:-1]) > 0).astype(np.uint8)


class Encoder:
    """The library's encoder with the template's control strings as special tokens. Nothing is trained: they take free ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROLS])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets in code points). Long texts go to the library in parts cut between two plain words, where no token can
        reach across; a text that has no such place is encoded as one."""
        ids, offsets, at = [], [], 0
        while at < len(text) or not ids:
            cut = SAFE_CUT.search(text, at + ENCODE_CHARS) if len(text) - at > ENCODE_CHARS else None
            end = cut.start() if cut else len(text)
            found = self.tokenizer.encode(text[at:end], add_special_tokens=False)
            ids.append(np.array(found.ids, dtype=np.uint32))
            offsets.append(np.array(found.offsets, dtype=np.int64).reshape(-1, 2) + at)
            at = end
        return np.concatenate(ids), np.concatenate(offsets)


_ENCODERS: dict[str, Encoder] = {}


def in_order(conversations: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(turns of conversations of one piece, turns of larger ones or None), with ``piece`` and ``first``, whether the piece begins its
    conversation. Every partition is in order and no piece is in two of them."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("text"))
    order, size = ["conv_id", "turn", "role", "text"], (F.length("role") + F.length("text") + 32).cast("long")
    large = turns.groupBy("conv_id").agg(F.sum(size).alias("chars")).filter(F.col("chars") > PIECE_CHARS)
    total = large.agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).first()

    def dealt(df: DataFrame) -> DataFrame:
        return df.select(*order, "piece", "first").repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", *order[1:])

    if not total["n"]:
        return dealt(turns.withColumn("piece", F.lit(0).cast("long")).withColumn("first", F.lit(True))), None

    def keyed(df: DataFrame) -> DataFrame:                          # one row a large conversation
        return F.broadcast(df) if total["n"] <= MAX_BROADCAST_IDS else df

    hot, same = keyed(large.select(F.col("conv_id").alias("_id"))), F.col("conv_id").eqNullSafe(F.col("_id"))
    whole = turns.join(hot, same, "left_anti").withColumn("piece", F.lit(0).cast("long")).withColumn("first", F.lit(True))
    cut = running_total(turns.join(hot, same, "left_semi").withColumn("_size", size), order, "_size", "_before", total["chars"] // PART_CHARS + 1)
    cut = cut.withColumn("piece", F.floor(F.col("_before") / PIECE_CHARS))
    begins = keyed(cut.groupBy(F.col("conv_id").alias("_id")).agg(F.min("piece").alias("_begin")))
    return dealt(whole), dealt(cut.join(begins, same).withColumn("first", F.col("piece") == F.col("_begin")))


def packed(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def in_batches(rows: Iterator[tuple], size_of, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if size > BATCH_BYTES:
            yield packed(held, names, types)
            held, size = [], 0
    if held:
        yield packed(held, names, types)


def unpacked(batches, *names: str) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(c).to_pylist() for c in names))


def formatted_rows(turns: DataFrame, path: str) -> DataFrame:
    def scan(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)                 # one a worker; the path is read on the executors
        encoder = _ENCODERS[path]

        def rows():
            for (conv_id, piece), group in groupby(unpacked(batches, "conv_id", "piece", "first", "role", "text"), key=lambda r: r[:2]):
                group = list(group)                         # at most PIECE_CHARS and one turn
                text, spans = render([r[3:] for r in group], begin=group[0][2])
                ids, offsets = encoder.encode(text)
                yield (conv_id, piece, len(group), text, ids.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), loss_mask(offsets[:, 0], offsets[:, 1], spans).tobytes())

        yield from in_batches(rows(), lambda r: len(r[3]), ["conv_id", "piece", "n_turns", "formatted", "ids", "offsets", "loss"], [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * 3)

    return turns.mapInArrow(scan, SCHEMA)


def format_conversations(conversations: DataFrame, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(conversations in one row, pieces of larger ones or None): (conv_id, piece, n_turns, formatted, ids, offsets, loss).

    ``ids`` and ``offsets`` (start and end of each token in code points of ``formatted``) are little-endian 32-bit integers,
    ``loss`` is one byte a token. Turns are ordered by turn, ties by role and text; a missing turn comes first. A null text or
    role counts as empty, rows without conv_id form one conversation, repeated rows are repeated turns. An empty table gives no
    rows. Extra columns are ignored.
    """
    whole, cut = in_order(conversations)
    return formatted_rows(whole, path), formatted_rows(cut, path) if cut is not None else None


def masked_texts(formatted: str, offsets: np.ndarray, loss: np.ndarray) -> list[str]:
    """The unescaped text under each unbroken run of the mask."""
    edges = np.flatnonzero(np.diff(loss.astype(np.int8), prepend=0, append=0))
    return [unescape(formatted[offsets[a, 0]:offsets[b - 1, 1]]) for a, b in edges.reshape(-1, 2)]


def opened(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, n_turns, chars, turns, loss_text) read back from formatted rows: turns by the template, loss by the mask."""
    def scan(batches):
        def read():
            for conv_id, piece, text, offsets, loss in unpacked(batches, "conv_id", "piece", "formatted", "offsets", "loss"):
                turns = parse(text)
                under = masked_texts(text, np.frombuffer(offsets, dtype="<u4").reshape(-1, 2), np.frombuffer(loss, dtype=np.uint8))
                yield conv_id, piece, len(turns), len(text), "".join(f"{r}\n{t}\n" for r, t in turns), "".join(under)

        yield from in_batches(read(), lambda r: r[3], ["conv_id", "piece", "n_turns", "chars", "turns", "loss_text"], [pa.int64()] * 4 + [pa.string()] * 2)

    return rows.mapInArrow(scan, "conv_id long, piece long, n_turns long, chars long, turns string, loss_text string")


def digests(read: DataFrame) -> DataFrame:
    """One row a conversation whose pieces are neighbours in a partition, in order. Only two digest states are held."""
    def scan(batches):
        def rows():
            for conv_id, pieces in groupby(unpacked(batches, "conv_id", "n_turns", "chars", "turns", "loss_text"), key=lambda r: r[0]):
                n, chars, loss_chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for _, k, size, text, under in pieces:
                    n, chars, loss_chars = n + k, chars + size, loss_chars + len(under)
                    turns.update(text.encode())
                    loss.update(under.encode())
                yield conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from in_batches(rows(), lambda r: 200, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
                              [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])

    return read.mapInArrow(scan, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def report(whole: DataFrame, cut: DataFrame | None) -> DataFrame:
    """The digest columns of the registered query. Conversations of one row are digested in place; of a larger one the pieces are
    read back where they are, then their texts meet in order, as a digest of one conversation is sequential."""
    found = digests(opened(whole))
    return found if cut is None else found.unionByName(digests(opened(cut).repartition("conv_id").sortWithinPartitions("conv_id", "piece")))
