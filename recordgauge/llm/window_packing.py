"""Packing documents into training sequences with a bounded number of open windows.

Every partition keeps ``open_windows`` windows. A document's tokens go to the window they leave
least room in; what exceeds a whole sequence is cut off first. When a piece fits nowhere, the
fullest window is topped up with the piece's beginning and leaves, so it has no padding. The
windows that are still open at a partition's end are merged: their pieces are packed again, the
leftovers of ``MERGED`` partitions in one task, round after round until one task has the rest.
A task of a merging round holds about ``MERGED * open_windows`` windows, so nothing grows with
the table there but the number of rounds, which is logarithmic. The windows are dealt by a group
number, of which a round has as many as tasks: however many partitions the rows come in, the
leftovers of a round lie in that many at most, and those of the last in one.

Only the very last sequence of the table can be shorter than the length and is then padded.

Defined results: a null text is an empty one and consists of the end token alone; rows with
equal or null ids are packed as documents of their own; an empty table gives no sequences;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordgauge.llm.word_tokens import encoder
from recordgauge.plans.scratch import staged

LENGTH = 4096
OPEN_WINDOWS = 16
#: Leftovers of so many partitions are merged by one task.
MERGED = 32
END_TOKEN = 2
VOCABULARY = "word_bpe_49k.json"
_WIDTH = 4  # bytes per id

_FIELDS = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids", pa.binary()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("open", pa.bool_()),
    ("part", pa.int64()),
]
_ARROW = pa.schema(_FIELDS)
_SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long, open boolean, part long"
)

#: doc_id, start, ids and the document's number of tokens.
Piece = tuple[int | None, int, bytes, int]


class Window:
    def __init__(self) -> None:
        self.filled = 0
        self.pieces: list[Piece] = []

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.filled += len(piece[2]) // _WIDTH


class Packer:
    """Places pieces online; windows that leave are handed out by ``place``."""

    def __init__(self, length: int = LENGTH, open_windows: int = OPEN_WINDOWS):
        self.length = length
        self.windows = [Window() for _ in range(open_windows)]

    def place(self, piece: Piece) -> Iterator[Window]:
        while piece[2]:
            size = len(piece[2]) // _WIDTH
            if size >= self.length:
                whole, piece = _cut(piece, self.length)
                window = Window()
                window.add(whole)
                yield window
                continue
            room = [w for w in self.windows if self.length - w.filled >= size]
            if room:
                best = max(room, key=lambda w: w.filled)
                best.add(piece)
                if best.filled == self.length:
                    yield self._taken(best)
                return
            fullest = max(self.windows, key=lambda w: w.filled)
            first, piece = _cut(piece, self.length - fullest.filled)
            fullest.add(first)
            yield self._taken(fullest)

    def _taken(self, window: Window) -> Window:
        self.windows[self.windows.index(window)] = Window()
        return window

    def rest(self) -> Iterator[Window]:
        yield from (w for w in self.windows if w.filled)


def _cut(piece: Piece, tokens: int) -> tuple[Piece, Piece]:
    doc_id, start, ids, total = piece
    at = tokens * _WIDTH
    return (doc_id, start, ids[:at], total), (doc_id, start + tokens, ids[at:], total)


def _packed(pieces: Iterable[Piece], length: int, open_windows: int, round_: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a partition's windows; those of windows still open at its end are marked."""
    part = TaskContext.get().partitionId()
    packer, number = Packer(length, open_windows), 0
    rows: list[tuple] = []
    size = 0

    def take(window: Window, is_open: bool) -> None:
        nonlocal number, size
        # Round, partition and number make an id that a repeated task gives again.
        sequence, offset = (round_ << 58) | (part << 32) | number, 0
        number += 1
        for doc_id, start, ids, total in window.pieces:
            n = len(ids) // _WIDTH
            rows.append((doc_id, start, n, ids, total, sequence, offset, is_open, part))
            offset += n
        size += window.filled

    def batch() -> pa.RecordBatch:
        nonlocal size
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)]
        rows.clear()
        size = 0
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    for piece in pieces:
        for window in packer.place(piece):
            take(window, False)
        if size >= 256 * length:
            yield batch()
    if last:
        # What is left of the whole table: fewer than open_windows sequences, filled in turn.
        final = Packer(length, 1)
        for piece in [p for window in packer.rest() for p in window.pieces]:
            for window in final.place(piece):
                take(window, False)
        packer = final
    for window in packer.rest():
        take(window, not last)
    if rows:
        yield batch()


def _documents(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[Piece]:
    end = END_TOKEN.to_bytes(_WIDTH, "little")
    encode = encoder(vocabulary).encode
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            ids = encode(text.as_py()) + end
            yield doc_id.as_py(), 0, ids, len(ids) // _WIDTH


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))
        yield from zip(*columns, strict=True)


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    length: int = LENGTH,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian unsigned 32 bit), doc_tokens, sequence_id, offset.

    ``vocabulary`` is a ``tokenizers`` file that every executor can read.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(_documents(batches, path), length, open_windows, 0, False)

    def merge(round_: int, last: bool):
        return lambda batches: _packed(_pieces(batches), length, open_windows, round_, last)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed, _ = staged(slim.mapInArrow(first, _SCHEMA), "packed", "open")
    closed, left, round_ = packed.where("NOT open"), packed.where("open"), 0
    while True:
        round_ += 1
        parts = left.select(F.countDistinct("part")).first()[0]
        last = parts <= MERGED
        tasks = 1 if last else -(-parts // MERGED)
        group = F.pmod(F.hash("sequence_id"), F.lit(tasks))
        ordered = left.repartitionById(tasks, group).sortWithinPartitions("sequence_id", "offset")
        merged, _ = staged(ordered.mapInArrow(merge(round_, last), _SCHEMA), "merged", "open")
        closed = closed.unionByName(merged.where("NOT open"))
        if last:
            return closed.drop("open", "part")
        left = merged.where("open")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
