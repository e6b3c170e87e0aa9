"""Packing token ids into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows; what remains of each document is
one item. Items are taken by decreasing length, and each goes to the open window that leaves the
least room, which a segment tree over remaining capacities finds in logarithmic time.

Work is by partition, without a shuffle: a partition's items are packed in groups of about
group_tokens, so a task holds that much and no more, whatever its partition holds. Windows that a
group leaves less than `full` (15/16) full go on as items of the next group. The last group's are joined
and cut into full windows; its last tokens make windows of powers of two (power_tail) or one
window. Sequence ids come from the partition's number and a counter, so a task that runs again
gives the same rows.

Defined results: a null text counts as empty and is the end id alone; repeated rows are packed
once each; a null doc_id stays null; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backleaf.llm import tokens

_ID = 4  # bytes of an id


class CapacityTree:
    """Open windows by remaining capacity; tightest(n) takes one with the least capacity of n or more."""

    def __init__(self, capacity: int):
        self.half = 1 << capacity.bit_length()
        self.filled = bytearray(2 * self.half)  # of each node: whether a leaf below has open windows
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.half
        while i and not self.filled[i]:
            self.filled[i] = 1
            i >>= 1

    def tightest(self, n: int) -> tuple[int, int] | None:
        """(room, window), taken out of the tree; None if no open window has room for n."""
        i = n + self.half
        while not self.filled[i]:
            while i & 1:  # a right child: nothing at or above n is left below its parent
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.half:
            i = 2 * i if self.filled[2 * i] else 2 * i + 1
        room = i - self.half
        window = self.open[room].pop()
        if not self.open[room]:
            self.filled[i] = 0
            while i > 1 and not (self.filled[i] or self.filled[i ^ 1]):
                i >>= 1
                self.filled[i] = 0
        return room, window


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of positions in lengths, by best-fit decreasing; every length is at most capacity."""
    tree, windows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if found := tree.tightest(lengths[i]):
            room, w = found
            windows[w].append(i)
        else:
            room, w = capacity, len(windows)
            windows.append([i])
        if room > lengths[i]:
            tree.put(room - lengths[i], w)
    return windows


@dataclass(slots=True)
class Piece:
    """A run of a document's ids: those from start on, `ids` as little-endian unsigned 32-bit."""

    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // _ID

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: at * _ID], self.doc_tokens), Piece(self.doc_id, self.start + at, self.ids[at * _ID :], self.doc_tokens)


class Packer:
    """Turns documents into windows, each a list of pieces that fit; see the module."""

    def __init__(self, window: int = 2048, group_tokens: int = 4_000_000, power_tail: bool = True, full: float = 15 / 16):
        self.window, self.group_tokens, self.power_tail, self.full = window, group_tokens, power_tail, full
        self.items: list[Piece] = []
        self.waiting = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        rest = Piece(doc_id, 0, ids, len(ids) // _ID)
        while len(rest) >= self.window:
            full, rest = rest.cut(self.window)
            yield [full]
        if len(rest):
            self.items.append(rest)
            self.waiting += len(rest)
        if self.waiting >= self.group_tokens:
            yield from self._group(last=False)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._group(last=True)

    def _group(self, last: bool) -> Iterator[list[Piece]]:
        items, self.items, self.waiting = self.items, [], 0
        for places in best_fit([len(x) for x in items], self.window):
            window = [items[i] for i in places]
            if (n := sum(map(len, window))) >= self.window * self.full:
                yield window
            else:
                self.items += window
                self.waiting += n
        if last:
            yield from self._joined()

    def _joined(self) -> Iterator[list[Piece]]:
        left, self.waiting = self.waiting, 0
        pieces = self.items[::-1]
        self.items = []
        while left:
            n = min(left, self.window)
            if self.power_tail and n < self.window:
                n = 1 << (n.bit_length() - 1)
            window, left = [], left - n
            while n:
                piece = pieces.pop()
                if len(piece) > n:
                    piece, rest = piece.cut(n)
                    pieces.append(rest)
                window.append(piece)
                n -= len(piece)
            yield window


def windows_of(batches, packer: Packer, tokenizer_path: str, end_id: int) -> Iterator[tuple[int, list[Piece]]]:
    """(sequence id, window) over a partition's Arrow batches of doc_id and text."""
    from pyspark import TaskContext

    tokenizer, end = tokens.word_tokenizer(tokenizer_path), end_id.to_bytes(_ID, "little")
    sequence = TaskContext.get().partitionId() << 32

    def made():
        for batch in batches:
            texts = map(lambda x: x.as_py(), batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.ids(texts)):
                yield from packer.add(doc_id, ids + end)
        yield from packer.finish()

    for window in made():
        yield sequence, window
        sequence += 1


def documents_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


PIECE_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    window: int = 2048,
    end_id: int = 1,
    group_tokens: int = 4_000_000,
    with_ids: bool = False,
    full: float = 15 / 16,
) -> DataFrame:
    """One row for each piece: PIECE_SCHEMA, and with_ids its ids (binary, little-endian unsigned 32-bit).

    full: windows of a group that are less full, as a share of window, are packed once more with the next group.
    """
    import pyarrow as pa

    path = tokenizer_path or tokens.public_path()
    schema = T.StructType([*PIECE_SCHEMA.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    kinds = [pa.int64()] * len(PIECE_SCHEMA) + [pa.binary()] * with_ids

    def packed(batches):
        rows: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

        for sequence, pieces in windows_of(batches, Packer(window, group_tokens, full=full), path, end_id):
            offset = 0
            for p in pieces:
                row = (p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, sequence, offset)
                rows.append((*row, p.ids) if with_ids else row)
                offset += len(p)
            if len(rows) >= 5000:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return documents_of(df, id_col, text_col).mapInArrow(packed, schema)
