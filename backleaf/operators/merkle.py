"""Merkle trees over logs (RFC 6962), level by level in tiles of 256."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backleaf.functions.hashing import fold, leaf_hash

TILE = 256
EMPTY_ROOT = hashlib.sha256(b"").digest()


def leaf_hashes(log: DataFrame, leaf: Column, idx_col: str = "idx") -> DataFrame:
    """(i, h) for each leaf."""
    return log.select(F.col(idx_col).cast("long").alias("i"), leaf_hash(leaf).alias("h"))


def tiles(level: DataFrame, n: int | None = None) -> DataFrame:
    """(i, h) of the tiles' roots, from (i, h) of the nodes in them, of which there are n (full tiles only, if not given).

    A tile with a node that is missing, there twice or at or beyond n raises when it is read.
    """
    nodes = F.array_sort(F.collect_list(F.struct("i", "h")))
    of = level.groupBy(F.shiftright("i", TILE.bit_length() - 1).alias("i")).agg(nodes.alias("a"))
    first = F.col("i") * TILE
    size = F.lit(TILE).cast("long") if n is None else F.least(F.lit(TILE).cast("long"), F.lit(n).cast("long") - first)
    at = F.transform("a", lambda x: x["i"])
    dense = (F.size("a") == size) & (F.array_min(at) == first) & (F.array_max(at) == first + size - 1) & (F.size(F.array_distinct(at)) == size)
    return of.select("i", F.when(dense, fold(F.transform("a", lambda x: x["h"]))).otherwise(F.raise_error(F.lit("the log has gaps or repeated positions"))).alias("h"))


def root(leaves: DataFrame, size: int) -> DataFrame:
    """One row with the root h over `size` leaves (i, h), which hold each position from 0 to size - 1 once."""
    level, n = leaves.where(F.col("i") < size), size
    while True:
        level, n = tiles(level, n), -(-n // TILE)
        if n <= 1:
            return level.select("h")


def hash_leaf(data: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + data).digest()


def hash_children(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


class Frontier:
    """The roots of the full subtrees that a log of `size` leaves falls into, the largest first: at most 63."""

    def __init__(self, size: int = 0, hashes: list[bytes] | None = None):
        self.size, self.hashes = size, list(hashes or [])
        if len(self.hashes) != size.bit_count() or any(len(h) != 32 for h in self.hashes):
            raise ValueError(f"{len(self.hashes)} hashes are no frontier of {size} leaves")

    def append(self, h: bytes, height: int = 0) -> None:
        """Adds a full subtree of 2 ** height leaves, which must start at a multiple of its size."""
        if self.size % (1 << height):
            raise ValueError(f"a subtree of height {height} cannot start at {self.size}")
        self.size += 1 << height
        while not self.size >> height & 1:
            h, height = hash_children(self.hashes.pop(), h), height + 1
        self.hashes.append(h)

    def root(self) -> bytes:
        if not self.hashes:
            return EMPTY_ROOT
        out = self.hashes[-1]
        for h in reversed(self.hashes[:-1]):
            out = hash_children(h, out)
        return out


def extend(frontier: Frontier, leaves: DataFrame, end: int) -> Frontier:
    """The frontier at `end`, from leaf hashes (i, h) that hold each position from frontier.size to end - 1 once.

    Full tiles are folded where they lie, level by level; the driver gets the nodes outside full tiles only, at most
    510 a level. The first level of tiles, 1/256 of the hashes, is kept (in memory or on disk) while
    the levels above read it, so leaves are read twice: their edges, and all. A position that is missing, there twice
    or out of range raises.
    """
    level, lo, hi, height, edges, kept = leaves.where(F.col("i") >= frontier.size), frontier.size, end, 0, [], []
    while hi > lo:
        first, last = -(-lo // TILE), hi // TILE
        inner = (F.col("i") >= first * TILE) & (F.col("i") < last * TILE)
        got = (level.where(~inner) if last > first else level).limit(2 * TILE + 1).collect()
        edges += [(r.i << height, height, bytes(r.h)) for r in got]
        if last <= first:
            break
        level = tiles(level.where(inner))
        if not kept:
            kept.append(level.persist())
        lo, hi, height = first, last, height + 8
    for x in kept:
        x.unpersist()
    out = Frontier(frontier.size, frontier.hashes)
    for start, height, h in sorted(edges, key=lambda x: x[:2]):
        if start != out.size:
            raise ValueError(f"the log has no leaf, or two, at {min(start, out.size)}")
        out.append(h, height)
    if out.size != end:
        raise ValueError(f"the log ends at {out.size}, its checkpoint says {end}")
    return out


def inclusion_path(hashes: list[bytes], i: int) -> list[bytes]:
    """The audit path of leaf i among leaf hashes."""
    if len(hashes) <= 1:
        return []
    k = 1 << (len(hashes) - 1).bit_length() - 1
    if i < k:
        return [*inclusion_path(hashes[:k], i), tree_root(hashes[k:])]
    return [*inclusion_path(hashes[k:], i - k), tree_root(hashes[:k])]


def tree_root(hashes: list[bytes]) -> bytes:
    f = Frontier()
    for h in hashes:
        f.append(h)
    return f.root()


def root_from_path(h: bytes, i: int, size: int, path: list[bytes]) -> bytes:
    """The root that an audit path leads to from leaf hash h at i."""
    rest, last = list(path), size - 1
    while last:
        if i & 1 or i == last:
            if i & 1:
                h = hash_children(rest.pop(0), h)
            else:
                i, last = i >> 1, last >> 1
                continue
        else:
            h = hash_children(h, rest.pop(0))
        i, last = i >> 1, last >> 1
    if rest:
        raise ValueError("the path is too long")
    return h
