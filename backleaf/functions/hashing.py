"""Hash expressions of logs and indexes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(data: Column) -> Column:
    """SHA-256 of a string's UTF-8 or of bytes, as bytes."""
    return F.unhex(F.sha2(data.cast("binary"), 256))


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def leaf_hash(leaf: Column) -> Column:
    """A log leaf's hash: SHA-256 of a zero byte and the leaf."""
    return sha256(F.concat(F.lit(b"\x00"), leaf.cast("binary")))


def node_hash(left: Column, right: Column) -> Column:
    """An inner node's hash: SHA-256 of a one byte and both children."""
    return sha256(F.concat(F.lit(b"\x01"), left, right))


def be64(n: Column) -> Column:
    """A long as eight bytes, the highest first."""
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def be64_all(positions: Column) -> Column:
    """An array of longs as the bytes of its members."""
    return F.unhex(F.array_join(F.transform(positions, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def value_digest(positions: Column) -> Column:
    """The digest of a list of positions that fits in one row: SHA-256 over their big-endian bytes."""
    return sha256(be64_all(positions))


def fold(hashes: Column) -> Column:
    """The Merkle root over an array of 1 to 256 hashes; a node without a right neighbour moves up as it is."""

    def level(acc: Column, _: Column) -> Column:
        def parent(i: Column) -> Column:
            left = F.get(acc, 2 * i)
            return F.when(2 * i + 1 < F.size(acc), node_hash(left, F.get(acc, 2 * i + 1))).otherwise(left)

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(acc) - 1) / 2).cast("int")), parent)

    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(8)), hashes, level), F.lit(0))
