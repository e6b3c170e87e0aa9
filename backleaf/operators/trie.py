"""The index's own root: a Merkle trie over (key, digest).

Encoding 1, binary, path-compressed, highest bit first: a leaf is SHA-256(0x00 key digest); an inner
node is SHA-256(0x01 u16be(bits of the common prefix) prefix padded to 32 bytes, left, right); the
empty trie is 32 zero bytes. The root depends on the set of pairs alone. Keys are read in order,
once, with a stack as deep as a path: subtrees by the first two bytes of the key where the rows
lie, then at most 65,536 subtree roots at the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backleaf.functions.batches import together

EMPTY = bytes(32)


def leaf(key: bytes, digest: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + key + digest).digest()


def common_bits(a: bytes, b: bytes) -> int:
    return 256 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_length()


def inner(bits: int, key: bytes, left: bytes, right: bytes) -> bytes:
    prefix = (int.from_bytes(key) >> 256 - bits << 256 - bits).to_bytes(32)
    return hashlib.sha256(b"\x01" + bits.to_bytes(2) + prefix + left + right).digest()


def fold(nodes: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The root over (key, hash) in order of keys; a subtree counts with any key of its own."""
    hashes: list[bytes] = []
    gaps: list[int] = []  # common bits between neighbours that are not joined yet
    last = b""

    def join() -> None:
        right = hashes.pop()
        hashes.append(inner(gaps.pop(), last, hashes.pop(), right))

    for key, h in nodes:
        if last:
            bits = common_bits(last, key)
            while gaps and gaps[-1] > bits:
                join()
            gaps.append(bits)
        hashes.append(h)
        last = key
    while gaps:
        join()
    return hashes[0] if hashes else EMPTY


def subtrees(digests: DataFrame) -> DataFrame:
    """(bucket, first_key, root) of the keys that share their first two bytes."""
    rows = digests.select(F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int").alias("bucket"), "key", "digest")

    def built(batches) -> Iterator:
        import pyarrow as pa

        def rows_of():
            for b in batches:
                yield from zip(b.column("bucket").to_pylist(), b.column("key").to_pylist(), b.column("digest").to_pylist())

        source, out = rows_of(), []
        row = next(source, None)
        while row is not None:
            bucket, first = row[0], row[1]

            def own():
                nonlocal row
                while row is not None and row[0] == bucket:
                    yield row[1], leaf(row[1], row[2])
                    row = next(source, None)

            out.append((bucket, first, fold(own())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "first_key", "root"])

    return together(rows, "bucket", "key").mapInArrow(built, "bucket int, first_key binary, root binary")


def root(of_subtrees: DataFrame) -> bytes:
    """The index's root from its subtrees, of which there are 65,536 at most."""
    rows = of_subtrees.orderBy("bucket").collect()
    return fold((bytes(r.first_key), bytes(r.root)) for r in rows)


def path(nodes: list[tuple[bytes, bytes]], key: bytes) -> list[tuple[int, bytes]]:
    """What proves a key among (key, hash) in order of keys: (bits, other side's hash) from the top down.

    Down the branch that the key's bits choose, as far as its bits agree with the nodes' prefix.
    """
    out: list[tuple[int, bytes]] = []
    while len(nodes) > 1:
        bits = common_bits(nodes[0][0], nodes[-1][0])
        at = next(i for i, (k, _) in enumerate(nodes) if k[bits // 8] >> 7 - bits % 8 & 1)
        if common_bits(nodes[0][0], key) < bits:
            break
        right = key[bits // 8] >> 7 - bits % 8 & 1
        out.append((bits, fold(nodes[:at] if right else nodes[at:])))
        nodes = nodes[at:] if right else nodes[:at]
    return out


def root_from_path(key: bytes, h: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a path leads to from the node h that lies under key's bits."""
    for bits, other in reversed(steps):
        right = key[bits // 8] >> 7 - bits % 8 & 1
        h = inner(bits, key, other, h) if right else inner(bits, key, h, other)
    return h
