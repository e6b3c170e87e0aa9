import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from backleaf.operators import index, merkle, trie


def mth(hashes):
    """RFC 6962's recursion."""
    if not hashes:
        return hashlib.sha256(b"").digest()
    if len(hashes) == 1:
        return hashes[0]
    k = 1
    while 2 * k < len(hashes):
        k *= 2
    return hashlib.sha256(b"\x01" + mth(hashes[:k]) + mth(hashes[k:])).digest()


def plain_trie(pairs):
    """The encoding's recursion over sorted pairs."""
    if not pairs:
        return bytes(32)
    if len(pairs) == 1:
        return hashlib.sha256(b"\x00" + pairs[0][0] + pairs[0][1]).digest()
    a, b = (int.from_bytes(pairs[i][0]) for i in (0, -1))
    bits = 256 - (a ^ b).bit_length()
    left = [p for p in pairs if not p[0][bits // 8] >> (7 - bits % 8) & 1]
    prefix = (a >> 256 - bits << 256 - bits).to_bytes(32)
    return hashlib.sha256(b"\x01" + bits.to_bytes(2) + prefix + plain_trie(left) + plain_trie(pairs[len(left) :])).digest()


LEAVES = [hashlib.sha256(bytes([0]) + str(i).encode()).digest() for i in range(70_000)]


def hashes_df(spark, n):
    return spark.range(n).select(F.col("id").alias("i"), F.unhex(F.sha2(F.concat(F.lit(b"\x00"), F.col("id").cast("string").cast("binary")), 256)).alias("h"))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 13, 100, 255, 256, 257, 700, 66_000])
def test_root(spark, n):
    assert bytes(merkle.root(hashes_df(spark, n), n).first().h) == mth(LEAVES[:n])


def test_frontier_grows_to_the_same_root(spark):
    f = merkle.Frontier()
    for end in (1, 100, 255, 256, 257, 700, 1024, 1025, 66_000, 70_000):
        f = merkle.extend(f, hashes_df(spark, 70_000).where(F.col("i") < end), end)
        assert f.root() == mth(LEAVES[:end]) and len(f.hashes) == end.bit_count()


@pytest.mark.parametrize("broken", ["id <> 5", "id <> 300", "id <> 699", "id < 699"])
def test_frontier_refuses_gaps(spark, broken):
    df = hashes_df(spark, 700).where(broken.replace("id", "i"))
    with pytest.raises(Exception, match="log|positions"):
        merkle.extend(merkle.Frontier(), df, 700)


@pytest.mark.parametrize("extra", [0, 300, 699])
def test_frontier_refuses_repeats(spark, extra):
    df = hashes_df(spark, 700)
    with pytest.raises(Exception, match="log|positions"):
        merkle.extend(merkle.Frontier(), df.unionByName(df.where(F.col("i") == extra)), 700)


def test_frontier_needs_its_hashes():
    with pytest.raises(ValueError):
        merkle.Frontier(3, [bytes(32)])


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 20])
def test_inclusion_paths(n):
    for i in range(n):
        path = merkle.inclusion_path(LEAVES[:n], i)
        assert merkle.root_from_path(LEAVES[i], i, n, path) == mth(LEAVES[:n])


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40 - 1), max_size=40))
def test_trie_fold(numbers):
    pairs = sorted((hashlib.sha256(str(n).encode()).digest() if n % 2 else n.to_bytes(32), bytes([n % 256]) * 32) for n in numbers)
    assert trie.fold((k, trie.leaf(k, d)) for k, d in pairs) == plain_trie(pairs)


def test_trie_root_does_not_depend_on_partitions(spark):
    rng = random.Random(4)
    pairs = sorted((rng.randbytes(2)[:1] + b"\x07" + rng.randbytes(30), rng.randbytes(32)) for _ in range(800))
    df = spark.createDataFrame(pairs, "key binary, digest binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert trie.root(trie.subtrees(df)) == plain_trie(pairs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_paths():
    rng = random.Random(5)
    pairs = sorted((rng.randbytes(32), rng.randbytes(32)) for _ in range(100))
    nodes = [(k, trie.leaf(k, d)) for k, d in pairs]
    for k, h in nodes:
        assert trie.root_from_path(k, h, trie.path(nodes, k)) == plain_trie(pairs)


def test_empty_trie(spark):
    assert trie.root(trie.subtrees(spark.createDataFrame([], "key binary, digest binary"))) == bytes(32)


def test_digests_stream_over_chunks(spark):
    posts = spark.range(200_000).select(F.sha2(F.when(F.col("id") % 3 == 0, "a").otherwise("b"), 256).cast("binary").alias("key"), F.col("id").alias("idx"))
    got = {bytes(r.key): (r.n, bytes(r.digest)) for r in index.digests(index.chunks(posts)).collect()}
    for name, want in (("a", [i for i in range(200_000) if i % 3 == 0]), ("b", [i for i in range(200_000) if i % 3])):
        key = hashlib.sha256(name.encode()).hexdigest().encode()
        assert got[key] == (len(want), hashlib.sha256(b"".join(i.to_bytes(8) for i in want)).digest())


def test_root_refuses_gaps_and_repeats(spark):
    leaves = merkle.leaf_hashes(spark.range(600).select(F.col("id").alias("idx")), F.col("idx").cast("string"))
    assert merkle.root(leaves, 600).count() == 1
    for broken in (leaves.where("i <> 300"), leaves.unionByName(leaves.where("i = 300")), leaves.where("i < 599")):
        with pytest.raises(Exception, match="gaps or repeated"):
            merkle.root(broken, 600).collect()
