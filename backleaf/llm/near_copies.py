"""SimHash near-dedup at a text similarity: BK-trees name the candidates, an exact check links them.

This is operator 7 with parameters of its own, for stages that ask for a Jaccard similarity of word
shingles instead of a fingerprint distance. A text's set holds the XXH64 hashes of its shingles (`width`
words, A-Z lower-cased; all words where there are fewer); texts whose sets have a similarity of at least
`share` are linked, and linked texts form classes. Equal sets are one node.

At a similarity of 0.8 the 64-bit fingerprints of two sets differ in about 10 bits and up to 20, too many
to shard by blocks of the fingerprint. Sets are dealt to shards by what they share instead: each of `BANDS`
keys is made of `ROWS` minima of its own hashes of the shingles, so two sets with similarity j agree in a key
with probability j ** ROWS. A shard's fingerprints make a BK-tree, each set searches it along edges
within `radius`, and what it finds in another class of the shard is compared shingle by shingle. A shard gives
the links of a spanning forest, never all pairs of a group.

What is lost: of pairs at exactly 0.8, 3 in 100,000 share no key and about 1 in 20,000 lies beyond 22
bits, both falling steeply above 0.8; no pair below the similarity is linked.

Hot groups: shards with equal members are searched once; a shard above most_sets or most_shingles is dealt in
blocks by hash, each searched by itself; then, where a shard still has sets outside its largest class, these
(and only these) visit the blocks, in portions of the same bound. So a task holds two portions, whatever a shard has.

Defined results: texts without words (null and empty ones among them) have equal sets; null ids, repeated
rows and empty tables are as in simhash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backleaf.llm.common import parts, small_batches, stage
from backleaf.llm.graph import components
from backleaf.llm.simhash import BKTree, keep_classes, majority

#: Least similarity, as a fraction of whole numbers.
SHARE = (4, 5)
BANDS, ROWS = 20, 4
_FACTORS = np.random.default_rng(17).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 4096
#: Shingles that are compared with a set's at once, or one set.
_COMPARED = 1 << 18


def shingles(text: str | None, width: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((h(joined[a : b - 1], seed) for a, b in zip(ends, ends[min(width, len(words)) :])), np.uint64, n).view(np.int64))


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - 2**63


def band_keys(own: np.ndarray) -> np.ndarray:
    """A set's keys: minima under BANDS * ROWS multiplications of its hashes, mixed ROWS at a time."""
    low = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(own), _CHUNK):
        np.minimum(low, (own[i : i + _CHUNK].view(np.uint64)[:, None] * _FACTORS).min(0), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for part, factor in zip(low.reshape(BANDS, ROWS).T, _FACTORS):
        key = (key ^ part) * factor
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def numbered(values: np.ndarray) -> tuple[np.ndarray, int]:
    """For each value its rank among the distinct ones, and their number: np.unique's inverse in half the memory."""
    if not len(values):
        return np.zeros(0, np.int32), 0
    order = np.argsort(values)
    ranked = values[order]
    new = np.r_[False, ranked[1:] != ranked[:-1]]
    del ranked
    rank = np.cumsum(new, dtype=np.int32)
    out = np.empty(len(values), np.int32)
    out[order] = rank
    return out, int(rank[-1]) + 1


def linked(codes: np.ndarray, sets: list[np.ndarray], radius: int, share: tuple[int, int] = SHARE, at_once: int = 256) -> np.ndarray:
    """For the sets of a shard (codes: their fingerprints, ascending) the smallest position in the same linked group."""
    num, den = share
    n = np.array([len(x) for x in sets])
    starts = np.r_[0, np.cumsum(n)]
    token, distinct_shingles = numbered(np.concatenate(sets))
    root, mark = np.arange(len(sets)), np.zeros(distinct_shingles, bool)
    distinct, code_of = np.unique(codes, return_inverse=True)
    tree = BKTree(distinct)

    def shared(at: np.ndarray) -> np.ndarray:
        """How many marked shingles each of these sets has."""
        edges = np.cumsum(n[at]) - n[at]
        return np.add.reduceat(mark[token[np.repeat(starts[at] - edges, n[at]) + np.arange(n[at].sum())]], edges, dtype=np.int64)

    for first in range(0, len(distinct), at_once):
        q, v = tree.within(distinct[first : first + at_once], radius)
        order = np.argsort(q, kind="stable")
        q, v = q[order], v[order]
        for u in range(*np.searchsorted(code_of, [first, first + at_once])):
            near = np.zeros(len(distinct), bool)
            near[v[slice(*np.searchsorted(q, [code_of[u] - first, code_of[u] - first + 1]))]] = True
            at = np.flatnonzero(near[code_of[:u]] & (root[:u] != root[u]))
            at = at[den * np.minimum(n[at], n[u]) >= num * np.maximum(n[at], n[u])]
            if not len(at):
                continue
            own = token[starts[u] : starts[u + 1]]
            mark[own] = True
            both = np.concatenate([shared(part) for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(n[at]) // _COMPARED, prepend=0))) if len(part)])
            mark[own] = False
            hits = np.unique(root[at[both * (num + den) >= num * (n[at] + n[u])]])
            if len(hits):
                hits = np.r_[hits, root[u]]
                root[np.isin(root, hits)] = hits.min()
    return root


def bitmap(ids: DataFrame, most: int = 1 << 20) -> np.ndarray:
    """A word-wise bitmap with the bit (id modulo its length) set for each id; at most `most` words, so that some others pass too."""
    n = min(most, 1 << max(0, ids.count() // 8).bit_length())
    at = F.pmod("s", F.lit(64 * n).cast("long"))
    rows = ids.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(pmod(s, 64L) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(n, np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
    return out


def whole_sets(texts: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """(s, own) of the sets in needed (and a few others), made again from the column text."""
    bits = bitmap(needed)

    def made(batches):
        import pyarrow as pa

        for b in parts(batches):
            found = {}
            for x in b.column("text"):
                own = shingles(x.as_py(), width)
                s = set_id(own)
                if bits[s % (64 * len(bits)) // 64] >> np.uint64(s % 64) & np.uint64(1):
                    found[s] = own.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["s", "own"])

    return texts.mapInArrow(made, "s long, own binary").dropDuplicates(["s"])


def shard_links(dealt: DataFrame, sets: DataFrame, shard: list[str], radius: int, share: tuple[int, int]) -> DataFrame:
    """(u, v) links of a spanning forest of each shard; dealt has s, fp and the shard's columns."""

    def found(batches) -> Iterator:
        import pyarrow as pa

        at, fp, s, own = None, [], [], []

        def links():
            if len(s) < 2:
                return
            codes = np.array(fp, np.int64).view(np.uint64)
            order = np.argsort(codes, kind="stable")
            ids = np.array(s, np.int64)[order]
            root = linked(codes[order], [np.frombuffer(own[i], np.int64) for i in order], radius, share)
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["u", "v"])

        for b in parts(batches):
            for *key, code, i, x in zip(*(b.column(c).to_pylist() for c in (*shard, "fp", "s", "own"))):
                if key != at:
                    yield from links()
                    at, fp, s, own = key, [], [], []
                if not s or s[-1] != i:  # a visitor that lies in the block it visits
                    fp.append(code)
                    s.append(i)
                    own.append(x)
        yield from links()

    rows = dealt.select(*shard, "fp", "s").join(sets, "s").select(*shard, "fp", "s", "own")
    return rows.repartition(*shard).sortWithinPartitions(*shard, "s").mapInArrow(found, "u long, v long")


def near_links(texts: DataFrame, codes: DataFrame, width: int, radius: int, share: tuple[int, int], most_sets: int = 4096, most_shingles: int = 4_000_000) -> DataFrame:
    """(node, root) for every set that has a similar one; texts has the column text, codes s, fp, n and keys of each set."""
    num, den = share
    posts = codes.select("s", "fp", "n", F.explode("keys").alias("key"))
    shards = posts.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("s")).alias("members"), F.sum("n").alias("total"), F.min("n").alias("low"), F.max("n").alias("high"), F.bit_xor("fp").alias("apart"))
    # Two sets alone must meet the sizes and the radius; shards with the same members are searched once.
    shards = shards.where(f"m > 2 or m = 2 and {den} * low >= {num} * high and bit_count(apart) <= {radius}")
    parts = F.greatest(F.ceil(F.col("m") / most_sets), F.ceil(F.col("total") / most_shingles)).cast("int")
    shards = stage(shards.groupBy("m", "members", "total").agg(F.min("key").alias("key")).select("key", parts.alias("parts")), "shards")
    dealt = stage(posts.join(shards, "key").select("key", "s", "fp", "parts", F.pmod(F.xxhash64(F.lit(3), "s"), "parts").cast("int").alias("block")), "dealt")
    sets = stage(whole_sets(texts, dealt.select("s").distinct(), width), "sets")
    links = stage(shard_links(dealt, sets, ["key", "block"], radius, share), "links")
    label = components(links)
    if shards.where("parts > 1").isEmpty():
        return label
    label = stage(label, "roots")
    large = dealt.where("parts > 1").join(label.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    of_root = large.groupBy("key", "root").agg(F.count("*").alias("k"))
    main = of_root.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), (F.sum("k") - F.max("k")).alias("others"))
    large = stage(large.join(main.where("others > 0"), "key").withColumn("portions", F.ceil(F.col("others") / most_sets).cast("int")), "large")
    held = large.select("key", "s", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"))
    visits = large.where("root <> main").select("key", "s", "fp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(5), "s"), "portions").cast("int").alias("portion"))
    more = shard_links(held.unionByName(visits), sets, ["key", "block", "portion"], radius, share)
    return components(links.unionByName(more))


def copy_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 22, share: tuple[int, int] = SHARE, **bounds: int) -> DataFrame:
    """(doc_id, text_hash, component_id, keeper_hash) for every row of df, as simhash.duplicate_classes.

    bounds: most_sets and most_shingles of near_links. All Python work is done, and written, when this returns.
    """
    with small_batches(df.sparkSession):
        return _copy_classes(df, id_col, text_col, width, radius, share, **bounds)


def _copy_classes(df: DataFrame, id_col: str, text_col: str, width: int, radius: int, share: tuple[int, int], **bounds: int) -> DataFrame:

    def made(batches):
        import pyarrow as pa

        for b in parts(batches):
            s, fp, n, keys = [], [], [], []
            for x in b.column("text"):  # one text at a time, so that no batch's sets are held together
                own = shingles(x.as_py(), width)
                code = majority(own.view(np.uint64))
                s.append(set_id(own))
                fp.append(code - 2**64 * (code >> 63))
                n.append(len(own))
                keys.append(band_keys(own) if len(own) else None)
            arrays = [pa.array(c, pa.int64()) for c in (s, fp, n)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *arrays, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "s", "fp", "n", "keys"])

    read = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    rows = stage(read.mapInArrow(made, "doc_id long, text_hash long, s long, fp long, n long, keys array<long>"), "sets")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    codes = stage(rows.groupBy("s").agg(F.min(first).alias("first"), *[F.first(c).alias(c) for c in ("fp", "n", "keys")]), "codes")
    roots = near_links(df.select(F.col(text_col).alias("text")), codes, width, radius, share, **bounds)
    classed = codes.select("s", "first").join(roots.withColumnRenamed("node", "s"), "s", "left").select("s", "first", F.coalesce("root", "s").alias("root"))
    classed = stage(classed, "classed")
    table = classed.join(classed.groupBy("root").agg(F.min("first").alias("least")), "root").select("s", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("keeper_hash"))
    return rows.select("doc_id", "text_hash", "s").join(table, "s").select("doc_id", "text_hash", "component_id", "keeper_hash")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one row of each class: that with the smallest id (of rows alike in id and text, the first by a hash of all columns)."""
    return keep_classes(df, copy_classes(df, id_col, text_col, **options), id_col, text_col)
