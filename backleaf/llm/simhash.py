"""Near duplicates by SimHash, found with BK-trees.

A fingerprint's 64 bits are majorities over the XXH64 hashes of a text's word shingles. Texts
whose fingerprints differ in at most `radius` bits are linked; linked texts form classes.

The search: distinct fingerprints are dealt to shards so that two that lie within the radius share
one shard at least: cut in radius + 1 blocks, they agree in one block, and a shard holds the
fingerprints with the same leading bits of one block. Each shard's fingerprints make a BK-tree,
where a child hangs on the integer Hamming distance to its parent, and each of them searches the
tree along edges within the radius of its own distance only. A shard whose count passes `most`
is dealt again by the blocks of the remaining bits, and so on, so a dense group does not land in one task.
A tree travels with its shard's queries through the shuffle, not as a broadcast: all trees together
hold every fingerprint of the corpus, which has no size bound.

From a shard come the links of a spanning forest, never all pairs of a group: a group of n near
copies gives n - 1 links for each of its shards. Exact copies share a fingerprint and are one node.

Defined results: a null or empty text has fingerprint zero, linked like any other; a null id stays a row, and the
smallest id of a class is the smallest that is not null (null if all are); repeated rows all come
back; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backleaf.llm.common import free_name, stage
from backleaf.llm.graph import components

BITS = 64
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a text, A-Z lower-cased; zero if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - width + 1)
    spans = zip(ends, ends[min(width, len(words)) :])
    return majority(np.fromiter((h(joined[a : b - 1], seed) for a, b in spans), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


class BKTree:
    """A BK-tree over distinct 64-bit codes; the nodes are positions in `codes`, the root is 0."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes.astype(np.uint64, copy=False)
        n = len(codes)
        at, parent = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)
        keys, children = [], []
        while len(at):  # one level of the tree each time: the first code of a group becomes the node
            key = parent * (BITS + 1) + np.bitwise_count(self.codes[at] ^ self.codes[parent])
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            keys.append(key[new])
            children.append(at[new])
            parent = at[new][np.cumsum(new) - 1][~new]
            at = at[~new]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.edge, self.child = key[order], (np.concatenate(children) if children else np.zeros(0, np.int64))[order]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query position, node) for all nodes at most radius bits from a query."""
        q, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found_q, found = [], []
        while len(q) and len(self.codes):
            d = np.bitwise_count(queries[q] ^ self.codes[node]).astype(np.int64)
            near = d <= radius
            found_q.append(q[near])
            found.append(node[near])
            first = np.searchsorted(self.edge, node * (BITS + 1) + np.maximum(d - radius, 1))
            n = np.searchsorted(self.edge, node * (BITS + 1) + np.minimum(d + radius, BITS), "right") - first
            q = np.repeat(q, n)
            node = self.child[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *found_q]), np.concatenate([none, *found])


def forest(codes: np.ndarray, radius: int, at_once: int = 256) -> np.ndarray:
    """For sorted distinct codes, the position of the smallest code in the same linked group."""
    tree, root = BKTree(codes), np.arange(len(codes))
    for i in range(0, len(codes), at_once):
        q, v = tree.within(tree.codes[i : i + at_once], radius)
        q = q + i
        while len(q):
            a, b = root[q], root[v]
            apart = a != b
            q, v, a, b = q[apart], v[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (jump := root[root]).tobytes() != root.tobytes():
                root = jump
    return root


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): the id, the text's XXH64 and the fingerprint as a signed long."""
    import pyarrow as pa

    def made(batches):
        for b in batches:
            fp = np.array([fingerprint(x, width) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    df = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return df.mapInArrow(made, "doc_id long, text_hash long, fp long")


def bits(code: Column, low: int, n: int) -> Column:
    """n bits of a signed long from bit low on, as a long."""
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def near_links(codes: DataFrame, radius: int = 3, tree_size: int = 2048, most: int = 32768, levels: int = 2) -> DataFrame:
    """(u, v) links that join what lies within radius bits, over the distinct longs in column fp.

    Each leads from a code to the smallest code of its group in a shard: one for each code and
    shard at most. A group is what steps within the radius connect.
    tree_size: codes a shard should hold; most: codes beyond which a shard is dealt again, `levels` times at
    most: after two, with a radius of 3, its codes agree in 37 bits.
    """
    blocks, n = radius + 1, codes.count()
    width = BITS // blocks
    lead = min(width, max(0, (n // tree_size).bit_length()))
    fp = F.col("fp")

    def rest(code: Column, low: int, n: int) -> Column:
        """code without n bits from bit low on."""
        above = F.shiftleft(F.shiftrightunsigned(code, low + n), low) if low + n < BITS else F.lit(0).cast("long")
        return above.bitwiseOR(bits(code, 0, low)) if low else above

    # key: the shard; whole: what all of its block, and those taken before, are; rest: the bits not taken yet.
    first = [F.struct(F.xxhash64(F.lit(t), bits(fp, t * width + width - lead, lead)).alias("key"), F.xxhash64(F.lit(t), bits(fp, t * width, width)).alias("whole"), rest(fp, t * width, width).alias("rest")) for t in range(blocks)]
    dealt, left = codes.select("fp", F.explode(F.array(*first)).alias("s")).select("fp", "s.*"), BITS - width
    for _ in range(levels):  # shards above most are dealt again by the blocks of their rest
        large = dealt.groupBy("key").count().where(F.col("count") > most).select("key")
        if left < blocks or large.isEmpty():
            break
        dealt = stage(dealt, "dealt")
        inner = left // blocks
        deeper = [F.xxhash64("whole", F.lit(k), bits(F.col("rest"), k * inner, inner)) for k in range(blocks)]
        again = F.array(*[F.struct(d.alias("key"), d.alias("whole"), rest(F.col("rest"), k * inner, inner).alias("rest")) for k, d in enumerate(deeper)])
        large = dealt.groupBy("key").count().where(F.col("count") > most).select("key")
        dealt = dealt.join(large, "key", "left_anti").unionByName(dealt.join(large, "key", "left_semi").select("fp", F.explode(again).alias("s")).select("fp", "s.*"))
        left -= inner

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(pdf["fp"].to_numpy(np.int64))
        root = forest(own.view(np.uint64), radius)
        moved = root != np.arange(len(own))
        return pd.DataFrame({"u": own[moved], "v": own[root[moved]]})

    return dealt.groupBy("key").applyInPandas(linked, "u long, v long")


def duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, keeper_hash) for every row of df.

    component_id: the smallest id reachable over links; keeper_hash: the text_hash of the row with that id.
    """
    rows = stage(fingerprints(df, id_col, text_col, width), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    codes = stage(rows.groupBy("fp").agg(F.min(first).alias("first")), "codes")
    roots = components(near_links(codes.select("fp"), radius))
    classed = codes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = classed.groupBy("root").agg(F.min("first").alias("least"))
    table = classed.join(least, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("keeper_hash"))
    return rows.join(table, "fp").select("doc_id", "text_hash", "fp", "component_id", "keeper_hash")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """df with one row of each class: that with the smallest id (of rows alike in id and text, the first by a hash of all columns)."""
    return keep_classes(df, duplicate_classes(df, id_col, text_col, width, radius), id_col, text_col)


def keep_classes(df: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df that classes (component_id, keeper_hash) names as the first of theirs; of rows alike in both, the first by a hash of all columns."""
    made = ("keep_id", "keep_null", "keep_hash")
    keep_id, keep_null, keep_hash = names = [free_name(n, df.columns) for n in made]
    known = F.coalesce("component_id", F.lit(0).cast("long")).alias(keep_id), F.col("component_id").isNull().alias(keep_null)
    keepers = classes.select(*known, F.col("keeper_hash").alias(keep_hash)).distinct()
    own = df[id_col].cast("long")
    # Join and grouping share their keys, so the texts are shuffled once.
    rows = df.withColumns({keep_id: F.coalesce(own, F.lit(0).cast("long")), keep_null: own.isNull(), keep_hash: F.xxhash64(df[text_col])})
    first = F.min_by(F.struct(*[rows[c] for c in df.columns]), F.xxhash64(*[rows[c] for c in df.columns]))
    return rows.join(keepers, names, "left_semi").groupBy(*names).agg(first.alias("row")).select("row.*")
