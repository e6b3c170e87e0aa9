"""The inverted index: from each key to the ordered positions of its leaves.

Postings are rows (key, idx), one for each time a leaf maps to a key; repeats count. Lists are kept
in chunks of a fixed range of positions, so that no row and no task holds the whole list of a
frequent key: a chunk is gathered by (key, range), and only the digest, which is defined over the
list in order, reads one key's chunks one after the other, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backleaf.functions.batches import bound_batches, parts, together
from backleaf.functions.hashing import sha256

#: Positions that share a chunk.
CHUNK = 1 << 16


def postings(log: DataFrame, keys: Column, idx_col: str = "idx") -> DataFrame:
    """(key, idx) for each key of each leaf; leaves without keys give no row."""
    return log.select(F.explode(keys).alias("key"), F.col(idx_col).cast("long").alias("idx"))


def chunks(posts: DataFrame, size: int | None = None) -> DataFrame:
    """(key, chunk, idxs): sorted positions, below `size` if given, in ranges of CHUNK."""
    if size is not None:
        posts = posts.where(F.col("idx") < size)
    by = F.shiftright("idx", CHUNK.bit_length() - 1).alias("chunk")
    return posts.groupBy("key", by).agg(F.sort_array(F.collect_list("idx")).alias("idxs"))


def named_chunks(log: DataFrame, names: Column, idx_col: str = "idx", size: int | None = None) -> DataFrame:
    """chunks() of a mapping that gives names (array<string>), whose SHA-256 are the keys.

    Names are grouped as they are, and each is hashed once a chunk, not once an occurrence.
    """
    posts = log.select(F.explode(names).alias("key"), F.col(idx_col).cast("long").alias("idx")).where("key is not null")
    return chunks(posts, size).select(sha256(F.col("key")).alias("key"), "chunk", "idxs")


def digests(of: DataFrame) -> DataFrame:
    """(key, n, digest) from chunks: how many positions, and SHA-256 over all of them in order, each as eight bytes, the highest first."""
    rows = of.select("key", "chunk", "idxs")
    bound_batches(of.sparkSession)  # 10,000 lists at once may be gigabytes

    def streamed(batches) -> Iterator:
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))], names=["key", "n", "digest"])

        now, total, state, done = None, 0, None, []
        for b in parts(batches, 16):  # a list has CHUNK positions at most
            lists = b.column("idxs")
            data, ends = np.asarray(lists.flatten()).astype(">i8").tobytes(), np.cumsum(np.asarray(lists.value_lengths())).tolist()
            for key, a, z in zip(b.column("key").to_pylist(), [0, *ends], ends):
                if key != now:
                    if now is not None:
                        done.append((now, total, state.digest()))
                    now, total, state = key, 0, hashlib.sha256()
                total += z - a
                state.update(data[8 * a : 8 * z])
            if len(done) >= 10_000:
                yield batch(done)
                done = []
        if now is not None:
            done.append((now, total, state.digest()))
        if done:
            yield batch(done)

    return together(rows, "key", F.get("idxs", F.lit(0))).mapInArrow(streamed, "key binary, n long, digest binary")


def lists(of: DataFrame) -> DataFrame:
    """(key, idxs) with each list in one row: for lists known to fit one."""
    # A chunk may lie in several rows, each of a range of positions.
    whole = F.array_sort(F.flatten(F.collect_list("idxs")))
    return of.groupBy("key").agg(whole.alias("idxs"))


def lookup_many(of: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """(key, idxs, size) for each row of keys: positions below size in order; null for a key that the index lacks.

    A key whose positions are all at or above size has an empty list. Chunks beyond size are not read.
    """
    cut = of.select("key", "chunk", F.filter("idxs", lambda x: x < size).alias("idxs"))
    asked = keys.select("key").distinct()
    # The chunks of asked keys only; which side is small is for Spark to see at run time.
    found = lists(cut.join(asked, "key", "left_semi"))
    return keys.select("key").join(found, "key", "left").select("key", "idxs", F.lit(size).cast("long").alias("size"))


def lookup(of: DataFrame, key: bytes, size: int) -> tuple[list[int] | None, int]:
    """One key's positions below size, and size."""
    row = lists(of.where(F.col("key") == F.lit(key)).select("key", "chunk", F.filter("idxs", lambda x: x < size).alias("idxs"))).first()
    return (row.idxs if row else None), size


def dereference(of: DataFrame, log: DataFrame, idx_col: str = "idx") -> DataFrame:
    """The leaves behind each key's positions: key and the log's columns."""
    at = of.select("key", F.explode("idxs").alias("at"))
    return log.join(at, F.col(idx_col) == F.col("at")).drop("at")


def unmapped(log: DataFrame, posts: DataFrame, idx_col: str = "idx") -> DataFrame:
    """Leaves that no key leads to."""
    return log.join(posts.select(F.col("idx").alias("at")), F.col(idx_col) == F.col("at"), "left_anti")


def changed_keys(posts: DataFrame, old_size: int, new_size: int) -> DataFrame:
    """Keys with a position in [old_size, new_size)."""
    return posts.where((F.col("idx") >= old_size) & (F.col("idx") < new_size)).select("key").distinct()


def updated_digests(old: DataFrame, posts: DataFrame, changed: DataFrame, size: int) -> DataFrame:
    """The digests at `size` from those before: only changed keys are digested, from their whole lists."""
    again = digests(chunks(posts.join(changed, "key", "left_semi"), size))
    return old.join(changed, "key", "left_anti").unionByName(again)
