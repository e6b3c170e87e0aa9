"""Approximate nearest neighbours by multi-index hashing.

Vectors get 64-bit codes: signs after a rotation learned on a bounded sample (principal axes, then
the rotation that brings the sample nearest to its signs). A code is cut into TABLES substrings, each the
key of an index of its own. Of two codes within radius r = TABLES * a + b, either one of the first b + 1 substrings
differs in at most a bits or one of the others in at most a - 1, so probing the tables for all values that near
retrieves every code within the radius; those are kept by their full distance and ranked by inner products of the
vectors themselves.

The radius is each query's own. On the sample is learned how many bits hold the wanted share of pairs with a
given inner product; a query's k-th best product is estimated, on the low side, from the sample, and its radius is
what holds the share of pairs that good. As rows grow, the k-th best gets better and the radius smaller, down to
what the sample can tell. Queries that find fewer than they could are searched again with all 64 bits.

The index is sharded: each shard holds its part of all rows and its own tables, and every query
visits every shard, in blocks of shard_rows. A task reads a shard's rows, then its queries in batches, so it holds
one shard. Equal vectors are one entry with their smallest ids, which is all a query can need of them.

Nearness is the largest inner product. Vectors of unequal length are brought on a sphere by one
more component for the codes (not for the scores).

Defined results: a vector that is null, zero, holds a null or a number that is not finite, or has
not `width` components, takes no part; a null id takes no part; rows alike in id and vector count
once; ties go to the smaller id; queries with fewer candidates than k get all; products that overflow give infinite
scores, and those that are no number come last; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backleaf.llm.common import stage

BITS, TABLES = 64, 4
_PART = np.uint16
_WEIGHTS = (1 << np.arange(BITS, dtype=np.uint64)).astype(np.uint64)


class Codes:
    """Learned codes: of rows and of queries, whose additional component is zero."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 5, steps: int = 30):
        self.longest = longest
        x = self.lifted(sample)
        self.mean = x.mean(0)
        spread = x - self.mean
        _, axes = np.linalg.eigh(spread.T @ spread / len(x))
        random, parts, bits = np.random.default_rng(seed), [], BITS
        while bits:
            b = min(bits, x.shape[1])
            basis = axes[:, ::-1][:, :b]
            z = (x - self.mean) @ basis
            turn = np.linalg.qr(random.normal(size=(b, b)))[0]
            for _ in range(steps):
                u, _, v = np.linalg.svd(np.sign(z @ turn).T @ z)
                turn = (u @ v).T
            parts.append(basis @ turn)
            bits -= b
        self.axes = np.concatenate(parts, 1)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        y = x / self.longest
        return np.c_[y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))]

    def _signs(self, lifted: np.ndarray) -> np.ndarray:
        return (((lifted - self.mean) @ self.axes) > 0) @ _WEIGHTS

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._signs(self.lifted(x)).astype(np.uint64)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self._signs(np.c_[q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))]).astype(np.uint64)


class Reach:
    """The radius that holds `share` of pairs with a given product (relative to both lengths' bounds), learned on a sample: bits fall in line with it."""

    def __init__(self, codes: Codes, sample: np.ndarray, rows: int, k: int, share: float):
        self.codes, self.sample = codes, sample
        self.rank = min(len(sample), -(-k * len(sample) // max(rows, 1)) + 1)
        products = self._products(sample[:500])
        best = np.argsort(-products, 1)[:, 1 : 3 * k + 1]
        at = np.take_along_axis(products, best, 1).ravel()
        bits = np.bitwise_count(codes.of_queries(sample[:500])[:, None] ^ codes.of_rows(sample)[best]).ravel().astype(float)
        self.slope, self.base = np.polyfit(at, bits, 1) if at.size and np.ptp(at) > 1e-9 else (0.0, bits.mean() if bits.size else BITS)
        self.base += float(np.quantile(bits - self.slope * at - self.base, share, method="higher")) if bits.size else 0.0

    def _products(self, q: np.ndarray) -> np.ndarray:
        return (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (self.sample / self.codes.longest).T

    def radius(self, q: np.ndarray) -> np.ndarray:
        """Of each query, by its best products with the sample but the best, which may be its own."""
        products = self._products(q)
        if not len(self.sample) > self.rank:
            return np.full(len(q), BITS)
        kth = -np.partition(-products, self.rank, 1)[:, self.rank]
        return np.clip(np.ceil(self.base + self.slope * kth), 0, BITS).astype(int)


class Shard:
    """Some rows' codes in one table for each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes.view(_PART).reshape(-1, TABLES)
        self.order = np.argsort(parts, 0, kind="stable")
        self.tables = [np.unique(parts[self.order[:, t], t], return_index=True, return_counts=True) for t in range(TABLES)]

    def probe(self, table: int, value: int, bits: int) -> np.ndarray:
        """Rows whose substring is at most `bits` from value."""
        values, starts, counts = self.tables[table]
        near = np.bitwise_count(values ^ _PART(value)) <= bits
        n = counts[near]
        return self.order[np.repeat(starts[near] - np.cumsum(n) + n, n) + np.arange(n.sum()), table]

    def touched(self, code: np.uint64, radius: int) -> np.ndarray:
        """The rows that the tables give for a radius: all within it, and others."""
        seen, (a, b) = np.zeros(len(self.codes), bool), divmod(radius, TABLES)
        for t, value in enumerate(np.array([code]).view(_PART).tolist()):
            if (bits := a if t <= b else a - 1) >= 0:
                seen[self.probe(t, value, bits)] = True
        return np.flatnonzero(seen)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """All rows whose code is at most radius bits away."""
        rows = self.touched(code, radius)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def product(x: list[float]) -> float:
    """The correctly rounded sum; where parts overflow, what plain adding gives, the lowest for no number."""
    try:
        out = fsum(x)
    except (OverflowError, ValueError):
        out = sum(x)
    return out if out == out else float("-inf")


def exact_top(q: np.ndarray, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    """(score, row) of the k best of rows: largest inner product, then smallest id."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = vectors[rows] @ q
        if len(rows) > 2 * k and np.isfinite(rough).all():
            cut = np.partition(rough, len(rough) - 2 * k)[len(rough) - 2 * k]
            rows = rows[rough >= cut]
        scored = [(product(p), int(r)) for p, r in zip((vectors[rows] * q).tolist(), rows)]
    return sorted(scored, key=lambda x: (-x[0], ids[x[1]]))[:k]


def search(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_every: int = 20,
    k: int = 20,
    sample_rows: int = 5000,
    shard_rows: int = 32768,
    share: float = 0.95,
    width: int | None = None,
    seed: int = 5,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by query_every.

    share: of pairs as good as a query's k-th best, how many its radius is to hold. width: the vectors' number of
    components; by default the most common one. sample_rows bounds what is fitted at the driver and sent to executors.
    """
    v = F.col("v")
    is_float = isinstance(df.schema[vector_col].dataType, T.ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    rows = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<float>" if is_float else "array<double>").alias("v")).where("id is not null and size(v) > 0")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists(v, lambda x: x != 0))
    rows = rows.select("id", "v", F.xxhash64(F.lit(seed), v).alias("h"), F.xxhash64(F.lit(seed + 1), v).alias("g"))
    result = "query_id long, rank int, vec_id long, score double"
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("longest"))
    lengths = (lengths if width is None else lengths.where(F.col("n") == width)).orderBy(F.desc("rows"), "n").first()
    if lengths is None:
        return df.sparkSession.createDataFrame([], result)
    width = lengths.n
    rows = rows.where(F.size(v) == width)

    # Equal vectors: their k + 1 smallest ids (Spark cuts to that before the shuffle).
    of_equal = Window.partitionBy("h", "g").orderBy("id")
    ids = rows.select("h", "g", "id").distinct()
    least = ids.withColumn("n", F.row_number().over(of_equal)).where(F.col("n") <= k + 1).groupBy("h", "g").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = rows.groupBy("h", "g").agg(F.first("v").alias("v"), F.max(F.col("id") % query_every == 0).alias("asks"))
    entries = stage(vectors.join(least, ["h", "g"]), "vectors")

    n = entries.count()
    sample = np.array([r.v for r in entries.select("v", "h", "g").orderBy("h", "g").limit(sample_rows).collect()])
    codes = Codes(sample, float(np.sqrt(lengths.longest)) or 1.0, seed)
    reach, shards = Reach(codes, sample, n, k, share) if np.isfinite(codes.longest) else None, max(1, -(-n // shard_rows))
    element = entries.schema["v"].dataType

    def with_radius(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = np.asarray(b.column("v").flatten(), float).reshape(b.num_rows, width)
            r = np.full(len(x), BITS) if reach is None else reach.radius(x)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("g"), b.column("v"), pa.array(r, pa.int32())], names=["h", "g", "v", "radius"])

    keys = [T.StructField("h", T.LongType()), T.StructField("g", T.LongType())]
    queries = stage(entries.where("asks").select("h", "g", "v").mapInArrow(with_radius, T.StructType([*keys, T.StructField("v", element), T.StructField("radius", T.IntegerType())])), "queries")

    def hits_of(queries: DataFrame) -> DataFrame:
        """(h, g, score, ids): of each query and shard the best entries within the query's radius."""
        shard = F.pmod(F.col("g"), F.lit(shards)).cast("int")
        asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "radius", "h", "g", "v", F.array().cast("array<long>").alias("ids"))
        held = entries.select(shard.alias("shard"), F.lit(-1).alias("radius"), "h", "g", "v", "ids")
        # Each shard's rows come before its queries.
        dealt = held.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", F.col("radius") >= 0, "h", "g")
        return dealt.mapInArrow(found, schema)

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("h", "g")] + [T.StructField("score", T.DoubleType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def found(batches) -> Iterator:
        import pyarrow as pa

        def runs(batch):
            """The batch cut where shard or kind changes."""
            key = np.asarray(batch.column("shard")) * 2 + (np.asarray(batch.column("radius")) >= 0)
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield int(key[a]) // 2, bool(key[a] & 1), batch.slice(a, b - a)

        at, parts, index = None, [], None
        for batch in batches:
            for number, asks, part in runs(batch):
                if number != at:
                    at, parts, index = number, [], None
                x = np.asarray(part.column("v").flatten(), float).reshape(part.num_rows, width)
                if not asks:
                    parts.append((x, part.column("ids").to_pylist()))
                    continue
                if not parts:
                    continue
                if index is None:
                    own, own_ids = np.concatenate([p[0] for p in parts]), [i for p in parts for i in p[1]]
                    first, index = np.array([i[0] for i in own_ids]), Shard(codes.of_rows(own))
                out: list[tuple] = []
                for h, g, radius, q, code in zip(part.column("h").to_pylist(), part.column("g").to_pylist(), part.column("radius").to_pylist(), x, codes.of_queries(x)):
                    near = index.within(code, radius)
                    out += [(h, g, score, own_ids[r]) for score, r in exact_top(q, near, own, first, k + 1)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=schema.names)

    hits = stage(hits_of(queries), "hits")
    # Queries with fewer neighbours than there are: all rows are searched for them.
    most = min(k + 1, ids.count())
    enough = hits.groupBy("h", "g").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") >= most).select("h", "g")
    short = stage(queries.join(enough, ["h", "g"], "left_anti").withColumn("radius", F.lit(BITS)), "short")
    if not short.isEmpty():
        hits = hits.join(enough, ["h", "g"], "left_semi").unionByName(hits_of(short))
    best = Window.partitionBy("h", "g").orderBy(F.desc("score"), F.element_at("ids", 1))
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    pairs = hits.select("h", "g", "score", F.explode("ids").alias("id")).groupBy("h", "g").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id")).alias("found"))
    pairs = pairs.select("h", "g", F.slice(F.array_sort("found"), 1, k + 1).alias("found"))
    asking = ids.where(F.col("id") % query_every == 0).select("h", "g", F.col("id").alias("query_id"))
    answers = asking.join(pairs, ["h", "g"])
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    answers = answers.select("query_id", F.posexplode(own).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
