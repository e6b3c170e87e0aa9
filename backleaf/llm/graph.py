"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backleaf.llm.common import release, stage


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node it can reach.

    links: columns u, v, any order, repeats and loops allowed, no nulls. Alternates large-star and
    small-star steps (Kiveris et al., 2014), each a minimum by node and a join, until the links
    stand still: stars around the smallest nodes, after a number of rounds that grows with the
    logarithm of the size. Each round is a written table; nothing is gathered at the driver but a
    count and a sum. Raises if most_rounds do not suffice.
    """
    def directed(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = stage(directed(links), "links")
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = directed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        then = stage(directed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.withColumnRenamed("m", "v"))), "links")
        release(now)
        now, before, seen = then, seen, mark(then)
        if seen == before:
            break
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
