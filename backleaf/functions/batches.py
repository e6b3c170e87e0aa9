"""Bounds of what Python holds at once: Arrow batches by bytes, and rows that a stage must see together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH_KEY, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def bound_batches(spark: SparkSession, most: int = _BATCH_BYTES) -> None:
    """As small_batches(), from now on, for results that run later; a bound that the session has been given stays."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(most))


@contextmanager
def small_batches(spark: SparkSession, most: int = _BATCH_BYTES) -> Iterator[None]:
    """What runs within gets Arrow batches of about `most` bytes (a longer row: by itself) instead of 10,000 rows, in the JVM and in Python.

    It holds for tables that are written within, as by stage(), not for a result that is run later.
    """
    before = spark.conf.get(_BATCH_KEY, None)
    spark.conf.set(_BATCH_KEY, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_KEY)
        else:
            spark.conf.set(_BATCH_KEY, before)


def parts(batches: Iterable, rows: int = 256) -> Iterator:
    """Arrow batches cut to at most `rows` rows, so that what is made of a batch's rows is small whatever its size."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def together(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """rows with all that share `by` in one partition, sorted by it and `order`, for Python that reads partitions.

    Dealt by a hash of `by`, not by the column: where rows come from a join on the column, Spark drops a repartition by
    it as done already, and when it makes the join a broadcast one at run time, reads the join's shuffle
    where its parts lie, so that a key's rows come in several tasks.
    """
    return rows.repartition(F.xxhash64(by)).sortWithinPartitions(by, *order)
