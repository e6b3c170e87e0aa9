"""Logs as tables: a dense position from 0 on and the leaf's bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backleaf.functions import codec


@dataclass(frozen=True)
class LogTable:
    """rows has idx (long) and leaf (binary), and may have the columns that a mapping reads."""

    rows: DataFrame

    @classmethod
    def of(cls, df: DataFrame, idx: Column | str, leaf: Column | str) -> LogTable:
        """df's rows as leaves; its other columns stay for the mapping."""
        idx, leaf = (F.col(x) if isinstance(x, str) else x for x in (idx, leaf))
        return cls(df.select(idx.cast("long").alias("idx"), leaf.cast("binary").alias("leaf"), *[c for c in df.columns if c.lower() not in ("idx", "leaf")]))

    def range(self, start: int, end: int) -> LogTable:
        """Leaves at start to end - 1; the bounds reach the scan."""
        return LogTable(self.rows.where((F.col("idx") >= start) & (F.col("idx") < end)))


def density(df: DataFrame, idx_col: str) -> DataFrame:
    """One row: n, lowest, highest, n_distinct and is_dense (positions 0 to n - 1, each once)."""
    out = df.agg(F.count("*").alias("n"), F.min(idx_col).alias("lowest"), F.max(idx_col).alias("highest"), F.countDistinct(idx_col).alias("n_distinct"))
    dense = (F.col("lowest") == 0) & (F.col("highest") == F.col("n") - 1) & (F.col("n_distinct") == F.col("n"))
    return out.withColumn("is_dense", F.coalesce(dense, F.col("n") == 0))


def from_bundles(bundles: DataFrame, bundle_size: int = 256) -> LogTable:
    """Leaves from rows (bundle, entries array<binary>): the position is bundle * bundle_size + place."""
    rows = bundles.select("bundle", F.posexplode("entries").alias("place", "leaf"))
    return LogTable(rows.select((F.col("bundle") * bundle_size + F.col("place")).cast("long").alias("idx"), "leaf"))


#: The modules of the demonstration log.
MODULES = ("foo", "bar", "baz", "splat")


def demo_leaf(n: Column, seed: int = 1) -> Column:
    """The n-th JSON leaf of a demonstration log: module, version (a time as text, to the nanosecond) and hash (SHA-256 of both, base64).

    All of it follows from n and the seed: the module and the nanoseconds are read off SHA-256 of both.
    """
    drawn = F.sha2(F.concat_ws(":", F.lit(str(seed)), n.cast("string")), 256)

    def digits(at: int) -> Column:
        return F.conv(F.substring(drawn, at, 8), 16, 10).cast("long")

    module = F.element_at(F.array(*map(F.lit, MODULES)), (digits(1) % len(MODULES) + 1).cast("int"))
    nanos = F.rtrim(F.lpad((digits(9) % 10**9).cast("string"), 9, "0"), F.lit("0"))
    at = F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd'T'HH:mm:ss")
    version = F.concat(at, F.when(nanos != "", F.concat(F.lit("."), nanos)).otherwise(F.lit("")), F.lit("Z"))
    entry = F.struct(module.alias("module"), version.alias("version"), F.base64(F.unhex(F.sha2(F.concat(module, version), 256))).alias("hash"))
    return F.to_json(entry).cast("binary")


def demo(spark: SparkSession, n: int, seed: int = 1) -> LogTable:
    """The first n leaves; in the session's time zone, which should be UTC."""
    return LogTable(spark.range(n).select(F.col("id").alias("idx"), demo_leaf(F.col("id"), seed).alias("leaf")))


def demo_stream(spark: SparkSession, per_second: int = 1, seed: int = 1) -> DataFrame:
    """The same leaves as a stream (idx, leaf), so many a second."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rows.select(F.col("value").alias("idx"), demo_leaf(F.col("value"), seed).alias("leaf"))


def write_wal(rows: DataFrame, path: str) -> None:
    """Writes (idx, keys) as text files of a write-ahead log, each in order, files by ranges of positions."""
    rows.repartitionByRange("idx").sortWithinPartitions("idx").select(codec.wal_row(F.col("idx"), F.col("keys"))).write.text(path)


ENTRY = T.StructType([T.StructField("module", T.StringType()), T.StructField("version", T.StringType()), T.StructField("hash", T.BinaryType())])


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """(line, idx, keys, is_valid) for each line of write-ahead-log text files."""
    line = F.col("value")
    return spark.read.text(path).select(line.alias("line"), codec.wal_position(line).alias("idx"), codec.wal_keys(line).alias("keys"), codec.wal_valid(line).alias("is_valid"))


def recovered_wal(text: str, size: int) -> str:
    """A log file's text cut to what is whole and below `size`: after a crash, before the next append.

    What follows the last newline is dropped, then rows at or above size. A line in between that is
    no row is an error.
    """
    import re

    whole = text[: text.rfind("\n") + 1]
    kept = []
    for line in whole.splitlines():
        if not re.fullmatch(codec.WAL_ROW.strip("^$"), line):
            raise ValueError(f"no row of a write-ahead log: {line!r}")
        if int(line.split(" ", 1)[0]) < size:
            kept.append(line + "\n")
    return "".join(kept)
