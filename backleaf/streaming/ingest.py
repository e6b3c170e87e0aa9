"""Keeping a stored index up to date with a log folder, by Structured Streaming."""

from __future__ import annotations

import time
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from backleaf.plans.store import IndexStore
from backleaf.sources import stream
from backleaf.sources.log import LogTable


def follow(store: IndexStore, folder: str, progress: str, every: str | None = None, tries: int = 3, wait_seconds: float = 10.0) -> StreamingQuery:
    """Starts a query that takes the log's checkpoints into the store.

    every: time between updates ("10 seconds"); without it the query takes what is there and ends.
    progress: the query's own folder. Where it lags behind the store, as after a crash between the
    two, batches that the store has are skipped; a gap is an error. tries: an update that fails is tried again
    after wait_seconds, with a warning, so many times in all before the query ends with its error.
    """
    spark = store.spark
    spark.dataSource.register(stream.LogSource)

    def take(batch: DataFrame, _: int) -> None:
        ends = batch.agg(F.min("idx").alias("a"), F.max("idx").alias("z")).first()
        if ends.z is None or ends.z < store.size():
            return
        if ends.a > store.size():
            raise ValueError(f"the stream is at {ends.a}, the index at {store.size()}")
        for left in reversed(range(tries)):
            try:
                store.update(LogTable(batch), stream.checkpoint_text(folder, ends.z + 1))
                return
            except Exception as why:
                if not left:
                    raise
                warnings.warn(f"update to {ends.z + 1} failed and is tried again: {why}", stacklevel=2)
                time.sleep(wait_seconds)

    writer = spark.readStream.format("backleaf_log").load(folder).writeStream.foreachBatch(take).option("checkpointLocation", progress)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
