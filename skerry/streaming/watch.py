"""Keeping an index fresh: events become batches of paths, batches become partial re-indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "path STRING, kind STRING, old_path STRING, ts TIMESTAMP"


def touched(events: DataFrame) -> DataFrame:
    """(path, ts): every path an event touches; a rename touches both, and an overflow all (the path ``*``)."""
    both = F.array_compact(F.array("path", F.when(F.col("kind") == "renamed", F.col("old_path"))))
    paths = F.when(F.col("kind").isin("overflow", "error"), F.array(F.lit("*"))).otherwise(both)
    return events.select(F.explode(paths).alias("path"), "ts")


def settled(events: DataFrame, quiet: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """(path, first, last, events) of bursts of events: a path's burst ends when it has been quiet for a while.

    Works on streams and tables alike; on a stream bursts come out once the watermark has passed them.
    """
    rows = touched(events)
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", quiet).alias("w"), "path").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events")).select("path", "first", "last", "events")


def batches(bursts: DataFrame) -> DataFrame:
    """Distinct paths; a ``*`` stands for a scan of everything and is kept as such."""
    return bursts.select("path").distinct()


def watch(spark: SparkSession, folder: str, checkpoint: str, refresh: Callable[[DataFrame, bool], None], quiet: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Follows JSON event files in a folder and calls ``refresh(paths, full)`` for each micro-batch.

    ``refresh`` must be idempotent, e.g. overwrite the rows of these paths: a batch that failed is given
    again with the same paths.
    """

    def one(batch: DataFrame, _: int) -> None:
        paths = batches(touched(batch)).persist()
        try:
            if not paths.isEmpty():
                refresh(paths.where("path <> '*'"), not paths.where("path = '*'").isEmpty())
        finally:
            paths.unpersist()

    events = spark.readStream.schema(EVENTS).json(folder)
    writer = events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=quiet)
    return writer.start()


def reindex(table: DataFrame, fresh: DataFrame, paths: DataFrame) -> DataFrame:
    """A table of the index with the rows of some paths replaced."""
    return table.join(paths, "path", "left_anti").unionByName(fresh)


def dirty_scope(refs: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids of files whose references may resolve otherwise: the changed ones, and those that use a name which a changed file defines."""
    names = symbols.join(changed.select("file_id"), "file_id", "left_semi").select(F.col("name_folded").alias("symbol_name_folded")).distinct()
    users = refs.where("symbol_name_folded is not null").select("file_id", "symbol_name_folded").distinct().join(names, "symbol_name_folded", "left_semi").select("file_id")
    return users.unionByName(changed.select("file_id")).distinct()
