"""Streams of change notifications: duplicates, bursts, and commits of batches.

The windows and watermarks are ours; nothing prescribes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files as they appear below `path`."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str | None = "10 minutes") -> DataFrame:
    """Each key once within the watermark; state ends with it. Without a bound (None) no row is late and
    the state holds every key."""
    if late is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def bursts(stream: DataFrame, key: str, time: str, quiet: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): notifications of a key that follow each other within `quiet` are one burst."""
    w = F.session_window(F.col(time), quiet)
    out = stream.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed(stream: DataFrame, keys: list[str], time: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n) over tumbling or sliding windows."""
    w = F.window(F.col(time), size, slide or size)
    out = stream.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def apply_each(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Gives each batch to `apply` with its number, by which a batch that comes again can be told."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def delta(current: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """`current` without the deleted and replaced rows, and the upserts."""
    gone = deletes.select(key).unionByName(upserts.select(key)).distinct()
    return current.join(gone, key, "left_anti").unionByName(upserts)
