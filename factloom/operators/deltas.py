"""Grouped statistics kept up by deltas: exact order statistics from counts of values, with no file read again.

The state has a row for each (dimension, key, value): how many files of the group have the value, and their
bytes. Additions and removals are signed rows of the same kind, summed before they are merged, so a batch
costs what it changes; counts are added, so batches merge in any order and grouping. Sums, means and
nearest-rank percentiles follow from the state exactly. What can't be taken back from sums, the largest
file's name, isn't kept.

A group has as many rows as it has distinct values, not files. Percentiles run over them in two steps, by
parts of the value's range and within the part that has the rank, so no task holds a group of many values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATE = "dimension string, key string, value long, files long, bytes long"
#: Values of one part of the range.
SPAN = 1_024


def signed(files: DataFrame, dimensions: dict[str, Column], value: Column, size: Column, sign: int = 1) -> DataFrame:
    """STATE rows of files that come (1) or go (-1), each counted once in every dimension."""
    pairs = [F.struct(F.lit(name).alias("dimension"), F.coalesce(key.cast("string"), F.lit("unassigned")).alias("key")) for name, key in dimensions.items()]
    long = files.select(value.cast("long").alias("value"), size.cast("long").alias("size"), F.explode(F.array(*pairs)).alias("d"))
    return merged(long.select("d.dimension", "d.key", "value", F.lit(sign).cast("long").alias("files"), (F.col("size") * sign).alias("bytes")))


def merged(*states: DataFrame) -> DataFrame:
    """The sum of states and deltas; values that no file has any more go."""
    all_ = states[0]
    for s in states[1:]:
        all_ = all_.unionByName(s)
    return all_.groupBy("dimension", "key", "value").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes")).where("files <> 0 OR bytes <> 0")


def applied(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state after a delta: rows of groups that it doesn't touch pass as they are, without a shuffle of theirs
    where Spark broadcasts the delta's groups."""
    touched = delta.select("dimension", "key").distinct()
    rest = state.join(touched, ["dimension", "key"], "left_anti")
    return rest.unionByName(merged(state.join(touched, ["dimension", "key"], "left_semi"), delta))


def faults(state: DataFrame) -> DataFrame:
    """Rows with fewer files than none: something was taken away that was never added."""
    return state.where("files < 0")


def percentiles(state: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """(dimension, key, ...): the value at rank ceil(ratio * files) for each name in `ratios`."""
    keys = ["dimension", "key"]
    part = F.floor(F.col("value") / SPAN)
    parts = state.groupBy(*keys, part.alias("part")).agg(F.sum("files").alias("n"))
    order = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.lit(r) * F.col("total")).cast("long").alias("rank")) for name, r in ratios.items()]))
    asked = parts.select(*keys, "part", "n", "upto", ranks.alias("x")).where((F.col("x.rank") <= F.col("upto")) & (F.col("x.rank") > F.col("upto") - F.col("n")))
    asked = asked.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("part").alias("__part"), F.col("x.name").alias("name"), (F.col("x.rank") - F.col("upto") + F.col("n")).alias("within"))
    met = state.withColumn("__at", part).join(asked, (F.col("dimension") == F.col("__dimension")) & (F.col("key") == F.col("__key")) & (F.col("__at") == F.col("__part")))
    so_far = F.sum("files").over(Window.partitionBy(*keys, "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    hit = met.withColumn("so_far", so_far).where("so_far >= within AND so_far - files < within")
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in ratios])


def summaries(state: DataFrame) -> DataFrame:
    """(dimension, key, files, bytes, total, average, median, p95) of every group that has files."""
    sums = state.groupBy("dimension", "key").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum(F.col("value") * F.col("files")).alias("total")).where("files > 0")
    ranks = percentiles(state, {"median": 0.5, "p95": 0.95})
    return sums.join(ranks, ["dimension", "key"], "left").select("dimension", "key", "files", "bytes", "total", F.round(F.col("total") / F.col("files"), 2).alias("average"), "median", "p95")


def maintained(state: DataFrame, batches: list[tuple[DataFrame, DataFrame]], measure: Callable[[DataFrame, int], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The state after batches of (added, removed) files. `measure` gives `signed` rows of files; `keep` writes a
    state and reads it, so that a batch starts from a table."""
    for added, removed in batches:
        state = keep(applied(state, merged(measure(added, 1), measure(removed, -1))))
    return state
