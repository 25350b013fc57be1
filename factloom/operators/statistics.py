"""Repository statistics: summaries, groupings in many dimensions, incremental refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentile(value: str, ratio: float, kind: str = "bigint") -> Column:
    """Aggregate: nearest rank, the value at ceil(ratio * n); 0 of nothing."""
    return F.coalesce(F.expr(f"percentile_disc({ratio}) WITHIN GROUP (ORDER BY `{value}`)"), F.lit(0)).cast(kind)


def largest(value: str, size: str | None, path: str) -> Column:
    """Aggregate: the path with the greatest value, then size, then the least path."""
    # min over negated numbers, so that the path's tie-break is ascending
    parts = [(-F.col(value)).alias("v")] + ([(-F.col(size)).alias("s")] if size else []) + [F.col(path).alias("p")]
    return F.min(F.struct(*parts)).getField("p")


def summary(value: str = "code", size: str = "bytes", path: str = "path", metrics: tuple[str, ...] = ()) -> list[Column]:
    """Files, bytes, the sums of line metrics, mean, median, 95th percentile and largest file."""
    return [
        F.count("*").alias("files"), F.sum(size).alias("bytes"), *[F.sum(m).alias(m) for m in metrics],
        F.round(F.avg(value), 2).alias("average"), percentile(value, 0.5).alias("median"), percentile(value, 0.95).alias("p95"), largest(value, size, path).alias("largest"),
    ]


def grouped(files: DataFrame, dimensions: dict[str, Column], aggregates: list[Column]) -> DataFrame:
    """(dimension, key, aggregates...): every file counted once in each dimension.

    The rows are unpivoted and grouped in one shuffle; a null key is "unassigned".
    """
    pairs = [F.struct(F.lit(name).alias("dimension"), F.coalesce(key.cast("string"), F.lit("unassigned")).alias("key")) for name, key in dimensions.items()]
    long = files.withColumn("__d", F.explode(F.array(*pairs))).withColumn("dimension", F.col("__d.dimension")).withColumn("key", F.col("__d.key"))
    return long.groupBy("dimension", "key").agg(*aggregates)


def grouped_many(files: DataFrame, name: str, keys: Column, aggregates: list[Column]) -> DataFrame:
    """(dimension, key, aggregates...) where a file may have several keys; a key that repeats counts once."""
    long = files.withColumn("key", F.explode(F.array_distinct(keys)))
    return long.groupBy(F.lit(name).alias("dimension"), "key").agg(*aggregates)


def refresh(previous: DataFrame, inventory: DataFrame, analyze: Callable[[DataFrame], DataFrame], analyzer: str, columns: list[str]) -> DataFrame:
    """Statistics of `inventory` (source, revision, ...), reusing those of `previous` (source, revision,
    analyzer, level, columns...) that are of the same revision and analyzer and complete.

    `analyze` gets the other files only and adds `columns`. The result is that of a cold run.
    """
    usable = previous.where((F.col("analyzer") == analyzer) & (F.col("level") == "complete"))
    kept = usable.select(F.col("source").alias("__s"), F.col("revision").alias("__r"), *columns)
    same = (F.col("source") == F.col("__s")) & (F.col("revision") == F.col("__r"))
    reused = inventory.join(kept, same).select("source", "revision", *columns)
    anew = analyze(inventory.join(kept.select("__s", "__r"), same, "left_anti")).select("source", "revision", *columns)
    return reused.unionByName(anew).withColumn("analyzer", F.lit(analyzer)).withColumn("level", F.lit("complete"))


def coverage(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Forward and inverse matches of obligations (rule, status): inverse ones start with "observed."."""
    inverse, ok = F.col("rule").startswith("observed."), F.col("status") == "pass"
    return rules.groupBy(*keys).agg(
        F.count_if(~inverse & ok).alias("forward_matched"), F.count_if(~inverse).alias("forward_total"),
        F.count_if(inverse & ok).alias("inverse_matched"), F.count_if(inverse).alias("inverse_total"),
    )
