"""Differences between two versions of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed, by a full outer join; equal rows are left out."""
    a = old.select(F.col(key).alias("__ok"), F.col(value).alias("__ov"), F.lit(True).alias("__o"))
    b = new.select(F.col(key).alias("__nk"), F.col(value).alias("__nv"), F.lit(True).alias("__n"))
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(~F.col("__ov").eqNullSafe(F.col("__nv")), "changed")
    return a.join(b, F.col("__ok").eqNullSafe(F.col("__nk")), "full_outer").select(F.coalesce("__ok", "__nk").alias(key), change.alias("change")).where("change IS NOT NULL")


def digest_by(rows: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(key, digest): sha256 over each key's rows, their parts joined, in order."""
    line = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return rows.select(key, line.alias("__line")).groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__line")), "\n"), 256).alias("digest"))


def manifest_changes(current: DataFrame, following: DataFrame) -> DataFrame:
    """(shard_key, change) between manifests: upsert where the digest is new, delete where it went."""
    found = diff(current, following, "shard_key", "shard_digest")
    return found.select("shard_key", F.when(F.col("change") == "removed", "delete").otherwise("upsert").alias("change"))


def equal_sets(left: DataFrame, right: DataFrame) -> bool:
    """Whether both hold the same rows, as sets."""
    return left.subtract(right).isEmpty() and right.subtract(left).isEmpty()


def equal_sets_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, same): whether both sides hold the same rows, as sets, in each group of either: one shuffle for all groups."""
    rows = left.columns
    both = left.distinct().withColumn("__side", F.lit(1)).unionByName(right.select(*rows).distinct().withColumn("__side", F.lit(2)))
    sides = both.groupBy(*rows).agg(F.sum("__side").alias("__sides"))
    return sides.groupBy(*keys).agg(F.min(F.col("__sides") == 3).alias("same"))
