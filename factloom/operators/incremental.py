"""Incremental views: what a change touches, what can be carried on, and what must be done again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.operators.diffs import diff


def affected(shapes: DataFrame, imports: DataFrame, changed: DataFrame) -> DataFrame:
    """(source, reason) that a change makes stale: the changed ones, and, where a changed source's
    declared shape differs, all that import it, near or far.

    shapes: (source, before, after) digests of declarations; imports: (src, dst), src imports dst.
    A source without a shape on either side counts as changed in shape.
    """
    wanted = changed.select("source").distinct()
    met = wanted.join(shapes.select(F.col("source").alias("__s"), "before", "after"), F.col("source") == F.col("__s"), "left")
    public = met.where(F.col("__s").isNull() | ~F.col("before").eqNullSafe(F.col("after")) | F.col("before").isNull())
    reached = graph.closure(graph.reverse(imports), public.select(F.col("source").alias("node")), include_seeds=False)
    near = wanted.select("source", F.lit("changed").alias("reason"))
    far = reached.select(F.col("node").alias("source"), F.lit("importer").alias("reason")).join(wanted, "source", "left_anti")
    return near.unionByName(far)


def carried(manifest: DataFrame, invalid: list[str]) -> DataFrame:
    """The shards of a manifest that stay as they are, by namespace."""
    return manifest.where(~F.col("namespace").isin(*invalid)) if invalid else manifest


def reconstruct(current: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """The whole manifest that a delta (shard_key, shard_digest) and (shard_key) makes of the current one."""
    gone = upserts.select("shard_key").unionByName(deletes.select("shard_key")).distinct()
    return current.select("shard_key", "shard_digest").join(gone, "shard_key", "left_anti").unionByName(upserts.select("shard_key", "shard_digest"))


def reusable(previous: DataFrame, specs: DataFrame) -> DataFrame:
    """Results (spec, identity, scope, status) that hold for the same spec identity; those whose scope
    is the universe never do."""
    now = specs.select(F.col("spec").alias("__s"), F.col("identity").alias("__i"))
    return previous.where("scope = 'specification'").join(now, (F.col("spec") == F.col("__s")) & (F.col("identity") == F.col("__i")), "left_semi")


def overlay(base: DataFrame, changed: DataFrame, key: str, payload: str) -> DataFrame:
    """`base` with the payloads of the keys that `changed` has; keys that base lacks are left out, as a
    change of the set of keys is a rebuild (`same_keys` tells)."""
    new = changed.select(F.col(key).alias("__k"), F.col(payload).alias("__p"), F.lit(True).alias("__has"))
    return base.join(new, F.col(key) == F.col("__k"), "left").withColumn(payload, F.when(F.col("__has"), F.col("__p")).otherwise(F.col(payload))).drop("__k", "__p", "__has")


def same_keys(old: DataFrame, new: DataFrame, key: str) -> bool:
    return diff(old.select(key, F.lit(1).alias("v")), new.select(key, F.lit(1).alias("v")), key, "v").isEmpty()


def history(files: DataFrame, keep: int, key: str = "path", order: str = "at") -> DataFrame:
    """The last `keep` versions of each key: a bounded history."""
    from factloom.operators.ownership import latest

    return latest(files, [key], [F.desc(order)], keep)
