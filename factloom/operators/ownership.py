"""Owners of paths: the deepest root that holds a path, found by equality with its ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.identity import ancestors


def candidates(paths: DataFrame, owners: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Every (path row, owner row) with the path at or below the owner's root, and the root's depth.

    A prefix test would compare all pairs; the path's few ancestors are joined by equality instead.
    The root "" holds everything.
    """
    up = F.array_union(F.array(F.lit("")), ancestors(F.col(path)))
    each = paths.withColumn("__up", F.explode(up))
    depth = F.when(F.col(root) == "", 0).otherwise(F.size(F.split(F.col(root), "/")))
    return each.join(owners, F.col("__up") == F.col(root)).drop("__up").withColumn("depth", depth)


def deepest(paths: DataFrame, owners: DataFrame, path: str = "path", root: str = "root", keys: list[str] | None = None) -> DataFrame:
    """The candidates of greatest depth for each path; ties all stay, paths without an owner go."""
    w = Window.partitionBy(*(keys or [path])).orderBy(F.desc("depth"))
    return candidates(paths, owners, path, root).withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")


def tree_parent(nodes: DataFrame, path: str = "path") -> DataFrame:
    """(path, parent): the nearest ancestor that is a node itself; null for a root."""
    up = nodes.select(F.col(path).alias("__p"), F.posexplode(ancestors(F.col(path), False)).alias("d", "up"))
    known = nodes.select(F.col(path).alias("__n"))
    best = up.join(known, F.col("up") == F.col("__n")).groupBy("__p").agg(F.max(F.struct("d", "up")).getField("up").alias("parent"))
    return nodes.select(path).join(best, F.col(path) == F.col("__p"), "left").select(path, "parent")


def resolve_targets(targets: DataFrame, owners: DataFrame, target: str = "target", root: str = "root", owner: str = "owner") -> DataFrame:
    """(target, owner) by a ladder: "." is all; an exact owner; a root with those below it; those
    below the target; the deepest root that holds it. The first rung with an owner counts."""
    t = targets.select(target).distinct()
    o = owners.select(owner, root)
    every = t.where(F.col(target) == ".").join(o).withColumn("rung", F.lit(0))
    exact = t.join(o, F.col(target) == F.col(owner)).withColumn("rung", F.lit(1))
    below = o.withColumn("__up", F.explode(F.array_union(F.array(F.col(root)), ancestors(F.col(root)))))
    under = t.join(below, F.col(target) == F.col("__up")).drop("__up").withColumn("rung", F.lit(2))
    hold = deepest(t, o, target, root).drop("depth").withColumn("rung", F.lit(3))
    found = every.unionByName(exact).unionByName(under).unionByName(hold)
    w = Window.partitionBy(target).orderBy("rung")
    return found.withColumn("__r", F.rank().over(w)).where("__r = 1").select(target, owner).distinct()


def canonical(rows: DataFrame, identity: list[str], ranking: list[Column]) -> DataFrame:
    """One row for each identity: the first by `ranking`."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*identity).orderBy(*ranking))).where("__r = 1").drop("__r")


def latest(rows: DataFrame, keys: list[str], order: list[Column], top: int = 1) -> DataFrame:
    """The first `top` rows of each key; a retention rule, or the latest version of something."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= top).drop("__r")


def retained(rows: DataFrame, keys: list[str], order: list[Column], top: int, held: DataFrame) -> DataFrame:
    """The first `top` rows of each key, and those that a lease holds: held has some columns of rows."""
    numbered = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    marks = held.distinct().withColumn("__held", F.lit(True))
    return numbered.join(marks, held.columns, "left").where((F.col("__r") <= top) | F.col("__held")).select(*rows.columns)
