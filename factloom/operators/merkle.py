"""Merkle trees over directories: digests rolled up level by level, and a descent that looks only where two differ.

A directory's digest is that of its children's lines (kind, name, digest), hashed first by the beginning of
the names' hashes and then together, so that no row holds a large directory. Trees are tables with one row
a node, written by depth and in the order of their parents; the descent reads the children of directories
that differ, whose names, where they are few, go down to the scan as a filter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.tables import Rounds

#: depth: segments of the path, 0 for the root, whose path is empty; files: those below, itself if it is one.
TREE = "path string, parent string, kind string, digest string, files long, bytes long, depth int"
#: Directories whose names are given to the scan of the next level.
NAMED = 500


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, "").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def tree(files: DataFrame, max_depth: int = 128) -> DataFrame:
    """TREE of files (path, digest, bytes). Paths are canonical; one that is deeper than `max_depth` is refused."""
    rounds = Rounds(files.sparkSession, "merkle")
    path = F.col("path")
    leaves = files.select(path, _parent(path).alias("parent"), F.lit("file").alias("kind"), "digest", F.lit(1).cast("long").alias("files"), F.col("bytes").cast("long").alias("bytes"), F.size(F.split(path, "/")).alias("depth"))
    leaves = rounds.put(leaves)
    deepest = leaves.agg(F.max("depth")).first()[0]
    if deepest is None:
        return leaves
    if deepest > max_depth:
        raise ValueError(f"a path has {deepest} segments; {max_depth} are the most")
    all_, below = leaves, None
    for depth in range(deepest, 0, -1):
        own = leaves.where(F.col("depth") == depth)
        level = own if below is None else own.unionByName(below)
        line = F.concat_ws(":", "kind", _name(path), "digest")
        name = F.sha2(_name(path), 256)
        part = level.groupBy("parent", F.substring(name, 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        whole = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "d"))), "\n")
        up = part.groupBy(F.col("parent").alias("path")).agg(F.sha2(whole, 256).alias("digest"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        parent = F.when(path == "", F.lit(None)).otherwise(_parent(path))
        below = rounds.put(up.select("path", parent.alias("parent"), F.lit("directory").alias("kind"), "digest", "files", "bytes", F.lit(depth - 1).alias("depth")))
        all_ = all_.unionByName(below)
    return all_


def saved(nodes: DataFrame, path: str) -> DataFrame:
    """Writes a tree by depth, its rows by parent, and reads it."""
    nodes.repartitionByRange("depth", "parent", "path").sortWithinPartitions("depth", "parent", "path").write.partitionBy("depth").parquet(path)
    return nodes.sparkSession.read.schema(TREE).parquet(path)


def differences(old: DataFrame, new: DataFrame) -> tuple[DataFrame, list[int]]:
    """(path, change) of files between two trees, add, change or unlink, and the number of rows that each level
    of the descent looked at, both trees together."""
    spark = new.sparkSession
    rounds = Rounds(spark, "descent")
    looked: list[int] = []
    found = None
    far, depth = spark.createDataFrame([("",)], "d string"), 0
    n = 1
    while n:
        few = [r[0] for r in far.limit(NAMED + 1).collect()]  # names of directories, NAMED at most

        def level(side: DataFrame, few: list[str] = few, far: DataFrame = far, at: int = depth) -> DataFrame:
            rows = side.where(F.col("depth") == at)
            if at:
                rows = rows.where(F.col("parent").isin(few)) if len(few) <= NAMED else rows.join(far, F.col("parent") == F.col("d"), "left_semi")
            return rows.select("path", "kind", "digest")

        a = level(old).select(F.col("path").alias("__p"), F.col("kind").alias("__k"), F.col("digest").alias("__d"))
        met = level(new).join(a, F.col("path") == F.col("__p"), "full_outer")
        both = F.col("path").isNotNull().cast("int") + F.col("__p").isNotNull().cast("int")
        met, rows = rounds.counted(met.withColumn("rows", both))
        looked.append(met.agg(F.sum("rows")).first()[0] or 0 if rows else 0)
        differ = met.where(~(F.col("digest").eqNullSafe(F.col("__d")) & F.col("kind").eqNullSafe(F.col("__k"))))
        at = F.coalesce("path", "__p").alias("path")
        is_file, was_file = F.coalesce(F.col("kind") == "file", F.lit(False)), F.coalesce(F.col("__k") == "file", F.lit(False))
        change = F.when(is_file & was_file, "change").when(is_file, "add").when(was_file, "unlink")
        files = differ.select(at, change.alias("change")).where("change IS NOT NULL")
        found = files if found is None else found.unionByName(files)
        far, n = rounds.counted(differ.where((F.col("kind") == "directory") | (F.col("__k") == "directory")).select(F.coalesce("path", "__p").alias("d")))
        depth += 1
    return found, looked


def refreshed(previous: DataFrame, before: DataFrame, now: DataFrame, read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[int]]:
    """An inventory (path, ...) as a cold run gives it, from the previous one and the trees of the files' metadata
    before and now: `read` gets the paths (path) that are new or changed, and no others. Also the rows looked at."""
    changes, looked = differences(before, now)
    kept = previous.join(changes.select("path"), "path", "left_anti")
    return kept.unionByName(read(changes.where("change <> 'unlink'").select("path"))), looked
