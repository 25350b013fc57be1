"""Who owns a path and who depends on the owner: an index over specifications' resources, and what a
change of a path makes stale, with the whole corpus where the index can't know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.identity import ancestors, canonical_path
from factloom.operators import graph

# Paths by which a change is judged.
SOURCES = r"\.(?:cts|mts|tsx?|cjs|mjs|jsx?|d\.ts)$|(^|/)\.spec/"
SCHEMAS = r"(^|/)\.spec/(?:.*)\.schema\.json$"
PACKAGES = r"(^|/)package\.json$"
CONFIGURATIONS = r"(^|/)tsconfig[^/]*\.json$"


def ownership(specs: DataFrame, resources: DataFrame) -> DataFrame:
    """(path, owner): paths that specifications own. specs: (owner, root, authority); resources: (owner,
    family, path), of whatever family; a test's path is relative to the owner's root and left out where
    it leads out of the repository."""
    root = specs.select(F.col("owner").alias("__o"), "root")
    met = resources.join(root, F.col("owner") == F.col("__o"))
    inside = F.when(F.col("root").isin("", "."), F.col("path")).otherwise(F.concat("root", F.lit("/"), "path"))
    odd = F.col("path").startswith("/") | F.col("path").contains("\\") | F.col("path").rlike("^[A-Za-z]:")
    path = F.when(F.col("family") != "test", F.col("path")).when(~odd, normal(inside))
    own = specs.select("owner", F.explode(F.array("owner", "authority")).alias("path"))
    return own.unionByName(met.select("owner", path.alias("path"))).where(canonical_path(F.col("path"))).select("path", "owner").distinct()


def normal(path: Column) -> Column:
    """A path without "." and empty segments and with ".." resolved; null where it leads out."""
    step = lambda up, s: F.when(s.isin("", "."), up).when((s == "..") & (F.size(up) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), up), -1) != ".."), F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(0)))).otherwise(F.array_append(up, s))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when((F.size(parts) > 0) & (F.get(parts, F.lit(0)) != ".."), F.array_join(parts, "/"))


def dependencies(owned: DataFrame, uses: DataFrame) -> DataFrame:
    """(src, dst): owners that depend on owners, by uses (owner, path) of owned paths."""
    by = owned.select(F.col("path").alias("__p"), F.col("owner").alias("dst"))
    return uses.join(by, F.col("path") == F.col("__p")).where("owner != dst").select(F.col("owner").alias("src"), "dst").distinct()


def direct_owners(changes: DataFrame, specs: DataFrame, owned: DataFrame, uses: DataFrame, schemas: DataFrame) -> DataFrame:
    """(path, owner) for changes (path): owners of the path, users of a path that no one owns, owners of
    any schema where the path is a schema's, and owners whose root holds the path.

    schemas: (owner, path). The roots are found by equality with the path's ancestors.
    """
    p = changes.select("path").distinct()
    join = lambda df: p.join(df.select(F.col("path").alias("__p"), "owner"), F.col("path") == F.col("__p")).select("path", "owner")
    outside = uses.join(owned.select("path"), "path", "left_anti")
    known = schemas.select(F.col("path").alias("__s")).distinct()
    schema_like = p.join(known, F.col("path") == F.col("__s"), "left").where(F.col("__s").isNotNull() | F.col("path").rlike(SCHEMAS)).select("path", F.lit(1).alias("k"))
    every = schema_like.join(schemas.select("owner").distinct().withColumn("k", F.lit(1)), "k").select("path", "owner")
    roots = specs.select(F.when(F.col("root").isin("", "."), "").otherwise(F.col("root")).alias("__r"), "owner")
    held = p.withColumn("__up", F.explode(F.array_union(F.array(F.lit("")), ancestors(F.col("path"))))).join(roots, F.col("__up") == F.col("__r")).select("path", "owner")
    return join(owned).unionByName(join(outside)).unionByName(every).unionByName(held).distinct()


def fallback(path: Column, kind: Column, ambiguous: Column, unknown: Column) -> Column:
    """Sorted reasons why a change can't be told exactly: topology, where sources come or go or the caller
    says so; and, of paths that no one owns, declarations and configurations."""
    moved = kind.isin("add", "delete", "unlink") & path.rlike(SOURCES)
    reasons = F.array(
        F.when(unknown & path.rlike(PACKAGES), "package-configuration"),
        F.when(F.coalesce(ambiguous, F.lit(False)) | F.coalesce(moved, F.lit(False)), "topology-ambiguity"),
        F.when(unknown & path.rlike(CONFIGURATIONS), "typescript-configuration"),
        F.when(unknown & path.endswith(".d.ts"), "unknown-declaration"),
    )
    return F.array_compact(reasons)


def impacts(changes: DataFrame, specs: DataFrame, resources: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, owner, relation, completeness, reasons), a row for each owner to refresh, or one with a null
    owner: relation is direct, dependent, or other where all are refreshed. changes: (path, kind,
    ambiguous); specs, resources: as for `ownership`, schemas being the family schema; uses: (owner, path)."""
    owned = ownership(specs, resources)
    direct = direct_owners(changes, specs, owned, uses, resources.where("family = 'schema'").select("owner", "path"))
    edges = graph.reverse(dependencies(owned, uses))
    # the walk is taken once for each direct owner, whatever the number of its paths
    pairs = graph.closure_from(edges, direct.select(F.col("owner").alias("node")))
    near = direct.select("path", F.col("owner").alias("__o")).join(pairs, F.col("__o") == F.col("seed")).groupBy("path", F.col("node").alias("owner")).agg(F.min("distance").alias("d"))
    exact = near.select("path", "owner", F.when(F.col("d") == 0, "direct").otherwise("dependent").alias("relation"))
    seen = direct.groupBy(F.col("path").alias("__p")).agg(F.count("*").alias("n"))
    told = changes.dropDuplicates(["path"]).join(seen, F.col("path") == F.col("__p"), "left")
    told = told.select("path", fallback(F.col("path"), F.col("kind"), F.col("ambiguous"), F.col("n").isNull()).alias("reasons"))
    told = told.withColumn("completeness", F.when(F.size("reasons") > 0, "conservative-full").otherwise("exact"))
    wide = told.where("completeness = 'conservative-full'").select("path", F.lit(1).alias("k")).join(specs.select("owner").distinct().withColumn("k", F.lit(1)), "k").select("path", "owner")
    every = wide.join(exact.select("path", "owner"), ["path", "owner"], "left_anti").select("path", "owner", F.lit("other").alias("relation"))
    rows = exact.unionByName(every).select(F.col("path").alias("__p"), "owner", "relation")
    return told.join(rows, F.col("path") == F.col("__p"), "left").select("path", "owner", "relation", "completeness", "reasons")
