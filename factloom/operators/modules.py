"""Modules: verified texts, boundaries, ports, and the grammar of their folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.identity import ancestors, derive_id


def verify_text(requests: DataFrame, files: DataFrame, repository: str = "local") -> DataFrame:
    """(path, status): verified where the file's digest and the revision derived from it are those
    asked for (path, digest, revision), stale where they aren't, unavailable without the file."""
    there = files.select(F.col("path").alias("__p"), F.col("digest").alias("__d"))
    met = requests.join(there, F.col("path") == F.col("__p"), "left")
    revision = derive_id("source-revision", repository, F.concat("path", F.lit("\n"), "__d"))
    same = (F.col("digest") == F.col("__d")) & (F.col("revision") == revision)
    return met.select("path", F.when(F.col("__d").isNull(), "unavailable").when(same, "verified").otherwise("stale").alias("status"))


def boundaries(specs: DataFrame, roots: DataFrame) -> DataFrame:
    """(spec, root, code) of specs (spec, path) against boundary roots (root): the one that holds it,
    BOUNDARY_MISSING for none and BOUNDARY_AMBIGUOUS for several."""
    up = specs.withColumn("__up", F.explode(F.array_union(F.array(F.lit("")), ancestors(F.col("path")))))
    held = up.join(roots.select(F.col("root").alias("__root")), F.col("__up") == F.col("__root")).groupBy(F.col("spec").alias("__s")).agg(F.count("*").alias("n"), F.min("__root").alias("root"))
    met = specs.select("spec").distinct().join(held, F.col("spec") == F.col("__s"), "left")
    code = F.when(F.col("n").isNull(), "BOUNDARY_MISSING").when(F.col("n") > 1, "BOUNDARY_AMBIGUOUS")
    return met.select("spec", F.when(F.col("n") == 1, F.col("root")).alias("root"), code.alias("code"))


def ports(exports: DataFrame) -> DataFrame:
    """(module, port, code) of exports (module, name, kind, local): a module's port is its one exported
    local interface; PORT_MISSING, PORT_AMBIGUOUS, and PORT_NAME_REPEATED across modules."""
    fits = F.when((F.col("kind") == "interface") & F.col("local"), F.col("name"))
    per = exports.groupBy("module").agg(F.count(fits).alias("n"), F.min(fits).alias("port"))
    names = per.where("n = 1").groupBy(F.col("port").alias("__p")).agg(F.count("*").alias("same"))
    met = per.join(names, (F.col("port") == F.col("__p")) & (F.col("n") == 1), "left")
    code = F.when(F.col("n") == 0, "PORT_MISSING").when(F.col("n") > 1, "PORT_AMBIGUOUS").when(F.col("same") > 1, "PORT_NAME_REPEATED")
    return met.select("module", F.when(F.col("n") == 1, F.col("port")).alias("port"), code.alias("code"))


def grammar_errors(entries: DataFrame, grammar: DataFrame, open_folders: list[str], marker: str = ".spec") -> DataFrame:
    """(path, code) of entries (path, kind file|directory|link) in marked folders: links, entries that
    the grammar (pattern, kind) doesn't know, and those of another kind; open folders hold anything."""
    inside = entries.withColumn("__in", F.regexp_extract("path", rf"(?:^|/){marker.replace('.', chr(92) + '.')}/(.+)$", 1)).where("__in != ''")
    for f in open_folders:
        inside = inside.where(~(F.col("__in").startswith(f + "/")))
    known = grammar.select(F.col("pattern").alias("__g"), F.col("kind").alias("__kind"))
    met = inside.join(known, F.col("__in") == F.col("__g"), "left")
    code = F.when(F.col("kind") == "link", "ENTRY_LINK").when(F.col("__g").isNull(), "ENTRY_UNKNOWN").when(F.col("kind") != F.col("__kind"), "ENTRY_KIND")
    return met.select("path", code.alias("code")).where("code IS NOT NULL")


def topology_fingerprint(files: DataFrame) -> DataFrame:
    """(directory, fingerprint): what each directory holds by name, so that equal ones needn't be read."""
    segments = F.split("path", "/")
    parent = F.array_join(F.slice(segments, 1, F.size(segments) - 1), "/")
    named = files.select(parent.alias("directory"), F.element_at(segments, -1).alias("name"))
    return named.groupBy("directory").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("name")), "\n"), 256).alias("fingerprint"))


def sorted_unique(values: Column) -> Column:
    """Whether an array rises strictly."""
    return values == F.array_sort(F.array_distinct(values))


def disjoint(left: Column, right: Column) -> Column:
    """Whether two arrays have nothing in common."""
    return F.size(F.array_intersect(left, right)) == 0
