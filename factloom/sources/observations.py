"""Observations of modules as facts: four shards for each module, committed to a ledger, and those of
modules that nothing changed in kept as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.classify import media_type, presentation
from factloom.functions.identity import derive_id
from factloom.operators.ledger import Generation, Ledger, digests

#: Observation -> kind of its facts.
KINDS = {"layout": "layout-observation", "test": "test-evidence", "schema": "schema-catalog", "context": "module-context"}


def context(specs: DataFrame, inventory: DataFrame) -> DataFrame:
    """(spec, payload): a module's architecture text, icon and history among the inventory's files (source,
    revision, path, bytes). specs: (spec, folder, root): the module's specification folder and its root."""
    files = inventory.select("path", F.struct("source", "revision", "path", F.col("bytes").cast("long").alias("bytes"), media_type(F.col("path")).alias("media_type"), presentation(F.col("path")).alias("presentation")).alias("file"))
    named = F.explode(F.array(F.struct(F.lit("architecture").alias("role"), F.concat("folder", F.lit("/architecture.md")).alias("at")), F.struct(F.lit("icon").alias("role"), F.concat("folder", F.lit("/icon.svg")).alias("at"))))
    single = specs.select("spec", named.alias("n")).join(files, F.col("n.at") == F.col("path")).select("spec", "n.role", "file")
    # a history folder is an ancestor of its files: they are met by its name, cut out of their paths
    root = F.when(F.col("root").isin("", "."), ".history").otherwise(F.concat("root", F.lit("/.history")))
    places = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/")), lambda p: (p == ".history") | p.endswith("/.history"))
    past = files.select("path", "file", F.explode(places).alias("at")).join(specs.select("spec", root.alias("__h")), F.col("at") == F.col("__h")).where(F.col("path") != F.col("at")).select("spec", F.lit("history").alias("role"), "file")
    rows = single.unionByName(past).groupBy("spec").agg(
        F.max(F.when(F.col("role") == "architecture", F.col("file"))).alias("architecture"), F.max(F.when(F.col("role") == "icon", F.col("file"))).alias("icon"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "history", F.struct(F.col("file.path").alias("p"), F.col("file").alias("f"))))).alias("history"),
    )
    shape = F.struct("architecture", "icon", F.transform("history", lambda x: x["f"]).alias("history"))
    none = F.lit('{"history":[]}')
    return specs.select("spec").distinct().join(rows.select(F.col("spec").alias("__s"), F.to_json(shape).alias("payload")), F.col("spec") == F.col("__s"), "left").select("spec", F.coalesce("payload", none).alias("payload"))


def facts(kind: str, observed: DataFrame) -> DataFrame:
    """Facts of one observation (spec, payload), a shard for each module."""
    namespace = f"observation.{kind}"
    ident: Column = derive_id("fact", namespace, F.col("spec"))
    return observed.select(
        derive_id("fact-shard-key", namespace, F.col("spec")).alias("shard_key"), F.lit(None).cast("string").alias("shard_digest"), ident.alias("fact_id"), F.lit(namespace).alias("namespace"),
        F.lit(1).alias("schema_version"), F.lit(KINDS[kind]).alias("kind"), F.col("spec").alias("subject"),
        F.struct(F.lit("complete").alias("kind"), F.array().cast("array<struct<code:string,message:string>>").alias("reasons")).alias("completeness"),
        F.lit("module.observation").alias("pass_id"), F.lit("1").alias("pass_version"), F.array().cast("array<struct<source:string,revision:string,start:bigint,`end`:bigint>>").alias("evidence"),
        F.array().cast("array<string>").alias("inputs"), "payload",
    )


def materialize(ledger: Ledger, universe: str, specs: DataFrame, observations: dict[str, DataFrame], source_manifest: str, refresh: DataFrame | None = None) -> Generation:
    """The next generation of modules' observations, kind -> (spec, payload). With `refresh` (spec) only
    these modules and new ones are looked at; others keep their shards. Modules that are gone lose theirs.
    Where nothing changed the current generation stays."""
    now = ledger.current(universe)
    rows = None
    for kind in KINDS:
        part = facts(kind, observations[kind].join(specs.select("spec").distinct(), "spec", "left_semi"))
        rows = part if rows is None else rows.unionByName(part)
    keys = specs.select("spec").distinct().select(F.col("spec"), F.explode(F.array(*[derive_id("fact-shard-key", f"observation.{k}", F.col("spec")) for k in KINDS])).alias("shard_key"))
    if now is None:
        return ledger.commit(universe, None, rows, [], "observation", source_manifest, [f"observation.{k}" for k in KINDS])
    have = ledger.manifest(now)
    if refresh is not None:
        new = keys.join(have.select("shard_key"), "shard_key", "left_anti").select("spec").distinct()
        rows = rows.join(refresh.select("spec").unionByName(new).distinct().withColumnRenamed("spec", "subject"), "subject", "left_semi")
    gone = [r[0] for r in have.join(keys.select("shard_key"), "shard_key", "left_anti").select("shard_key").collect()]  # names, one for each shard that goes
    new = digests(rows).select("shard_key", "shard_digest").join(have.select("shard_key", "shard_digest"), ["shard_key", "shard_digest"], "left_anti")
    if not gone and now.source_manifest == source_manifest and new.isEmpty():
        return now
    return ledger.commit(universe, now, rows, gone, "observation", source_manifest, [f"observation.{k}" for k in KINDS])
