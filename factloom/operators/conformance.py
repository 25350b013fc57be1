"""Conformance: expected against observed, in both directions, and the roll-up of obligations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.identity import ancestors, glob_regex
from factloom.operators.completeness import CONFORMANCE, obligation, rank, status


def compare(expected: DataFrame, observed: DataFrame, key: str, value: str) -> DataFrame:
    """(key, code): matched, mismatch, missing (expected only) or undeclared (observed only)."""
    e = expected.select(F.col(key).alias("__ek"), F.col(value).alias("__ev"), F.lit(True).alias("__e"))
    o = observed.select(F.col(key).alias("__ok"), F.col(value).alias("__ov"), F.lit(True).alias("__o"))
    code = F.when(F.col("__o").isNull(), "missing").when(F.col("__e").isNull(), "undeclared").when(F.col("__ev").eqNullSafe(F.col("__ov")), "matched").otherwise("mismatch")
    return e.join(o, F.col("__ek") == F.col("__ok"), "full_outer").select(F.coalesce("__ek", "__ok").alias(key), code.alias("code"))


def layout(expected: DataFrame, observed: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """(path, code) of a module's layout: matched, mismatch (another kind), missing, additional; a child
    whose parent isn't matched is suppressed. Both tables: (path, kind).

    `ignore` globs drop observed paths, but for declared ones and their parents.
    """
    declared = expected.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    seen = observed
    if ignore:
        out = F.lit(False)
        for g in ignore:
            out = out | F.col("path").rlike(glob_regex(g))
        seen = observed.where(~out).unionByName(observed.where(out).join(declared, "path", "left_semi"))
    found = compare(expected, seen, "path", "kind").withColumn("code", F.when(F.col("code") == "undeclared", "additional").otherwise(F.col("code")))
    parent = F.try_element_at(ancestors(F.col("path"), False), F.lit(-1))
    bad = found.where("code IN ('missing', 'mismatch')").select(F.col("path").alias("__bad"))
    up = found.withColumn("__up", F.explode_outer(ancestors(F.col("path"), False)))
    lost = up.join(bad, F.col("__up") == F.col("__bad"), "left_semi").select(F.col("path").alias("__lost")).distinct()
    return found.join(lost, F.col("path") == F.col("__lost"), "left").select("path", F.when(F.col("__lost").isNotNull(), "suppressed").otherwise(F.col("code")).alias("code"), parent.alias("parent"))


def packages(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """(package, file, code) of imports (package, file, dev): declared exactly or by a pattern with a
    final *, development-only outside of tests, or undeclared. declared: (package, dev)."""
    exact = declared.where(~F.col("package").endswith("*")).groupBy(F.col("package").alias("__p")).agg(F.min("dev").alias("__dev"))
    patterns = declared.where(F.col("package").endswith("*")).select(F.expr("substr(package, 1, length(package) - 1)").alias("__prefix"), F.col("dev").alias("__pdev"))
    met = observed.join(exact, F.col("package") == F.col("__p"), "left")
    # a pattern holds what begins with it: the package's beginnings are joined by equality
    names = observed.select("package").distinct().withColumn("__b", F.explode(F.transform(F.sequence(F.lit(0), F.length("package")), lambda n: F.substr("package", F.lit(1), n))))
    by = names.join(patterns, F.col("__b") == F.col("__prefix")).groupBy(F.col("package").alias("__q")).agg(F.min("__pdev").alias("__pdev"))
    met = met.join(by, F.col("package") == F.col("__q"), "left")
    dev = F.coalesce(F.least("__dev", "__pdev"), "__dev", "__pdev")
    code = F.when(dev.isNull(), "undeclared").when(dev & ~is_test(F.col("file")), "development-only").otherwise("declared")
    return met.select("package", "file", code.alias("code"))


#: Fixed value: what makes a file one of tests.
TESTS = r"(^|/)(tests|__tests__)(/|$)|(^|/)[^/]+\.(test|spec|bench|perf)\.[cm]?[jt]sx?$"


def is_test(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(TESTS)


def bind_seeds(candidates: DataFrame) -> DataFrame:
    """(expected, observed) from candidates (expected, observed, alias boolean): a direct one beats
    aliases; where the best are several the seed is ambiguous and dropped."""
    best = candidates.groupBy("expected").agg(F.min("alias").alias("__alias"))
    top = candidates.join(best.withColumnRenamed("expected", "__e"), (F.col("expected") == F.col("__e")) & (F.col("alias") == F.col("__alias")))
    one = top.groupBy("expected").agg(F.count_distinct("observed").alias("n"), F.min("observed").alias("observed"))
    return one.where("n = 1").select("expected", "observed")


def inverse_closure(observed: DataFrame, bound: DataFrame, key: str) -> DataFrame:
    """Observed declarations that nothing expected was bound to."""
    return observed.join(bound.select(key).distinct(), key, "left_anti")


def resolve_obligations(obligations: DataFrame, results: DataFrame) -> DataFrame:
    """(obligation, status, code): each obligation's folded result; one without a result is an error."""
    folded = results.groupBy(F.col("obligation").alias("__o")).agg(obligation(F.col("status")).alias("status"))
    met = obligations.join(folded, F.col("obligation") == F.col("__o"), "left")
    return met.select("obligation", F.coalesce("status", F.lit("error")).alias("status"), F.when(F.col("status").isNull(), "OBLIGATION_UNEVALUATED").alias("code"))


def qualify(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(status(F.col("status"), CONFORMANCE).alias("status"))


def target_rule(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One target passes, none is indeterminate (where keys are given with a null target), several fail."""
    n = F.count("target")
    return rows.groupBy(*keys).agg(F.when(n == 1, "pass").when(n == 0, "indeterminate").otherwise("fail").alias("status"))


def evidence_of_tests(references: DataFrame, tests: DataFrame) -> DataFrame:
    """(reference, status): references (reference, file, id) resolve to tests (file, id, state); active
    ones pass, skipped or todo ones are indeterminate, unresolved ones fail."""
    state = tests.groupBy(F.col("file").alias("__f"), F.col("id").alias("__i")).agg(F.min("state").alias("state"))
    met = references.join(state, (F.col("file") == F.col("__f")) & (F.col("id") == F.col("__i")), "left")
    return met.select("reference", F.when(F.col("state") == "active", "pass").when(F.col("state").isin("skip", "todo"), "indeterminate").otherwise("fail").alias("status"))


def semantic_errors(capabilities: DataFrame, known: DataFrame, exact: DataFrame, patterns: DataFrame) -> DataFrame:
    """(code, subject): unknown capabilities, and exact packages that a pattern holds already."""
    unknown = capabilities.join(known, "capability", "left_anti").select(F.lit("CAPABILITY_UNKNOWN").alias("code"), F.col("capability").alias("subject"))
    begin = exact.withColumn("__b", F.explode(F.transform(F.sequence(F.lit(0), F.length("package")), lambda n: F.concat(F.substr("package", F.lit(1), n), F.lit("*")))))
    held = begin.join(patterns, F.col("__b") == F.col("pattern"), "left_semi").select(F.lit("PACKAGE_OVERLAP").alias("code"), F.col("package").alias("subject"))
    return unknown.unionByName(held.distinct())


def test_plan(tests: DataFrame) -> DataFrame:
    """(package, files, n) of the active tests (file, id, state, package), each counted once."""
    return tests.where("state = 'active'").dropDuplicates(["file", "id"]).groupBy("package").agg(F.array_sort(F.collect_set("file")).alias("files"), F.count("*").alias("n"))


def test_counts(tests: DataFrame) -> DataFrame:
    """(state, n) of tests (file, id, state), each counted once."""
    return tests.dropDuplicates(["file", "id"]).groupBy("state").agg(F.count("*").alias("n"))


def schema_rule(catalog: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, status, codes): whether all schemas (path, code) of an owner (owner, path) are without a fault."""
    met = owners.join(catalog.select(F.col("path").alias("__p"), "code"), F.col("path") == F.col("__p"), "left")
    code = F.when(F.col("__p").isNull(), "SCHEMA_MISSING").otherwise(F.col("code"))
    per = met.groupBy("owner").agg(F.array_sort(F.collect_set(code)).alias("codes"))
    return per.select("owner", F.when(F.size("codes") == 0, "pass").otherwise("fail").alias("status"), "codes")


def declaration_owner(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The owner of each declaration: exact entrypoint, least export depth, longest directory, least id."""
    order = F.struct((~F.col("exact")).alias("a"), F.col("depth").alias("b"), (-F.length("directory")).alias("c"), F.col("owner").alias("d"))
    return candidates.groupBy(*keys).agg(F.min(order).getField("d").alias("owner"))


def worst_first(results: DataFrame) -> DataFrame:
    """Results by falling gravity, then rule."""
    return results.orderBy(F.desc(rank(F.col("status"), CONFORMANCE)), "rule")
