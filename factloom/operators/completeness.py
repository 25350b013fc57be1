"""Completeness and status folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From best to worst.
LEVELS = ["complete", "partial", "unavailable"]
#: Status rankings, from the weakest to the one that wins.
POLICY = ["pass", "fail", "indeterminate", "error"]
CONFORMANCE = ["pass", "indeterminate", "fail", "error"]
#: Obligations: the first that any row has wins; idle counts as indeterminate.
OBLIGATION = ["error", "fail", "idle", "pass"]


def rank(value: Column, names: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), value)


def named(place: Column, names: list[str]) -> Column:
    """The name at a place, counted from 1; null for none, which element_at of a constant array isn't told from -1."""
    return F.when(place.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in names]), place.cast("int")))


def worst(level: Column, reasons: Column, dedupe: bool = True) -> tuple[Column, Column]:
    """Aggregates (level, reasons): the worst level and the reasons given at that level only.

    With `dedupe` the reasons are distinct and sorted, else as they come.
    """
    place = rank(level, LEVELS)
    top = F.max(place)
    # reasons by level: a map-side aggregate per level, so no join back is needed
    at = [F.flatten(F.collect_set(F.when(place == i + 1, reasons)) if dedupe else F.collect_list(F.when(place == i + 1, reasons))) for i in range(len(LEVELS))]
    chosen = F.when(top == 3, at[2]).when(top == 2, at[1]).otherwise(F.slice(at[0], 1, 0))
    return F.coalesce(named(top, LEVELS), F.lit("complete")), F.array_sort(F.array_distinct(chosen)) if dedupe else chosen


def fold(rows: DataFrame, keys: list[str], level: str = "level", reasons: str = "reasons", dedupe: bool = True) -> DataFrame:
    a, b = worst(F.col(level), F.col(reasons), dedupe)
    return rows.groupBy(*keys).agg(a.alias("level"), b.alias("reasons"))


def capability_rollup(seeds: DataFrame, shards: DataFrame, facts: DataFrame) -> DataFrame:
    """(capability, level, reasons) of a generation.

    seeds: (capability), complete to begin with; shards: (namespace, capabilities, level, reasons),
    which count for their namespace and each capability; facts: (namespace, level, reasons), which
    count for their namespace and the capabilities of the shards of it.
    """
    none = F.array().cast("array<string>")
    start = seeds.select("capability", F.lit("complete").alias("level"), none.alias("reasons"))
    own = shards.select(F.explode(F.array_union(F.array("namespace"), F.coalesce("capabilities", none))).alias("capability"), "level", "reasons")
    reach = shards.select(F.col("namespace").alias("__ns"), F.explode(F.array_union(F.array("namespace"), F.coalesce("capabilities", none))).alias("capability")).distinct()
    # facts are folded by namespace before they meet their capabilities
    folded = fold(facts, ["namespace"])
    theirs = folded.join(reach, F.col("namespace") == F.col("__ns")).select("capability", "level", "reasons")
    return fold(start.unionByName(own).unionByName(theirs), ["capability"])


def status(value: Column, ranking: list[str]) -> Column:
    """Aggregate: the status that wins under `ranking`."""
    return named(F.max(rank(value, ranking)), ranking)


def obligation(value: Column) -> Column:
    won = named(F.min(rank(value, OBLIGATION)), OBLIGATION)
    return F.when(won == "idle", "indeterminate").otherwise(won)


def evidence_gate(requirements: DataFrame, rollup: DataFrame) -> DataFrame:
    """(rule, capability, admitted, level) of requirements (rule, capability, minimum, accepted): complete
    evidence is always enough; partial evidence where the minimum is partial, and, if accepted reasons are
    given, where it has no others; else the rule stays open. A capability that the roll-up lacks is unavailable."""
    at = rollup.select(F.col("capability").alias("__c"), "level", "reasons")
    met = requirements.join(at, F.col("capability").eqNullSafe(F.col("__c")), "left")
    level, none = F.coalesce("level", F.lit("unavailable")), F.array().cast("array<string>")
    known = F.col("accepted").isNull() | (F.size(F.array_except(F.coalesce("reasons", none), F.coalesce("accepted", none))) == 0)
    return met.select("rule", "capability", ((level == "complete") | ((level == "partial") & (F.col("minimum") == "partial") & known)).alias("admitted"), level.alias("level"))


def scoped_evidence(requirements: DataFrame, rollup: DataFrame, facts: DataFrame) -> DataFrame:
    """(rule, capability, subject, level, reasons) of requirements (rule, capability, subject): the evidence
    of a subject's own facts of the capability's namespace where it has any, else that of the universe."""
    own = fold(facts, ["namespace", "subject"], dedupe=False).select(F.col("namespace").alias("__n"), F.col("subject").alias("__s"), F.col("level").alias("__level"), F.col("reasons").alias("__reasons"))
    wide = rollup.select(F.col("capability").alias("__c"), F.col("level").alias("__wide"), F.col("reasons").alias("__why"))
    met = requirements.join(own, (F.col("capability") == F.col("__n")) & (F.col("subject") == F.col("__s")), "left").join(wide, F.col("capability") == F.col("__c"), "left")
    level = F.coalesce("__level", "__wide", F.lit("unavailable"))
    return met.select("rule", "capability", "subject", level.alias("level"), F.when(F.col("__level").isNotNull(), F.col("__reasons")).otherwise(F.coalesce("__why", F.array().cast("array<string>"))).alias("reasons"))


def merge_reasons(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, reasons) of rows (keys, level, reasons: array of struct(code, message)): the worst
    level with its reasons, each code and message once, in their order."""
    return fold(rows, keys)
