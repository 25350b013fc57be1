"""Policies: rules over facts, with the capabilities that they need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.completeness import CONFORMANCE, LEVELS, POLICY, named, rank
from factloom.plans.passes import PlanError


@dataclass(frozen=True)
class Policy:
    """`evaluate` gets the facts and returns (rule, status) for the declared rules; capabilities that
    only some rules need are `scoped` and may not be required for all as well."""

    id: str
    rules: tuple[str, ...]
    evaluate: Callable[[DataFrame], DataFrame]
    required: tuple[str, ...] = ()
    scoped: dict[str, tuple[str, ...]] | None = None


def gate(levels: dict[str, str], names: tuple[str, ...], minimum: str = "complete") -> list[str]:
    """The capabilities that are below the minimum."""
    return sorted(n for n in names if LEVELS.index(levels.get(n, "unavailable")) > LEVELS.index(minimum))


def run(policy: Policy, facts: DataFrame, levels: dict[str, str]) -> list[tuple[str, str]]:
    """(rule, status) for each declared rule: all indeterminate without a required capability, one
    without a scoped capability; a policy must return just the rules that it declares."""
    both = set(policy.required) & {c for cs in (policy.scoped or {}).values() for c in cs}
    if both:
        raise PlanError("CAPABILITY_BOTH", ", ".join(sorted(both)))
    if gate(levels, policy.required):
        return [(r, "indeterminate") for r in policy.rules]
    got: dict[str, list[str]] = {}
    for rule, status in policy.evaluate(facts).select("rule", "status").distinct().collect():  # rules are few
        got.setdefault(rule, []).append(status)
    if set(got) != set(policy.rules):
        raise PlanError("RULES_DIFFER", ", ".join(sorted(set(got) ^ set(policy.rules))))
    closed = {r for r, cs in (policy.scoped or {}).items() if gate(levels, cs)}
    return [(r, "indeterminate" if r in closed else max(got[r], key=POLICY.index)) for r in policy.rules]


def order(profiles: dict[str, tuple[str, ...]]) -> list[str]:
    """Profiles (name -> those that it builds on), each after what it builds on."""
    out: list[str] = []
    ready = {p: set(n) for p, n in profiles.items()}
    unknown = sorted({d for n in ready.values() for d in n} - set(ready))
    if unknown:
        raise PlanError("PROFILE_UNKNOWN", ", ".join(unknown))
    while ready:
        free = sorted(p for p, n in ready.items() if not n)
        if not free:
            raise PlanError("PROFILE_CYCLE", ", ".join(sorted(ready)))
        out += free
        ready = {p: n - set(free) for p, n in ready.items() if n}
    return out


#: The built-in profiles, each with those that it builds on.
PROFILES = {
    "specification": (), "structure": ("specification",), "surface": ("structure",), "dependencies": ("structure",),
    "layout": ("specification",), "schema": ("specification",), "test-evidence": ("specification",),
}


def profile_of(rule: Column) -> Column:
    """The profile that a rule of a module's conformance belongs to, by its id."""
    return (
        F.when(rule.rlike(r"^module\.[^.]+$"), "structure")
        .when(rule.rlike(r"^(module\.(package|import)|observed\.(dependency|import))\."), "dependencies")
        .when(rule.rlike(r"^(module|observed)\."), "surface")
        .otherwise(F.substring_index(rule, ".", 1))
    )


def qualify(results: DataFrame, profiles: dict[str, tuple[str, ...]] = PROFILES, key: str = "spec") -> DataFrame:
    """(key, profile, status, blocked) of rule results (key, profile, status): a profile takes its rules'
    status, error before fail before indeterminate; one that builds on a profile that didn't pass is
    blocked and indeterminate. A profile without a rule is indeterminate.

    One aggregation, a column for each profile; the order among profiles is in the expressions.
    """
    place = rank(F.col("status"), CONFORMANCE)
    own = results.groupBy(key).agg(*[F.max(F.when(F.col("profile") == p, place)).alias(f"__{i}") for i, p in enumerate(profiles)])
    index, final = {p: i for i, p in enumerate(profiles)}, {}
    for p in order(profiles):
        blocked = F.lit(False)
        for d in profiles[p]:
            blocked = blocked | (final[d][0] != "pass")
        final[p] = F.when(blocked, "indeterminate").otherwise(F.coalesce(named(F.col(f"__{index[p]}"), CONFORMANCE), F.lit("indeterminate"))), blocked
    rows = F.array(*[F.struct(F.lit(p).alias("profile"), final[p][0].alias("status"), final[p][1].alias("blocked")) for p in profiles])
    return own.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def fold(results: DataFrame, keys: list[str]) -> DataFrame:
    from factloom.operators.completeness import status

    return results.groupBy(*keys).agg(status(F.col("status"), POLICY).alias("status"))
