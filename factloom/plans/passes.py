"""Passes: plan them by capabilities and namespaces, run them in order over facts, skip what is valid."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.facts import any_of
from factloom.sources.tables import Rounds


class PlanError(ValueError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Need:
    """A namespace that a pass reads, in a range of schema versions."""

    namespace: str
    least: int = 1
    most: int = 1


@dataclass(frozen=True)
class Pass:
    id: str
    run: Callable[["Scope"], DataFrame] = None
    inputs: tuple[Need, ...] = ()
    outputs: tuple[tuple[str, int], ...] = ()
    requires: tuple[str, ...] = ()
    provides: tuple[str, ...] = ()
    invalidates_on: tuple[str, ...] = ()
    optional: bool = False


@dataclass
class Scope:
    """What a pass may read: facts of the namespaces that it declares, no others."""

    facts: DataFrame
    allowed: frozenset[str]

    def read(self, *namespaces: str) -> DataFrame:
        strange = sorted(set(namespaces) - self.allowed)
        if strange or not namespaces:
            raise PlanError("NAMESPACE_UNDECLARED", ", ".join(strange) or "no namespace is named")
        return self.facts.where(any_of(F.col("namespace"), list(namespaces)))


def _providers(passes: Iterable[Pass]) -> tuple[dict[str, Pass], dict[str, Pass]]:
    capability: dict[str, Pass] = {}
    namespace: dict[str, Pass] = {}
    for p in passes:
        for table, names in ((capability, p.provides), (namespace, [n for n, _ in p.outputs])):
            for name in names:
                if table.setdefault(name, p).id != p.id:
                    raise PlanError("PROVIDER_REPEATED", f"{name} comes from {table[name].id} and {p.id}")
    return capability, namespace


def plan(passes: list[Pass], wanted: Iterable[str], capabilities: Iterable[str] = (), schemas: dict[str, int] | None = None) -> list[Pass]:
    """The passes that the wanted capabilities take, each after those that it needs."""
    have, schemas = set(capabilities), schemas or {}
    by_capability, by_namespace = _providers(passes)
    ordered: dict[str, Pass] = {}
    # depth first, with a stack of iterators instead of recursion
    for name in sorted(set(wanted)):
        if name in have:
            continue
        if name not in by_capability:
            raise PlanError("INPUT_MISSING", f"no pass provides {name}")
        stack = [(by_capability[name], _needs(by_capability[name], have, schemas, by_capability, by_namespace))]
        while stack:
            p, needs = stack[-1]
            if p.id in ordered:
                stack.pop()
                continue
            following = next(needs, None)
            if following is None:
                ordered[p.id] = p
                stack.pop()
            elif any(q.id == following.id for q, _ in stack):
                raise PlanError("PASS_CYCLE", f"{following.id} needs itself")
            elif following.id not in ordered:
                stack.append((following, _needs(following, have, schemas, by_capability, by_namespace)))
    for p in ordered.values():
        for n, _ in p.outputs:
            if n in schemas:
                raise PlanError("OUTPUT_REPLACES_BASE", f"{p.id} would replace {n}")
    return list(ordered.values())


def _needs(p: Pass, have: set[str], schemas: dict[str, int], by_capability: dict[str, Pass], by_namespace: dict[str, Pass]):
    for c in p.requires:
        if c not in have:
            if c not in by_capability:
                raise PlanError("INPUT_MISSING", f"{p.id} requires {c}")
            yield by_capability[c]
    for need in p.inputs:
        if need.least <= schemas.get(need.namespace, need.least - 1) <= need.most:
            continue
        if need.namespace not in by_namespace:
            raise PlanError("INPUT_MISSING", f"{p.id} reads {need.namespace}")
        maker = by_namespace[need.namespace]
        if not need.least <= dict(maker.outputs)[need.namespace] <= need.most:
            raise PlanError("SCHEMA_INCOMPATIBLE", f"{p.id} can't read {need.namespace} of {maker.id}")
        yield maker


def selects(selector: str, namespace: str) -> bool:
    """* is all, x.* what begins with "x.", else equality."""
    return selector == "*" or (namespace.startswith(selector[:-1]) if selector.endswith(".*") else selector == namespace)


def invalidated(ordered: list[Pass], carried: set[tuple[str, int]], changed: set[str], everything: bool = False) -> list[Pass]:
    """The passes of a plan to run again: told to, without all outputs, with a changed input, selected
    by a changed namespace, or after one that runs again."""
    out, capabilities, namespaces = [], set(), set(changed)
    for p in ordered:
        if (
            everything
            or not set(p.outputs) <= carried
            or any(n.namespace in namespaces for n in p.inputs)
            or any(selects(s, n) for s in p.invalidates_on for n in changed)
            or capabilities & set(p.requires)
        ):
            out.append(p)
            capabilities |= set(p.provides)
            namespaces |= {n for n, _ in p.outputs}
    return out


@dataclass
class Outcome:
    facts: DataFrame
    completion: dict[str, str] = field(default_factory=dict)
    reasons: dict[str, str] = field(default_factory=dict)


def run(ordered: list[Pass], base: DataFrame) -> Outcome:
    """Runs passes in order; each sees the base and what earlier ones made. A pass may make facts of
    its declared outputs only. An optional pass that fails leaves its outputs unavailable.

    Each pass's facts are written before the pass counts as complete: a fault that shows only when Spark
    runs it is then this pass's own, and later passes read a table, not its plan.
    """
    out, rounds = Outcome(base), Rounds(base.sparkSession, "passes")
    for p in ordered:
        scope = Scope(out.facts, frozenset(n.namespace for n in p.inputs))
        try:
            made = p.run(scope)
            allowed = [n for n, _ in p.outputs]
            strange = F.raise_error(F.concat(F.lit(f"{p.id} made a fact of "), F.coalesce("namespace", F.lit("null")))).cast("boolean")
            done = rounds.put(made.where(F.when(any_of(F.col("namespace"), allowed), True).otherwise(strange)))
            out.facts = out.facts.unionByName(done, allowMissingColumns=True)
            out.completion.update(dict.fromkeys(allowed, "complete"))
        except Exception as e:
            if not p.optional:
                raise
            out.completion.update(dict.fromkeys([n for n, _ in p.outputs], "unavailable"))
            out.reasons[p.id] = str(e)
    return out
