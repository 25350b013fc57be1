"""Queries over fact tables: the six-way filter, headers, lookups and keyset pages."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.identity import canonical_json, decode_cursor, encode_cursor

#: Columns of a fact table. `facts` carries no generation: a shard's facts are the same in each that has it.
SCHEMA = """
shard_digest string, fact_id string, namespace string, schema_version int, kind string, subject string,
completeness struct<kind:string, reasons:array<struct<code:string, message:string>>>,
pass_id string, pass_version string,
evidence array<struct<source:string, revision:string, start:bigint, `end`:bigint>>, inputs array<string>, payload string
"""

MAX_PAGE, DEFAULT_PAGE = 10_000, 100


@dataclass(frozen=True)
class FactFilter:
    """A conjunction of IN-lists: None is no constraint, an empty list matches nothing."""

    namespaces: tuple[str, ...] | None = None
    kinds: tuple[str, ...] | None = None
    subjects: tuple[str, ...] | None = None
    sources: tuple[str, ...] | None = None
    symbols: tuple[str, ...] | None = None
    completeness: tuple[str, ...] | None = None

    def digest(self) -> str:
        plain = {k: sorted(set(v)) for k, v in asdict(self).items() if v is not None}
        return hashlib.sha256(canonical_json(plain).encode()).hexdigest()


def any_of(column: Column, values: tuple | list | None) -> Column:
    if values is None:
        return F.lit(True)
    return column.isin(*values) if values else F.lit(False)


def condition(f: FactFilter) -> Column:
    """The filter as one predicate; symbols test the subject too, so both lists must hold."""
    keep = any_of(F.col("namespace"), f.namespaces) & any_of(F.col("kind"), f.kinds) & any_of(F.col("subject"), f.subjects)
    keep = keep & any_of(F.col("completeness.kind"), f.completeness) & any_of(F.col("subject"), f.symbols)
    if f.sources is not None:
        keep = keep & (F.exists("evidence", lambda e: e["source"].isin(*f.sources)) if f.sources else F.lit(False))
    return keep


def select(facts: DataFrame, f: FactFilter) -> DataFrame:
    return facts.where(condition(f))


def headers(facts: DataFrame) -> DataFrame:
    """Facts without their payload, which a columnar scan then doesn't read."""
    return facts.drop("payload")


def with_evidence(facts: DataFrame, evidence: DataFrame, fact_key: str, evidence_key: str) -> DataFrame:
    """Facts that have evidence in a table of its own (a semi-join)."""
    wanted = evidence.select(F.col(evidence_key).alias("__key")).distinct()
    return facts.join(wanted, F.col(fact_key) == F.col("__key"), "left_semi")


def by_id(facts: DataFrame, ids: list | DataFrame, key: str = "fact_id") -> DataFrame:
    """Facts by id, in order of id; ids that repeat count once, unknown ones are left out."""
    if not isinstance(ids, DataFrame):
        return facts.where(F.col(key).isin(*sorted(set(ids))) if ids else F.lit(False)).orderBy(key)
    wanted = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    return facts.join(wanted, F.col(key) == F.col("__id"), "left_semi").orderBy(key)


def check_limit(limit: int | None) -> int:
    limit = DEFAULT_PAGE if limit is None else limit
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"a page holds 1 to {MAX_PAGE} facts, not {limit!r}")
    return limit


def after(facts: DataFrame, last: object | None, limit: int, key: str = "fact_id") -> DataFrame:
    """Up to `limit` facts after key `last`: a filter that a sorted table prunes by, then a top-k."""
    rows = facts if last is None else facts.where(F.col(key) > F.lit(last))
    return rows.orderBy(key).limit(limit)


@dataclass(frozen=True)
class Page:
    rows: list
    cursor: str | None
    total: int | None


def page(facts: DataFrame, f: FactFilter, generation: str, limit: int | None = None, cursor: str | None = None, total: bool = False, key: str = "fact_id") -> Page:
    """One page, in order of key, and the cursor of the next. The cursor is good for the same
    generation and filter only; the number of all matches is counted only if asked for."""
    limit, last = check_limit(limit), None
    if cursor is not None:
        at = decode_cursor(cursor)
        if at.get("generation") != generation or at.get("filter") != f.digest() or "last" not in at:
            raise ValueError("the cursor is invalid or stale")
        last = at["last"]
    found = select(facts, f)
    rows = after(found, last, limit + 1, key).collect()  # at most MAX_PAGE + 1 rows
    more = len(rows) > limit
    rows = rows[:limit]
    following = encode_cursor(generation=generation, filter=f.digest(), last=rows[-1][key]) if more else None
    return Page(rows, following, found.count() if total else None)


def export(facts: DataFrame, f: FactFilter, key: str = "fact_id") -> DataFrame:
    """All matches in order of key: what its pages make one after the other."""
    return select(facts, f).orderBy(key)


def merged(base: DataFrame, staged: DataFrame, key: str = "fact_id") -> DataFrame:
    """Both tables' facts; fails, when it runs, on an id that both have."""
    taken = base.select(F.col(key).alias("__base")).distinct()
    clash = F.raise_error(F.concat(F.lit("a staged fact has the id of a base fact: "), F.col(key).cast("string"))).cast("boolean")
    new = staged.join(taken, F.col(key) == F.col("__base"), "left").where(F.when(F.col("__base").isNull(), True).otherwise(clash)).drop("__base")
    return base.unionByName(new, allowMissingColumns=True)


def nested_evidence(facts: DataFrame, evidence: DataFrame, key: str, ordinal: str, columns: list[str]) -> DataFrame:
    """Facts with their evidence as an array in order of its ordinal."""
    each = evidence.select(F.col(key).alias("__k"), F.struct(ordinal, *columns).alias("e"))
    arrays = each.groupBy("__k").agg(F.array_sort(F.collect_list("e")).alias("evidence"))
    return facts.join(arrays, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("evidence", F.coalesce("evidence", F.array().cast(arrays.schema["evidence"].dataType)))


def duplicates(rows: DataFrame, content: list[str], order: str) -> DataFrame:
    """(order, first): each row whose content was declared before, and who declared it first."""
    first = rows.groupBy(*content).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    renamed = first.select(*[F.col(c).alias(f"__{c}") for c in content], "first")
    same = F.lit(True)
    for c in content:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(renamed, same).where(F.col(order) != F.col("first")).select(order, "first")


class Contract:
    """What facts of one namespace have to be: a schema version and a payload of a given shape. Fields
    of the shape that are `required` may not be null."""

    def __init__(self, namespace: str, payload: str, version: int = 1, required: tuple[str, ...] = ()) -> None:
        self.namespace, self.payload, self.version, self.required = namespace, payload, version, required

    def faults(self) -> Column:
        """An array of what is wrong with a fact: namespace, schema-version, payload, and null fields."""
        parsed = F.from_json("payload", self.payload, {"mode": "PERMISSIVE"})
        readable = F.try_parse_json("payload")
        wrong = [
            F.when(~F.col("namespace").eqNullSafe(F.lit(self.namespace)), F.concat(F.lit("namespace:"), F.coalesce("namespace", F.lit("")))),
            F.when(~F.col("schema_version").eqNullSafe(F.lit(self.version)), F.concat(F.lit("schema-version:"), F.coalesce(F.col("schema_version").cast("string"), F.lit("")))),
            F.when(readable.isNull() | ~F.coalesce(F.schema_of_variant(readable).startswith("OBJECT"), F.lit(False)), "payload"),
            *[F.when(readable.isNotNull() & parsed.getField(f).isNull(), F.lit(f"field:{f}")) for f in self.required],
        ]
        return F.array_compact(F.array(*wrong))


def violations(facts: DataFrame, contract: Contract) -> DataFrame:
    """(fact_id, faults) of facts that break the contract."""
    return facts.select("fact_id", contract.faults().alias("faults")).where(F.size("faults") > 0)


def typed(facts: DataFrame, contract: Contract, f: FactFilter = FactFilter()) -> DataFrame:
    """Facts of the contract's namespace that pass the filter, with the payload as a struct; fails, when
    it runs, on a fact that breaks the contract."""
    own = select(facts.where(F.col("namespace") == contract.namespace), f)
    text = F.concat(F.lit("fact "), F.col("fact_id").cast("string"), F.lit(" breaks its contract: "), F.array_join("__faults", ", "))
    sound = F.when(F.size("__faults") == 0, True).otherwise(F.raise_error(text).cast("boolean"))
    return own.withColumn("__faults", contract.faults()).where(sound).drop("__faults").withColumn("payload", F.from_json("payload", contract.payload))


def one_each(facts: DataFrame, keys: tuple[str, ...] = ("namespace", "subject")) -> DataFrame:
    """Facts, of any number of universes, that are the only one of their keys; fails, when it runs, on
    keys that several have."""
    several = facts.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*[F.col(k).alias(f"__{k}") for k in keys], "__n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    text = F.concat(F.lit("expected one fact of "), F.concat_ws(" ", *keys), F.lit(", found "), F.col("__n").cast("string"))
    return facts.join(several, same, "left").where(F.when(F.col("__n").isNull(), True).otherwise(F.raise_error(text).cast("boolean"))).drop("__n", *[f"__{k}" for k in keys])


def repeated(facts: DataFrame, keys: tuple[str, ...] = ("namespace", "subject")) -> DataFrame:
    """(keys, n): keys that several facts have."""
    return facts.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def corpus_summary(facts: DataFrame) -> DataFrame:
    """(dimension, key, facts, bytes): number of facts and bytes of payload of the whole corpus, by
    namespace, by kind and by completeness, in one shuffle."""
    size = F.coalesce(F.octet_length(F.col("payload").cast("string")), F.lit(0)).cast("long")
    axes = {"all": F.lit("all"), "namespace": F.col("namespace"), "kind": F.col("kind"), "completeness": F.col("completeness.kind")}
    each = facts.select(size.alias("b"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), c.alias("key")) for d, c in axes.items()])).alias("d"))
    return each.groupBy("d.dimension", "d.key").agg(F.count("*").alias("facts"), F.sum("b").alias("bytes"))


def largest_facts(facts: DataFrame, limit: int = 20) -> DataFrame:
    """The facts with the most bytes of payload, then the least id."""
    size = F.coalesce(F.octet_length(F.col("payload").cast("string")), F.lit(0)).cast("long")
    return facts.select("fact_id", "namespace", "kind", size.alias("bytes")).orderBy(F.desc("bytes"), "fact_id").limit(limit)
