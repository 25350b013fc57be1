"""Fact families in columns of their own, read as far as a request's capabilities ask.

Facts are written by family, each family's own fields in a struct of its name. A request names capabilities;
the families that give them are a filter on the partitions and their structs the columns that are read, so
what isn't asked for is neither listed nor scanned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that every family has.
COMMON = "fact_id string, kind string, subject string"
FAMILIES = ("project", "diagnostics", "modules", "sources", "symbols", "occurrences", "bodies")
#: Families that come from a source file each.
SOURCE_OWNED = ("sources", "symbols", "occurrences", "bodies")


class UnknownCapability(ValueError):
    """A request for what no family gives."""


def plan(capabilities: list[str], provided: dict[str, str]) -> list[str]:
    """The families that a request needs, in FAMILIES' order; `provided`: capability -> its family."""
    missing = sorted(set(capabilities) - set(provided))
    if missing:
        raise UnknownCapability(", ".join(missing))
    wanted = {provided[c] for c in capabilities}
    return [f for f in FAMILIES if f in wanted]


def write(tables: dict[str, DataFrame], path: str) -> str:
    """Writes families (COMMON columns and their own) below `path`; returns the schema that reads them."""
    own = {f: [c for c in t.columns if c not in ("fact_id", "kind", "subject")] for f, t in tables.items()}
    shapes = {f: F.struct(*own[f]) for f in tables if own[f]}
    kinds = {f: tables[f].select(shapes[f].alias("x")).schema["x"].dataType.simpleString() for f in shapes}

    def row(f: str) -> DataFrame:
        rest = [(shapes[f] if g == f else F.lit(None)).cast(kinds[g]).alias(g) for g in sorted(kinds)]
        return tables[f].select("fact_id", "kind", "subject", *rest, F.lit(f).alias("family"))

    reduce(DataFrame.unionByName, [row(f) for f in FAMILIES if f in tables]).write.partitionBy("family").parquet(path)
    return ", ".join([COMMON, *[f"`{g}` {kinds[g]}" for g in sorted(kinds)], "family string"])


def read(spark: SparkSession, path: str, schema: str, families: list[str], where: Column | None = None) -> DataFrame:
    """(COMMON, family, and the structs of `families`) of the families' facts alone."""
    whole = spark.read.schema(schema).parquet(path)
    some = whole.where(F.col("family").isin(families))
    some = some if where is None else some.where(where)
    return some.select("fact_id", "kind", "subject", "family", *[f for f in families if f in whole.columns])
