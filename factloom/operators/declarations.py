"""Declarations compared part by part: what a contract declares against what a code base shows.

Both sides are tables of parts (PARTS). Parts meet in one grouping: parameters, type parameters
and overloads by their position, members by name, heritage by the type. A part's verdict is the first
rung of its ladder that holds; every rung is a column, so all ladders are one projection. The parts of an
overload are judged with it: an overload has the first code that any of its parts has. Types are hashes
of `types.hashed`, so a type that the contract gives is compared by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: part: type-parameter, parameter, return, mode, member, callable, overload or heritage; overload: the
#: position of the overload that a part belongs to, null for the declaration itself; place: of positional
#: parts; name: of members and callables, "extends" or "implements" of heritage; type: its hash, with `bare`
#: that without `undefined`; known: false if the type has no hash that can be compared; nulls say nothing.
PARTS = (
    "declaration string, overload int, part string, place int, name string, type string, bare string, known boolean, optional boolean, rest boolean, "
    "readonly boolean, variance string, const boolean, constraint string, default_type string, mode string"
)
_COLUMNS = [c.split()[0] for c in PARTS.split(", ")]
_KEYS = ("declaration", "overload", "part", "key")

#: Codes of the ladders, for a part of the declaration and for one within an overload.
CODES = {
    "type-parameter": ("MODULE_TYPE_PARAMETER_MISSING", "MODULE_TYPE_PARAMETER_UNDECLARED"),
    "parameter": ("MODULE_PARAMETER_MISSING", "MODULE_PARAMETER_UNDECLARED"),
    "return": ("MODULE_CALL_SIGNATURE_MISSING", "MODULE_CALL_SIGNATURE_UNDECLARED"),
    "mode": ("MODULE_CALL_SIGNATURE_MISSING", "MODULE_CALL_SIGNATURE_UNDECLARED"),
    "member": ("MODULE_MEMBER_MISSING", "MODULE_MEMBER_UNDECLARED"),
    "callable": ("MODULE_CALLABLE_MEMBER_MISSING", "MODULE_MEMBER_UNDECLARED"),
    "overload": ("MODULE_OVERLOAD_MISSING", "MODULE_OVERLOAD_UNDECLARED"),
    "heritage": ("MODULE_HERITAGE_MISSING", "MODULE_HERITAGE_UNDECLARED"),
}
_SIGNATURE, _TYPE_PARAMETER, _PARAMETER, _RETURN = "MODULE_OVERLOAD_SIGNATURE_MISMATCH", "MODULE_OVERLOAD_TYPE_PARAMETER_MISMATCH", "MODULE_OVERLOAD_PARAMETER_MISMATCH", "MODULE_RETURN_TYPE_MISMATCH"
#: Codes of an overload's parts, the gravest first.
OVERLOAD_CODES = (_SIGNATURE, _TYPE_PARAMETER, _PARAMETER, "MODULE_TYPE_MISMATCH", _RETURN)


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _rungs() -> list[tuple[str, Column, str, str]]:
    """(part, condition, code, code within an overload), each part's in the order of its ladder."""
    e, o = lambda c: F.col(f"e.{c}"), lambda c: F.col(f"o.{c}")
    differ = lambda c: ~_flag(e(c)).eqNullSafe(_flag(o(c)))
    # an optional part's own type is that without `undefined`
    seen = F.when(_flag(o("optional")), F.coalesce(o("bare"), o("type"))).otherwise(o("type"))
    other = e("type").isNotNull() & ~e("type").eqNullSafe(seen)
    one_sided = lambda c: e(c).isNotNull() != o(c).isNotNull()
    bound = lambda c: e(c).isNotNull() & o(c).isNotNull() & (e(c) != o(c))
    named = "MODULE_TYPE_PARAMETER_"
    return [
        ("type-parameter", ~e("variance").eqNullSafe(o("variance")), named + "VARIANCE_MISMATCH", _TYPE_PARAMETER),
        ("type-parameter", differ("const"), named + "CONST_MISMATCH", _TYPE_PARAMETER),
        ("type-parameter", one_sided("constraint"), named + "CONSTRAINT_MISMATCH", _TYPE_PARAMETER),
        ("type-parameter", bound("constraint"), named + "CONSTRAINT_MISMATCH", "MODULE_TYPE_MISMATCH"),
        ("type-parameter", one_sided("default_type"), named + "DEFAULT_MISMATCH", _TYPE_PARAMETER),
        ("type-parameter", bound("default_type"), named + "DEFAULT_MISMATCH", "MODULE_TYPE_MISMATCH"),
        ("parameter", differ("optional"), "MODULE_PARAMETER_OPTIONALITY_MISMATCH", _PARAMETER),
        ("parameter", differ("rest"), "MODULE_PARAMETER_REST_MISMATCH", _PARAMETER),
        ("parameter", other, "MODULE_TYPE_MISMATCH", "MODULE_TYPE_MISMATCH"),
        ("return", other, _RETURN, _RETURN),
        ("mode", ~e("mode").eqNullSafe(o("mode")), "MODULE_CALLABLE_MODE_MISMATCH", _SIGNATURE),
        ("member", differ("optional"), "MODULE_OPTIONALITY_MISMATCH", _PARAMETER),
        ("member", e("readonly").isNotNull() & differ("readonly"), "MODULE_READONLY_MISMATCH", _PARAMETER),
        ("member", other, "MODULE_TYPE_MISMATCH", "MODULE_TYPE_MISMATCH"),
        ("callable", differ("optional"), "MODULE_CALLABLE_OPTIONALITY_MISMATCH", _PARAMETER),
    ]


def _keyed(parts: DataFrame) -> DataFrame:
    key = F.when(F.col("part").isin("member", "callable"), F.col("name")).when(F.col("part") == "heritage", F.concat_ws(":", "name", "type")).when(F.col("part").isin("return", "mode"), F.lit("")).otherwise(F.col("place").cast("string"))
    rest = [c for c in _COLUMNS if c not in _KEYS]
    return parts.select(*_COLUMNS).withColumn("key", key).select(*_KEYS, F.struct(*rest, F.lit(True).alias("there")).alias("x"))


def compared(expected: DataFrame, observed: DataFrame, partitions: int | None = None) -> DataFrame:
    """(declaration, id, status, code) of two tables of PARTS: one row for each part of either side and each
    overload. Ids of parts that only the code base has begin with "observed."; status is pass, fail, or
    indeterminate where a type can't be compared. Of a part that one side repeats the least row counts.

    Where a contract declares no overloads, those of the code base beyond the first are undeclared, and the
    first one's parts are compared as the declaration's own: give them with a null overload.

    Both sides are dealt once, into `partitions` (the session's number if None); large tables need more.
    """
    one_side = lambda parts, seen: _keyed(parts).withColumn("seen", F.lit(seen))
    both = one_side(expected, False).unionByName(one_side(observed, True))
    if partitions is not None:
        both = both.repartition(partitions, *_KEYS)
    least = lambda seen, side: F.min(F.when(F.col("seen") == seen, F.col("x"))).alias(side)
    met = both.groupBy(*_KEYS).agg(least(False, "e"), least(True, "o"))
    one = F.col
    within = one("overload").isNotNull() & (one("part") != "overload")
    e_there, o_there, part = F.col("e.there").isNotNull(), F.col("o.there").isNotNull(), one("part")
    code: Column = F.lit(None).cast("string")
    for p, holds, plain, inner in reversed(_rungs()):
        code = F.when((part == p) & holds, F.when(within, inner).otherwise(plain)).otherwise(code)
    for p, (missing, undeclared) in CODES.items():
        code = F.when((part == p) & ~e_there, F.when(within, _SIGNATURE).otherwise(undeclared)).when((part == p) & ~o_there, F.when(within, _SIGNATURE).otherwise(missing)).otherwise(code)
    # a type can't be compared only where the ladder comes to comparing it
    typed = F.col("e.type").isNotNull() & e_there & o_there & part.isin("parameter", "return", "member")
    unknown = typed & ~(F.coalesce(F.col("e.known"), F.lit(True)) & F.coalesce(F.col("o.known"), F.lit(True))) & (code.isNull() | code.isin("MODULE_TYPE_MISMATCH", _RETURN))
    rows = met.select(
        one("declaration").alias("declaration"), one("overload").alias("overload"), part.alias("part"), one("key").alias("key"), within.alias("within"), e_there.alias("e_there"), o_there.alias("o_there"),
        F.when(~unknown, code).alias("code"), unknown.alias("unknown"),
    )
    id_ = F.concat(F.when(F.col("e_there"), "").otherwise("observed."), F.col("part"), F.when(F.col("key") == "", "").otherwise(F.concat(F.lit("."), "key")))
    status = F.when(F.col("unknown"), "indeterminate").when(F.col("code").isNull(), "pass").otherwise("fail")
    own = rows.where("NOT within AND part <> 'overload'").select("declaration", id_.alias("id"), status.alias("status"), "code")
    return own.unionByName(_overloads(rows))


def _overloads(rows: DataFrame) -> DataFrame:
    """An overload that both sides have is judged by its parts; one that is missing or undeclared, alone."""
    rank = F.lit(len(OVERLOAD_CODES))
    for k, c in reversed(list(enumerate(OVERLOAD_CODES))):
        rank = F.when(F.col("code") == c, k).otherwise(rank)
    head = (F.col("part") == "overload") & ~F.col("within")
    per = rows.where((F.col("part") == "overload") | F.col("within")).groupBy("declaration", "overload").agg(
        F.max(F.when(head, F.col("e_there"))).alias("e_there"), F.max(F.when(head, F.col("o_there"))).alias("o_there"), F.max(F.when(head, F.col("code"))).alias("alone"),
        F.min(F.when(F.col("within"), rank)).alias("rank"), F.max(F.when(F.col("within"), F.col("unknown"))).alias("unknown"),
    ).where("e_there IS NOT NULL")
    of_parts = F.get(F.array(*[F.lit(c) for c in OVERLOAD_CODES]), F.col("rank").cast("int"))
    both = F.col("e_there") & F.col("o_there")
    code = F.when(both, of_parts).otherwise(F.col("alone"))
    id_ = F.concat(F.when(F.col("e_there"), "").otherwise("observed."), F.lit("overload."), F.col("overload").cast("string"))
    met = per.select("declaration", id_.alias("id"), code.alias("code"), (both & F.coalesce("unknown", F.lit(False))).alias("unknown"))
    status = F.when(F.col("code").isNotNull(), "fail").when(F.col("unknown"), "indeterminate").otherwise("pass")
    return met.select("declaration", "id", status.alias("status"), "code")
