"""Registered queries of conformance between trees and sets: types, declarations, assignments, control flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import assignment, declarations, flow, types
from factloom.registry import _t, query
from factloom.sources.tables import partitions_for


def _node(node: Column, parent: Column | None, place: int, kind: str | Column, value: Column | None = None, binder: Column | None = None, scope: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    over = F.lit(None) if parent is None else parent
    said = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(node.cast("long").alias("node"), over.cast("long").alias("parent"), F.lit(place).alias("place"), said.alias("kind"), text(value).alias("value"), text(binder).alias("binder"), text(scope).alias("scope"))


def _line_types(lines: DataFrame, side: str, tree: Column | None = None) -> DataFrame:
    """An order's type is the union of its lines' functions. The observed side names its binders otherwise,
    has no nested union, and differs where the order or the line says so. Lines stay as they are dealt, so
    `tree` names the column of the order's key as text if they are dealt by that."""
    order, n = F.col("l_orderkey"), F.col("l_linenumber")
    # a node's id: order, the line's place in it (lines may share a number, never a place), and what it is
    at = lambda k: (order * 65_536 + F.col("place")) * 8 + k
    root, nested = order * 524_288, order * 524_288 + 1
    seen = side == "observed"
    outer = F.concat(F.lit("X" if seen else "A"), n.cast("string"))
    # a captured name: the inner binder of some orders has the name of the outer one
    inner = F.when(order % 7 == 0, outer).otherwise("B") if seen else F.lit("B")
    meant = F.when(n % 2 == 0, outer).otherwise(inner)
    parent = root if seen else F.when(n % 2 == 1, nested).otherwise(root)
    price = F.col("l_quantity").cast("long") + (F.when((order % 5 == 0) & (n == 1), 1000).otherwise(0) if seen else 0)
    each = [
        _node(at(0), parent, 0, "function", F.col("l_returnflag"), outer), _node(at(1), at(0), 0, "parameter", F.lit(0), scope=F.when(F.col("l_partkey") % 2 == 0, outer).otherwise(F.col("l_linestatus"))),
        _node(at(2), at(0), 1, "function", F.lit("inner"), inner), _node(at(3), at(2), 0, "parameter", F.lit(0), scope=meant), _node(at(4), at(0), 2, "literal", price),
    ]
    # an order's own nodes come with its first line
    first = F.col("place") == 1
    odd = F.when(order % 11 == 0, "unsupported").otherwise("union") if seen else F.lit("union")
    each.append(F.when(first, _node(root, None, 0, odd)))
    if not seen:
        each.append(F.when(first, _node(nested, root, 1, "union")))
    return lines.select((order.cast("string") if tree is None else tree).alias("tree"), F.explode(F.array(*each)).alias("x")).where("x IS NOT NULL").select("tree", "x.*")


@query("""
WITH l AS (
  SELECT l_orderkey AS o, l_linenumber AS n, l_returnflag || ':' || CASE WHEN l_partkey % 2 = 0 THEN 'own' ELSE l_linestatus END || ':' AS m, l_quantity::BIGINT AS q, l_linenumber % 2 = 0 AS outward FROM lineitem),
t AS (
  SELECT o, list_sort(list(DISTINCT m || CASE WHEN outward THEN '2:' ELSE '1:' END || q)) AS e,
    list_sort(list(DISTINCT m || CASE WHEN outward AND o % 7 <> 0 THEN '2:' ELSE '1:' END || (q + CASE WHEN o % 5 = 0 AND n = 1 THEN 1000 ELSE 0 END))) AS s FROM l GROUP BY o)
SELECT o::VARCHAR AS tree, CASE WHEN o % 11 = 0 THEN 'indeterminate' WHEN e = s THEN 'pass' ELSE 'fail' END AS status FROM t
""")
def type_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as types: unions of generic functions, with captured names, repeated members and other literals."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("tree"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    pairs = lines.select(F.col("tree").alias("expected")).distinct().withColumn("observed", F.col("expected"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    dealt = lines.repartition(partitions_for(spark, lines.count(), 200_000), "tree").withColumn("place", place)
    sides = [types.hashed(_line_types(dealt, s, F.col("tree"))) for s in ("expected", "observed")]
    return types.verdicts(pairs, *sides).select(F.col("expected").alias("tree"), "status")


@query("""
WITH RECURSIVE l AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
e AS MATERIALIZED (
  SELECT a.g, a.k AS i, b.k AS j, 'x' || (a.p % 3) AS u, 'y' || (b.s % 3) AS v FROM l a JOIN l b ON a.g = b.g WHERE (a.p + b.p) % 3 <> 0 AND (a.s + b.s) % 2 = 0),
g AS (SELECT g, max(n) AS n FROM l GROUP BY g),
w(g, i, used, us, vs) AS (
  SELECT g, 0::BIGINT, []::BIGINT[], []::VARCHAR[], []::VARCHAR[] FROM g
  UNION ALL SELECT w.g, e.i, list_append(used, e.j), list_append(us, u), list_append(vs, v) FROM w JOIN e ON e.g = w.g AND e.i = w.i + 1
  WHERE NOT list_contains(used, e.j) AND (NOT list_contains(us, u) OR vs[list_position(us, u)] = v) AND (NOT list_contains(vs, v) OR us[list_position(vs, v)] = u)),
ok AS (SELECT DISTINCT w.g FROM w JOIN g ON g.g = w.g AND w.i = g.n)
SELECT g.g::VARCHAR AS "group", CASE WHEN g.g IN (SELECT g FROM ok) THEN 'pass' ELSE 'fail' END AS status FROM g
""")
def set_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines paired off with themselves where they fit, names bound one to one. Whether two lines fit, and
    the names, follow from their part modulo 3 and their supplier modulo 6, so lines that share these are one id with a count."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("group"), (F.col("l_partkey") % 3).alias("p"), (F.col("l_suppkey") % 6).alias("s"))
    alike = lines.repartition(partitions_for(spark, lines.count(), 400_000), "group").groupBy("group", "p", "s").agg(F.count("*").alias("n"))
    each = alike.groupBy("group").agg(F.sum("n").alias("n"), F.collect_list(F.struct("p", "s", "n")).alias("all"))
    both = each.select("group", "all", F.explode("all").alias("l")).select("group", "l", F.explode("all").alias("r"))
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))  # noqa: E731, E741
    id_ = lambda x: F.concat(x("p"), F.lit(":"), x("s"))
    name = lambda a, c: F.concat(F.lit(a), (c % 3).cast("string"))
    fit = both.where(((l("p") + r("p")) % 3 != 0) & ((l("s") + r("s")) % 2 == 0))
    edges = fit.select("group", id_(l).alias("left"), id_(r).alias("right"), F.array(F.struct(name("x", l("p")).alias("left"), name("y", r("s")).alias("right"))).alias("bindings"), l("n").alias("left_members"), r("n").alias("right_members"))
    return assignment.assigned(each.select("group", F.col("n").alias("lefts"), F.col("n").alias("rights")), edges).select("group", "status")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each number of an order: the least of those that share it."""
    least = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x")
    lines = _t(spark, sf_dir, "lineitem")
    lines = lines.repartition(partitions_for(spark, lines.count(), 200_000), "l_orderkey", "l_linenumber")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(least).select("l_orderkey", "l_linenumber", "x.*")


def _order_parts(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Orders as declarations: each line is a part whose kind follows from its number. The observed side lacks
    some parts, has others of its own, and says some things otherwise."""
    l, seen = _lines(spark, sf_dir), side == "observed"
    n, q, p, s = F.col("l_linenumber"), F.col("l_quantity").cast("long"), F.col("l_partkey"), F.col("l_suppkey")
    kinds = F.array(*[F.lit(k) for k in ("parameter", "member", "type-parameter", "heritage", "return", "overload", "callable")])
    part = F.get(kinds, (n - 1).cast("int"))
    shift = lambda every: F.when(p % every == 0, 1).otherwise(0) if seen else F.lit(0)
    flag = lambda c, every: ((c + shift(every)) % 2) == 1
    type_ = F.concat(F.lit("t"), (q % 10 + shift(13) * 100).cast("string"))
    rows = l.where(p % (17 if seen else 19) != 0)
    return rows.select(
        F.col("l_orderkey").cast("string").alias("declaration"), F.when(part == "overload", 0).alias("overload"), part.alias("part"), n.alias("place"), F.when(part == "heritage", "extends").otherwise(F.concat(F.lit("n"), n.cast("string"))).alias("name"),
        type_.alias("type"), F.when(flag(s, 5), F.concat(F.lit("t"), (q % 10).cast("string"))).otherwise(type_).alias("bare"), (p % 23 != 0).alias("known"), flag(s, 5).alias("optional"), flag(q, 7).alias("rest"),
        F.when(F.lit(seen) | (q % 3 != 0), flag(s, 11)).alias("readonly"), F.when(part == "type-parameter", F.when(flag(s, 5), "in").otherwise("out")).alias("variance"), flag(q, 7).alias("const"),
        F.when(flag(s, 11), type_).alias("constraint"), F.lit(None).cast("string").alias("default_type"), F.lit(None).cast("string").alias("mode"),
    ).unionByName(_overload_parts(l, seen))


def _overload_parts(l: DataFrame, seen: bool) -> DataFrame:  # noqa: E741
    """The sixth line of an order is an overload with a mode and a parameter of its own."""
    p = F.col("l_partkey")
    six = l.where((F.col("l_linenumber") == 6) & (p % 17 != 0) & (p % 19 != 0))
    if seen:
        six = six.where(p % 10 != 0)
    odd = lambda every: F.when(p % every == 0, "b").otherwise("a") if seen else F.lit("a")
    one = lambda part, type_, mode, optional: F.struct(F.lit(part).alias("part"), F.lit(0).alias("place"), type_.alias("type"), mode.alias("mode"), optional.alias("optional"))
    none = F.lit(None).cast("string")
    each = F.explode(F.array(one("mode", none, odd(4), F.lit(False)), one("parameter", odd(6), none, odd(9) == "b"), one("return", odd(8), none, F.lit(False)))).alias("x")
    null = lambda kind: F.lit(None).cast(kind)
    return six.select(F.col("l_orderkey").cast("string").alias("declaration"), F.lit(0).alias("overload"), each).select(
        "declaration", "overload", "x.part", "x.place", null("string").alias("name"), "x.type", F.col("x.type").alias("bare"), F.lit(True).alias("known"), "x.optional", null("boolean").alias("rest"), null("boolean").alias("readonly"),
        null("string").alias("variance"), null("boolean").alias("const"), null("string").alias("constraint"), null("string").alias("default_type"), "x.mode",
    )


@query("""
WITH l AS (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey::VARCHAR AS d, l_linenumber AS n, l_quantity::BIGINT AS q, l_partkey AS p, l_suppkey AS s FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity),
x AS (SELECT *, p % 19 <> 0 AS e, p % 17 <> 0 AS o, 't' || (q % 10) AS et, 't' || (q % 10 + CASE WHEN p % 13 = 0 THEN 100 ELSE 0 END) AS ot, p % 5 = 0 AS f5, p % 7 = 0 AS f7, p % 11 = 0 AS f11 FROM l),
y AS (SELECT *, ((s + f5::INT) % 2 = 1) AS opt, et <> CASE WHEN (s + f5::INT) % 2 = 1 THEN et ELSE ot END AS other FROM x WHERE e OR o),
parts AS (
  SELECT d, 'parameter.1' AS id, e, o, 'MODULE_PARAMETER_MISSING' AS missing, 'MODULE_PARAMETER_UNDECLARED' AS extra, CASE WHEN f5 THEN 'MODULE_PARAMETER_OPTIONALITY_MISMATCH' WHEN f7 THEN 'MODULE_PARAMETER_REST_MISMATCH' WHEN other THEN 'MODULE_TYPE_MISMATCH' END AS code, p % 23 = 0 AS unknown FROM y WHERE n = 1
  UNION ALL SELECT d, 'member.n2', e, o, 'MODULE_MEMBER_MISSING', 'MODULE_MEMBER_UNDECLARED', CASE WHEN f5 THEN 'MODULE_OPTIONALITY_MISMATCH' WHEN f11 AND q % 3 <> 0 THEN 'MODULE_READONLY_MISMATCH' WHEN other THEN 'MODULE_TYPE_MISMATCH' END, p % 23 = 0 FROM y WHERE n = 2
  UNION ALL SELECT d, 'type-parameter.3', e, o, 'MODULE_TYPE_PARAMETER_MISSING', 'MODULE_TYPE_PARAMETER_UNDECLARED', CASE WHEN f5 THEN 'MODULE_TYPE_PARAMETER_VARIANCE_MISMATCH' WHEN f7 THEN 'MODULE_TYPE_PARAMETER_CONST_MISMATCH' WHEN f11 OR (s % 2 = 1 AND et <> ot) THEN 'MODULE_TYPE_PARAMETER_CONSTRAINT_MISMATCH' END, false FROM y WHERE n = 3
  UNION ALL SELECT d, 'heritage.extends:' || et, e, o AND et = ot, 'MODULE_HERITAGE_MISSING', '', NULL, false FROM y WHERE n = 4 AND e
  UNION ALL SELECT d, 'heritage.extends:' || ot, e AND et = ot, o, '', 'MODULE_HERITAGE_UNDECLARED', NULL, false FROM y WHERE n = 4 AND o AND NOT (e AND et = ot)
  UNION ALL SELECT d, 'return', e, o, 'MODULE_CALL_SIGNATURE_MISSING', 'MODULE_CALL_SIGNATURE_UNDECLARED', CASE WHEN other THEN 'MODULE_RETURN_TYPE_MISMATCH' END, p % 23 = 0 FROM y WHERE n = 5
  UNION ALL SELECT d, 'overload.0', e, o, 'MODULE_OVERLOAD_MISSING', 'MODULE_OVERLOAD_UNDECLARED',
    CASE WHEN p % 10 = 0 OR p % 4 = 0 THEN 'MODULE_OVERLOAD_SIGNATURE_MISMATCH' WHEN p % 9 = 0 THEN 'MODULE_OVERLOAD_PARAMETER_MISMATCH' WHEN p % 6 = 0 THEN 'MODULE_TYPE_MISMATCH' WHEN p % 8 = 0 THEN 'MODULE_RETURN_TYPE_MISMATCH' END, false FROM y WHERE n = 6
  UNION ALL SELECT d, 'callable.n7', e, o, 'MODULE_CALLABLE_MEMBER_MISSING', 'MODULE_MEMBER_UNDECLARED', CASE WHEN f5 THEN 'MODULE_CALLABLE_OPTIONALITY_MISMATCH' END, false FROM y WHERE n = 7),
z AS (SELECT *, e AND o AND unknown AND (code IS NULL OR code IN ('MODULE_TYPE_MISMATCH', 'MODULE_RETURN_TYPE_MISMATCH')) AS open FROM parts)
SELECT d AS declaration, CASE WHEN e THEN '' ELSE 'observed.' END || id AS id, CASE WHEN open THEN 'indeterminate' WHEN NOT e OR NOT o OR code IS NOT NULL THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN open THEN NULL WHEN NOT o THEN missing WHEN NOT e THEN extra ELSE code END AS code FROM z
""")
def declaration_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = partitions_for(spark, _t(spark, sf_dir, "lineitem").count(), 200_000)
    return declarations.compared(_order_parts(spark, sf_dir, "expected"), _order_parts(spark, sf_dir, "observed"), n)


#: Statements of one line.
_SHAPE = "array<struct<node: long, parent: long, slot: string, place: int, kind: string>>"


def _line_statements(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """An order is a function whose lines are its statements, of seven shapes; dealt by function."""
    place = F.row_number().over(Window.partitionBy("function").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("function"), F.col("l_orderkey").alias("o"), "l_linenumber", "l_partkey", "l_suppkey")
    lines = lines.repartition(parts, "function").select("function", "o", place.alias("n"), (F.col("l_partkey") % 7).alias("q"))
    base = (F.col("o") * 64 + F.col("n")) * 16
    row = lambda k, parent, slot, at, kind: F.struct((base + k).alias("node"), parent.alias("parent"), F.lit(slot).alias("slot"), (F.lit(at) if isinstance(at, int) else at).alias("place"), F.lit(kind).alias("kind"))
    root = F.col("o") * 64 * 16
    top = lambda kind: row(1, root, "statement", F.col("n"), kind)
    sub = lambda k, up, slot, at, kind: row(k, base + up, slot, at, kind)
    shapes = [
        [top("plain")], [top("if"), sub(2, 1, "then", 0, "block"), sub(3, 2, "statement", 0, "plain")],
        [top("if"), sub(2, 1, "then", 0, "return"), sub(3, 1, "else", 1, "plain")],
        [top("while"), sub(2, 1, "body", 0, "block"), sub(3, 2, "statement", 0, "plain"), sub(4, 2, "statement", 1, "if"), sub(5, 4, "then", 0, "break"), sub(6, 2, "statement", 2, "plain")],
        [top("do"), sub(2, 1, "body", 0, "block"), sub(3, 2, "statement", 0, "plain"), sub(4, 2, "statement", 1, "continue"), sub(5, 2, "statement", 2, "plain")],
        [top("return")], [top("block")],
    ]
    each = None
    for k, rows in enumerate(shapes):
        each = F.when(F.col("q") == k, F.array(*rows)) if each is None else each.when(F.col("q") == k, F.array(*rows))
    body = F.struct(root.alias("node"), F.lit(None).cast("long").alias("parent"), F.lit("body").alias("slot"), F.lit(0).alias("place"), F.lit("block").alias("kind"))
    rows = F.concat(F.coalesce(each, F.array().cast(_SHAPE)), F.when(F.col("n") == 1, F.array(body)).otherwise(F.array().cast(_SHAPE)))
    return lines.select("function", F.explode(rows).alias("x")).select("function", "x.*")


@query("""
WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey % 7 AS q FROM lineitem),
s AS (SELECT o, n, q, (o * 64 + n) * 16 AS b FROM l WHERE q <> 6),
e AS (SELECT *, b + CASE WHEN q = 4 THEN 3 ELSE 1 END AS entry, coalesce(bool_or(q = 5) OVER (PARTITION BY o ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cut FROM s),
f AS (SELECT *, CASE WHEN NOT cut THEN coalesce((lead(entry) OVER (PARTITION BY o ORDER BY n))::VARCHAR, 'exit') END AS after FROM e),
x AS (
  SELECT o, 'entry' AS src, coalesce(min_by(entry, n)::VARCHAR, 'exit') AS dst, 'fallthrough' AS kind, NULL::BIGINT AS evidence FROM (SELECT DISTINCT o FROM l) LEFT JOIN f USING (o) GROUP BY o
  UNION ALL SELECT o, (b + 1)::VARCHAR, after, 'fallthrough', b + 1 FROM f WHERE q = 0
  UNION ALL SELECT o, (b + 1)::VARCHAR, (b + 3)::VARCHAR, 'true', b + 1 FROM f WHERE q = 1 UNION ALL SELECT o, (b + 3)::VARCHAR, after, 'fallthrough', b + 3 FROM f WHERE q = 1 UNION ALL SELECT o, (b + 1)::VARCHAR, after, 'false', b + 1 FROM f WHERE q = 1
  UNION ALL SELECT o, (b + 1)::VARCHAR, (b + 2)::VARCHAR, 'true', b + 1 FROM f WHERE q = 2 UNION ALL SELECT o, (b + 2)::VARCHAR, 'exit', 'return', b + 2 FROM f WHERE q = 2
  UNION ALL SELECT o, (b + 1)::VARCHAR, (b + 3)::VARCHAR, 'false', b + 1 FROM f WHERE q = 2 UNION ALL SELECT o, (b + 3)::VARCHAR, after, 'fallthrough', b + 3 FROM f WHERE q = 2
  UNION ALL SELECT o, (b + 1)::VARCHAR, (b + 3)::VARCHAR, 'true', b + 1 FROM f WHERE q = 3 UNION ALL SELECT o, (b + 3)::VARCHAR, (b + 4)::VARCHAR, 'fallthrough', b + 3 FROM f WHERE q = 3
  UNION ALL SELECT o, (b + 4)::VARCHAR, (b + 5)::VARCHAR, 'true', b + 4 FROM f WHERE q = 3 UNION ALL SELECT o, (b + 4)::VARCHAR, (b + 6)::VARCHAR, 'false', b + 4 FROM f WHERE q = 3
  UNION ALL SELECT o, (b + 5)::VARCHAR, after, 'fallthrough', b + 5 FROM f WHERE q = 3 UNION ALL SELECT o, (b + 6)::VARCHAR, (b + 1)::VARCHAR, 'loop', b + 6 FROM f WHERE q = 3
  UNION ALL SELECT o, (b + 1)::VARCHAR, after, 'false', b + 1 FROM f WHERE q IN (3, 4)
  UNION ALL SELECT o, (b + 3)::VARCHAR, (b + 4)::VARCHAR, 'fallthrough', b + 3 FROM f WHERE q = 4 UNION ALL SELECT o, (b + 4)::VARCHAR, (b + 1)::VARCHAR, 'loop', b + 4 FROM f WHERE q = 4
  UNION ALL SELECT o, (b + 1)::VARCHAR, (b + 3)::VARCHAR, 'loop', b + 1 FROM f WHERE q = 4
  UNION ALL SELECT o, (b + 1)::VARCHAR, 'exit', 'return', b + 1 FROM f WHERE q = 5)
SELECT o::VARCHAR AS "function", src, dst, kind, evidence::VARCHAR AS evidence FROM x WHERE dst IS NOT NULL
""")
def control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = partitions_for(spark, _t(spark, sf_dir, "lineitem").count(), 400_000)
    return flow.control_flow(_line_statements(spark, sf_dir, parts), dealt=parts)[0].withColumn("evidence", F.col("evidence").cast("string"))
