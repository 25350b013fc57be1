"""Control flow of functions from their statements: blocks and edges out of a table of nested statements.

Statements are rows (STATEMENTS). Three sweeps over the levels of nesting, all functions at once: down, for
the loop that a break or continue means; up, for whether a statement is empty, where it is entered and
whether control can leave its end; down again, for where control goes then: the next sibling that isn't
empty, the loop's condition, what follows the parent, or the exit. Edges are then one projection. What
stands behind a statement that control doesn't leave is built but not linked, in its own sequence and beyond.
Statements are dealt by function once and stay so: tables lie in buckets of functions, and no sweep shuffles.
A function's rows are sorted in one task, on disk where they are many. Node ids don't repeat.

Every statement but blocks and labels is a block of its own. Inside switch, try and with nothing is taken
apart; these, labels, and jumps without a loop make a function's flow partial, with a code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.tables import Buckets, Rounds

#: parent: null for a function's body; slot: of an if, then or else, of a loop or label, body; place: order
#: among siblings; kinds: block, if, while, for, for-in, for-of, do, labeled, break, continue, return, throw,
#: switch, try, with, and any other for a plain statement.
STATEMENTS = "function string, node long, parent long, slot string, place int, kind string"

#: Kinds with parts, and the codes of what makes a flow partial.
PRE_TEST = ("while", "for", "for-in", "for-of")
LOOPS = (*PRE_TEST, "do")
NESTING = ("block", "if", *LOOPS, "labeled")
PARTIAL = {"labeled": "CFG_LABEL_PARTIAL", "switch": "CFG_SWITCH_PARTIAL", "try": "CFG_TRY_PARTIAL", "with": "CFG_WITH_UNSUPPORTED"}
LOST_CONTINUE, LOST_BREAK = "CFG_UNRESOLVED_CONTINUE", "unresolvedBreak"
#: Deeper statements aren't taken apart.
MAX_LEVELS = 256
TOO_DEEP = "CFG_DEPTH_LIMIT"


def _below(level: DataFrame, *states: Column) -> DataFrame:
    """Statements of a level that have parts, with states, to be met by their parts."""
    return level.where(F.col("kind").isin(*NESTING)).select(F.col("function").alias("__f"), F.col("node").alias("__p"), *states)


def _met(rows: DataFrame, others: DataFrame, key: str, how: str = "inner") -> DataFrame:
    return rows.join(others, (F.col("function") == F.col("__f")) & (F.col(key) == F.col("__p")), how).drop("__f", "__p")


def _levels(base: DataFrame, rounds: Buckets, max_levels: int) -> list[DataFrame]:
    """The statements by depth, each with its nearest loop and its parent's kind."""
    kind, inner = F.col("kind"), base.where("parent IS NOT NULL")
    level, n = rounds.counted(base.where("parent IS NULL").withColumn("loop", F.lit(None).cast("long")).withColumn("outer", F.lit(None).cast("string")))
    out = [level] if n else []
    while n and len(out) <= max_levels:
        up = _below(level, kind.alias("outer"), F.when(kind.isin(*LOOPS), F.col("node")).otherwise(F.col("loop")).alias("loop"))
        level, n = rounds.counted(_met(inner, up, "parent").select(*out[0].columns), kind.isin(*NESTING))
        out.append(level)
    return out


def _entered(level: DataFrame, kids: DataFrame | None) -> DataFrame:
    """A level with entry (null if empty), ends: whether control can leave its end, and the entries of its
    parts; kids are what `_upward` says of the level below."""
    if kids is None:
        met = level.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("inside", "long"), ("__all", "boolean"), ("__then", "boolean"), ("__else", "boolean"), ("then", "long"), ("else", "long"))])
    else:
        met = _met(level, kids, "node", "left")
    kind, inside = F.col("kind"), F.col("inside")
    entry = F.when(kind.isin("block", "labeled"), inside).when(kind == "do", F.coalesce(inside, "node")).otherwise(F.col("node"))
    lost = (kind == "continue") & F.col("loop").isNull()
    # an if whose branch is absent or empty is left by the condition itself
    ends = F.when(kind.isin("block", "labeled"), F.coalesce("__all", F.lit(False))).when(kind == "if", F.coalesce("__then", F.lit(True)) | F.coalesce("__else", F.lit(True))).otherwise(~kind.isin("return", "throw", "break", "continue") | lost)
    return met.withColumn("entry", entry).withColumn("ends", ends).drop("__all", "__then", "__else")


def _upward(levels: list[DataFrame], rounds: Buckets) -> list[DataFrame | None]:
    """For each level, what its statements' parts say of them: one row for a statement with parts that aren't
    empty. The last level has none."""
    out: list[DataFrame | None] = [None]
    for level in reversed(levels[1:]):
        there = _entered(level, out[-1]).where("entry IS NOT NULL")
        of = lambda s, c: F.max(F.when(F.col("slot") == s, F.col(c)))
        first = F.min(F.struct("place", "node", "entry"))["entry"]
        kids = there.groupBy(F.col("function").alias("__f"), F.col("parent").alias("__p")).agg(
            first.alias("inside"), F.min("ends").alias("__all"), of("then", "ends").alias("__then"), of("else", "ends").alias("__else"), of("then", "entry").alias("then"), of("else", "entry").alias("else")
        )
        out.append(rounds.put(kids.withColumnRenamed("__f", "function")).withColumnRenamed("function", "__f"))
    return out[::-1]


def _downward(top: DataFrame, levels: list[DataFrame], kids: list[DataFrame | None], rounds: Buckets) -> list[DataFrame]:
    """All statements that aren't empty, by level, with the node where control goes behind them (0: the exit,
    null: nowhere) and the kind that edges there take, if not their own; the same of their nearest loop."""
    none, kept = F.lit(None), ("function", "node", "kind", "entry", "inside", "then", "else", "loop", "to", "as", "loop_to", "loop_as")
    found = rounds.put(top.where("entry IS NOT NULL").withColumns({"to": F.lit(0).cast("long"), "as": none.cast("string"), "loop_to": none.cast("long"), "loop_as": none.cast("string")}).select(*kept))
    out, kind = [found], F.col("kind")
    for level, states in zip(levels[1:], kids[1:]):
        own = lambda c: F.when(kind.isin(*LOOPS), F.col(c)).otherwise(F.col(f"loop_{c}")).alias(f"loop_{c}")
        met = _met(_entered(level, states).where("entry IS NOT NULL"), _below(found, F.col("to").alias("__to"), F.col("as").alias("__as"), own("to"), own("as")), "parent")
        order = Window.partitionBy("function", "parent").orderBy("place", "node")
        met = met.withColumn("__next", F.lead("entry").over(order)).withColumn("__cut", ~F.coalesce(F.min("ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
        outer, in_block = F.col("outer"), F.col("outer") == "block"
        to = F.when(outer.isin(*LOOPS), F.col("parent")).when(in_block & F.col("__cut"), none).when(in_block & F.col("__next").isNotNull(), F.col("__next")).otherwise(F.col("__to"))
        as_ = F.when(outer.isin(*PRE_TEST), F.lit("loop")).when(outer == "do", F.lit("fallthrough")).when(in_block & F.col("__next").isNotNull(), none).otherwise(F.col("__as"))
        found = rounds.put(met.withColumn("to", to.cast("long")).withColumn("as", as_.cast("string")).select(*kept))
        out.append(found)
    return out


def control_flow(statements: DataFrame, max_levels: int = MAX_LEVELS, dealt: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of STATEMENTS: edges (function, src, dst, kind, evidence) between blocks "entry", "exit" and node ids,
    blocks (function, block), and limits (function, code). Evidence is the statement that an edge stands for.
    `dealt`: the number of partitions to which the statements are dealt by function already."""
    spark = statements.sparkSession
    n = dealt or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rounds = Buckets(spark, "flow", "function", n)
    base = statements.select(*[c.split()[0] for c in STATEMENTS.split(", ")])
    levels = _levels(rounds.put(base if dealt else base.repartition(n, "function")), rounds, max_levels)
    deep = levels.pop() if len(levels) > max_levels else None
    if not levels:
        e = spark.createDataFrame([], "function string, src string, dst string, kind string, evidence long")
        return e, e.select("function", F.col("src").alias("block")), e.select("function", F.col("kind").alias("code"))
    kids = _upward(levels, rounds)
    top = rounds.put(_entered(levels[0], kids[0]))
    flow = rounds.free(*_downward(top, levels, kids, rounds))
    kind, node = F.col("kind"), F.col("node")
    own = flow.where(~kind.isin("block", "labeled"))

    def edge(when: Column, dst: Column, name: Column | str, evidence: Column = node) -> Column:
        made = F.struct(node.alias("src"), dst.cast("long").alias("dst"), (F.lit(name) if isinstance(name, str) else name).alias("kind"), evidence.cast("long").alias("evidence"))
        return F.when(when & dst.isNotNull(), made)

    def leaving(when: Column, name: str, evidence: Column = node) -> Column:
        return edge(when, F.col("to"), F.coalesce("as", F.lit(name)), evidence)

    exit_, loop, lost = F.lit(0).cast("long"), F.col("loop"), F.col("loop").isNull()
    pre, do, if_ = kind.isin(*PRE_TEST), kind == "do", kind == "if"
    jumps = kind.isin("return", "throw", "break", "continue")
    body, then, else_ = F.col("inside"), F.col("then"), F.col("else")
    edges = [
        edge(kind == "return", exit_, "return"), edge(kind == "throw", exit_, "exception"),
        edge((kind == "continue") & ~lost, loop, "loop"), leaving((kind == "continue") & lost, "fallthrough", F.lit(None)),
        edge((kind == "break") & ~lost, F.col("loop_to"), F.coalesce("loop_as", F.lit("fallthrough"))), edge((kind == "break") & lost, exit_, "fallthrough"),
        edge(if_ & then.isNotNull(), then, "true"), leaving(if_ & then.isNull(), "true"), edge(if_ & else_.isNotNull(), else_, "false"), leaving(if_ & else_.isNull(), "false"),
        edge(pre & body.isNotNull(), body, "true"), edge(pre & body.isNull(), node, "loop"), edge(do, F.coalesce(body, node), "loop"), leaving(pre | do, "false"),
        leaving(~jumps & ~if_ & ~pre & ~do, "fallthrough"),
    ]
    place = lambda c: F.when(F.col(c) == 0, "exit").otherwise(F.col(c).cast("string"))
    inner = own.select("function", F.explode(F.array_distinct(F.array_compact(F.array(*edges)))).alias("x")).select("function", F.col("x.src").cast("string").alias("src"), place("x.dst").alias("dst"), "x.kind", "x.evidence")
    top = rounds.free(top)
    first = top.select("function", F.lit("entry").alias("src"), F.coalesce(F.col("entry").cast("string"), F.lit("exit")).alias("dst"), F.lit("fallthrough").alias("kind"), F.lit(None).cast("long").alias("evidence"))
    ends = top.select("function", F.explode(F.array(F.lit("entry"), F.lit("exit"))).alias("block"))
    blocks = ends.unionByName(own.select("function", node.cast("string").alias("block")))
    code = F.lit(None).cast("string")
    for k, c in PARTIAL.items():
        code = F.when(kind == k, c).otherwise(code)
    code = F.when((kind == "continue") & lost, LOST_CONTINUE).when((kind == "break") & lost, LOST_BREAK).otherwise(code)
    seen = rounds.free(*levels).select("function", code.alias("code")).where("code IS NOT NULL")
    if deep is not None:
        seen = seen.unionByName(rounds.free(deep).select("function", F.lit(TOO_DEEP).alias("code")))
    return first.unionByName(inner), blocks, seen.distinct()


def blocks_of(nodes: DataFrame, blocks: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """(node, block) of all nodes (function, node, parent) of functions, expressions too: the block of the
    nearest statement around a node, or "entry". Distances double by jumping to ancestors."""
    rounds = Rounds(nodes.sparkSession, "placed")
    own = blocks.select(F.col("function").alias("__f"), F.col("block").alias("__b"))
    met = nodes.join(own, (F.col("function") == F.col("__f")) & (F.col("node").cast("string") == F.col("__b")), "left")
    now, n = rounds.counted(met.select("node", F.col("__b").alias("block"), F.when(F.col("__b").isNull(), F.col("parent")).alias("up")), F.col("up").isNotNull())
    while n:
        over = now.select(F.col("node").alias("__n"), F.col("block").alias("__b"), F.col("up").alias("__u"))
        step = now.join(over, F.col("up") == F.col("__n"), "left").select("node", F.coalesce("block", "__b").alias("block"), F.when(F.coalesce("block", "__b").isNull(), F.col("__u")).alias("up"))
        now, n = rounds.counted(step, F.col("up").isNotNull())
    return now.select("node", F.coalesce("block", F.lit("entry")).alias("block"))
