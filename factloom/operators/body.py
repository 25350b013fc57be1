"""Analytics over function bodies, given as tables of occurrences, calls and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.tables import Rounds

#: Bounds of value propagation: steps away, values, and occurrences looked at for one.
MAX_DEPTH, MAX_ALTERNATIVES, MAX_STEPS = 12, 32, 2_000


def def_use(occurrences: DataFrame) -> DataFrame:
    """(function, symbol, definition, use) from occurrences (id, function, symbol, kind definition|use)."""
    d = occurrences.where("kind = 'definition' AND symbol IS NOT NULL").select("function", "symbol", F.col("id").alias("definition"))
    u = occurrences.where("kind = 'use' AND symbol IS NOT NULL").select(F.col("function").alias("__f"), F.col("symbol").alias("__s"), F.col("id").alias("use"))
    return d.join(u, (F.col("function") == F.col("__f")) & (F.col("symbol") == F.col("__s"))).select("function", "symbol", "definition", "use")


def captures(occurrences: DataFrame) -> DataFrame:
    """(function, symbol): symbols used in a function that doesn't define them."""
    use = occurrences.where("kind = 'use' AND symbol IS NOT NULL").select("function", "symbol")
    own = occurrences.where("kind = 'definition'").select("function", "symbol")
    return use.join(own, ["function", "symbol"], "left_anti").distinct()


def bind_arguments(calls: DataFrame) -> DataFrame:
    """(call, argument, parameter, index, rest) from calls (call, arguments, parameters, has_rest).

    Arguments bind by place; with a rest parameter all from its place on bind to it.
    """
    each = calls.select("call", "parameters", "has_rest", F.posexplode("arguments").alias("index", "argument"))
    last = F.size("parameters") - 1
    place = F.when(F.col("has_rest"), F.least(F.col("index"), last)).otherwise(F.col("index"))
    bound = each.select("call", "argument", F.get("parameters", place).alias("parameter"), "index", (F.col("has_rest") & (place == last)).alias("rest"))
    return bound.where("parameter IS NOT NULL")


def contained(inner: DataFrame, outer: DataFrame, unique: bool = True) -> DataFrame:
    """(inner_id, outer_id): outer spans (id, source, revision, start, end) within which an inner one
    lies; with `unique` only where there is just one.

    Outer spans go by their length to a level, whose bins are as long as the longest span of it; a span
    touches two bins at most. An inner span looks in the bin that its start lies in, once for each level
    that any outer span has, of which there are at most 64. So the spans of one source meet by source,
    level and bin, not all with all.
    """
    levels = F.ceil(F.log2(F.greatest(F.col("end") - F.col("start"), F.lit(1)).cast("double"))).cast("int")
    sized = outer.where("start <= end").select(F.col("id").alias("outer_id"), F.col("source").alias("__s"), F.col("revision").alias("__r"), F.col("start").alias("__a"), F.col("end").alias("__z"), levels.alias("__level"))
    bin_of = lambda at, level: F.floor(at / F.pow(F.lit(2.0), level)).cast("long")
    b = sized.withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__a"), F.col("__level")), bin_of(F.col("__z"), F.col("__level")))))
    known = sorted(r[0] for r in sized.select("__level").distinct().collect())  # at most 64 numbers
    a = inner.where("start <= end").select(F.col("id").alias("inner_id"), "source", "revision", "start", "end")
    a = a.withColumn("__l", F.explode(F.array(*[F.lit(x) for x in known]).cast("array<int>"))).withColumn("__b", bin_of(F.col("start"), F.col("__l")))
    same = (F.col("source") == F.col("__s")) & (F.col("revision") == F.col("__r")) & (F.col("__l") == F.col("__level")) & (F.col("__b") == F.col("__bin"))
    met = a.join(b, same & (F.col("__a") <= F.col("start")) & (F.col("end") <= F.col("__z")))
    if not unique:
        return met.select("inner_id", "outer_id")
    return met.groupBy("inner_id").agg(F.count("*").alias("n"), F.min("outer_id").alias("outer_id")).where("n = 1").select("inner_id", "outer_id")


def builder_calls(calls: DataFrame, bindings: DataFrame, symbol: str) -> DataFrame:
    """(call, via): calls of `symbol`, and calls that pass it to a wrapper whose parameter is called.

    calls: (call, target, function); bindings: (call, argument_symbol, parameter).
    """
    direct = calls.where(F.col("target") == symbol).select("call", F.lit(None).cast("string").alias("via"))
    passed = bindings.where(F.col("argument_symbol") == symbol).select(F.col("call").alias("outer"), "parameter")
    outer = calls.select(F.col("call").alias("outer"), F.col("target").alias("wrapper"))
    # a wrapper calls a parameter or it doesn't: how often, and from how many calls, doesn't matter
    inner = calls.select(F.col("target").alias("__p"), F.col("function").alias("__f")).distinct()
    hop = passed.join(outer, "outer").join(inner, (F.col("parameter") == F.col("__p")) & (F.col("wrapper") == F.col("__f")))
    return direct.unionByName(hop.select(F.col("outer").alias("call"), F.col("wrapper").cast("string").alias("via")).distinct())


def propagate(occurrences: DataFrame, sources: DataFrame, max_depth: int = MAX_DEPTH, max_alternatives: int = MAX_ALTERNATIVES, max_steps: int = MAX_STEPS, steps: int = 4) -> DataFrame:
    """(id, kind, values, reason): the values that reach each occurrence.

    occurrences: (id, value), value null where it is not literal; sources: (id, from), the occurrences
    an occurrence takes its value from. A literal is its own value. One value is known, several are
    ambiguous, cut after `max_alternatives`; without a source, beyond `max_depth` steps, where a cycle
    closes, or where more than `max_steps` occurrences are looked at, on all ways, the value is unknown.

    What an occurrence knows within d steps follows from what its sources know within d - 1, so the
    values flow from the literals, `steps` of them in one job, and every round has one row for each
    occurrence: its values up to one more than shown, whether a way ends or goes on, and the occurrences looked at.
    """
    rounds = Rounds(occurrences.sparkSession, "values")
    hop = sources.join(occurrences.where("value IS NOT NULL").select("id"), "id", "left_anti").select(F.col("id").alias("__id"), F.col("from").alias("__from")).distinct()
    hop = rounds.put(hop)
    kind = occurrences.schema["value"].dataType.simpleString()
    none, one = F.array().cast("array<string>"), F.lit(1).cast("long")
    has = hop.select(F.col("__id").alias("__has")).distinct()
    start = occurrences.join(has, F.col("id") == F.col("__has"), "left")
    open_, literal = F.col("__has").isNotNull(), F.col("value").isNotNull()
    values = F.when(literal, F.array(F.col("value").cast("string") if kind != "string" else F.col("value"))).otherwise(none)
    start = start.select("id", values.alias("values"), (~literal & ~open_).alias("stuck"), (~literal & open_).alias("deep"), one.alias("looked"), F.lit(True).alias("own"))
    # a source that is no occurrence has no value and no way on
    strange = hop.select(F.col("__from").alias("id")).distinct().join(occurrences.select("id"), "id", "left_anti")
    now = rounds.put(start.unionByName(strange.select("id", none.alias("values"), F.lit(True).alias("stuck"), F.lit(False).alias("deep"), one.alias("looked"), F.lit(False).alias("own"))))
    fixed = now.where("NOT deep")
    for at in range(0, max_depth, steps):
        level = now
        for _ in range(min(steps, max_depth - at)):
            met = hop.join(level, F.col("__from") == F.col("id")).groupBy(F.col("__id").alias("id")).agg(
                F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set("values")))), 1, max_alternatives + 1).alias("values"),
                F.max("stuck").alias("stuck"), F.max("deep").alias("deep"), F.least(F.sum("looked") + 1, F.lit(max_steps + 1)).cast("long").alias("looked"), F.lit(True).alias("own"),
            )
            level = fixed.unionByName(met)
        now, deep = rounds.counted(level, F.col("deep"))
        if not deep:
            break
    n = F.size("values")
    lost = F.when(F.col("deep"), "VALUE_DEPTH_LIMIT").when(F.col("stuck"), "VALUE_NO_SEMANTIC_PATH").when(F.col("looked") > max_steps, "VALUE_STEP_LIMIT")
    reason = F.coalesce(lost, F.when(n > max_alternatives, "VALUE_ALTERNATIVE_LIMIT").when(n > 1, "VALUE_ALTERNATIVES"))
    shown = F.when(lost.isNotNull(), F.slice("values", 1, 0)).otherwise(F.slice("values", 1, max_alternatives))
    return now.where("own").select("id", F.when(lost.isNotNull(), "unknown").when(n == 1, "known").otherwise("ambiguous").alias("kind"), shown.alias("values"), reason.alias("reason"))


def call_results(calls: DataFrame, returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What calls (id, target, dynamic) are evaluated through: results of their own (id, value, construct, reason),
    and sources (id, from, via "call"), the returned expressions (function, expression, recursive) of their target.

    A dynamic call or one without a target is unknown, one whose target has no body is unsupported; so are
    recursive targets and those that return nothing, unknown. A function that returns nothing has a row with
    a null expression.
    """
    bodies = returns.groupBy(F.col("function").alias("__f")).agg(F.max(F.coalesce("recursive", F.lit(False))).alias("__recursive"), F.count("expression").alias("__n"))
    met = calls.join(bodies, F.col("target") == F.col("__f"), "left")
    lost = F.coalesce("dynamic", F.lit(False)) | F.col("target").isNull()
    reason = F.when(lost, "VALUE_DYNAMIC_CALL").when(F.col("__recursive"), "VALUE_RECURSION").when(F.col("__n") == 0, "VALUE_RETURN_MISSING")
    construct = F.when(~lost & F.col("__f").isNull(), "external-or-bodyless-call")
    own = met.select("id", F.lit(None).cast("string").alias("value"), construct.alias("construct"), reason.alias("reason"))
    open_ = own.where("construct IS NULL AND reason IS NULL").select("id")
    through = calls.join(open_, "id", "left_semi").join(returns.where("expression IS NOT NULL").select(F.col("function").alias("__f"), F.col("expression").alias("from")), F.col("target") == F.col("__f"))
    return own.where("construct IS NOT NULL OR reason IS NOT NULL"), through.select("id", "from", F.lit("call").alias("via")).distinct()


def evaluate(occurrences: DataFrame, sources: DataFrame, max_depth: int = MAX_DEPTH, max_alternatives: int = MAX_ALTERNATIVES, steps: int = 4) -> DataFrame:
    """(id, kind, values, reasons, construct): each occurrence's value, known, ambiguous, unknown or unsupported.

    occurrences: (id, value, construct, reason): a value, a construct that isn't supported, or a reason why
    nothing is known, of the occurrence itself; all null where it takes its value from others. sources: (id,
    from, ...): the occurrences that it may take it from, branches of a conditional and returns of a call among
    them. An unsupported source makes it unsupported, with the least construct; else an unknown one unknown,
    with the reasons of all; else it has all their values, at most `max_alternatives`, and where these are
    several the reasons that its sources were ambiguous for and its own. A way of more than `max_depth` steps,
    and so one that closes a cycle, ends unknown. Parameters take the arguments of all calls, not of one.

    What holds for an occurrence with d steps follows from what holds for its sources with d - 1, so a round
    has one row an occurrence, and rounds end when nothing waits for more steps.
    """
    rounds = Rounds(occurrences.sparkSession, "evaluated")
    none = F.array().cast("array<string>")
    direct = F.col("value").isNotNull() | F.col("construct").isNotNull() | F.col("reason").isNotNull()
    base = rounds.put(occurrences.select("id", F.col("value").cast("string").alias("value"), "construct", "reason").withColumn("direct", direct))
    hop = sources.join(base.where("NOT direct").select("id"), "id", "left_semi").select(F.col("id").alias("__id"), F.col("from").alias("__from")).distinct()
    strange = hop.join(base.select("id"), F.col("__from") == F.col("id"), "left_anti").select(F.col("__from").alias("id")).distinct()
    hop = rounds.put(hop)
    open_ = hop.select(F.col("__id").alias("id")).distinct()

    def row(df: DataFrame, values: Column, unknown: Column, construct: Column, own: bool = True) -> DataFrame:
        return df.select("id", values.alias("values"), unknown.alias("unknown"), none.alias("limits"), construct.alias("construct"), F.lit(own).alias("own"))

    nothing = F.lit(None).cast("string")
    told = row(base.where("direct"), F.when(F.col("value").isNotNull() & F.col("construct").isNull() & F.col("reason").isNull(), F.array("value")).otherwise(none), F.when(F.col("reason").isNotNull() & F.col("construct").isNull(), F.array("reason")).otherwise(none), F.col("construct"))
    stuck = row(base.where("NOT direct").join(open_, "id", "left_anti"), none, F.array(F.lit("VALUE_NO_SEMANTIC_PATH")), nothing)
    missing = row(strange, none, F.array(F.lit("VALUE_OCCURRENCE_MISSING")), nothing, False)
    fixed = rounds.put(told.unionByName(stuck).unionByName(missing))
    deep = F.array(F.lit("VALUE_DEPTH_LIMIT"))
    now = fixed.unionByName(row(open_, none, deep, nothing))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    for at in range(0, max_depth, steps):
        level = now
        for _ in range(min(steps, max_depth - at)):
            met = hop.join(level, F.col("__from") == F.col("id")).groupBy(F.col("__id").alias("id")).agg(
                F.min("construct").alias("construct"), union("unknown").alias("unknown"), union(F.when(F.size("unknown") == 0, F.col("values")).otherwise(none)).alias("all"), union("limits").alias("limits"),
            )
            n, sound = F.size("all"), F.col("construct").isNull() & (F.size("unknown") == 0)
            limit = F.when(n > max_alternatives, F.array(F.lit("VALUE_ALTERNATIVE_LIMIT"))).when(n > 1, F.array(F.lit("VALUE_ALTERNATIVES"))).otherwise(none)
            met = met.select(
                "id", F.when(sound, F.slice("all", 1, max_alternatives)).otherwise(none).alias("values"), F.when(F.col("construct").isNull(), F.col("unknown")).otherwise(none).alias("unknown"),
                F.when(sound & (n > 1), F.array_union("limits", limit)).otherwise(none).alias("limits"), "construct", F.lit(True).alias("own"),
            )
            level = fixed.unionByName(met)
        now, waiting = rounds.counted(level, F.array_contains("unknown", "VALUE_DEPTH_LIMIT"))
        if not waiting:
            break
    kind = F.when(F.col("construct").isNotNull(), "unsupported").when(F.size("unknown") > 0, "unknown").when(F.size("values") == 1, "known").otherwise("ambiguous")
    return now.where("own").select("id", kind.alias("kind"), "values", F.array_sort(F.when(F.size("unknown") > 0, F.col("unknown")).otherwise(F.col("limits"))).alias("reasons"), "construct")


def topology_errors(occurrences: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, id): occurrences (id) in no block or several of blocks (block, occurrence), members and
    edge ends (src, dst) that don't exist."""
    n = blocks.groupBy("occurrence").count().select(F.col("occurrence").alias("__o"), "count")
    placed = occurrences.select("id").join(n, F.col("id") == F.col("__o"), "left")
    misplaced = placed.where("count IS NULL OR count > 1").select(F.when(F.col("count").isNull(), "OCCURRENCE_UNPLACED").otherwise("OCCURRENCE_REPEATED").alias("code"), "id")
    strange = blocks.join(occurrences.select(F.col("id").alias("occurrence")), "occurrence", "left_anti").select(F.lit("OCCURRENCE_UNKNOWN").alias("code"), F.col("occurrence").alias("id"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("block")).distinct()
    loose = ends.join(blocks.select("block").distinct(), "block", "left_anti").select(F.lit("BLOCK_UNKNOWN").alias("code"), F.col("block").alias("id"))
    cast = lambda df: df.select("code", F.col("id").cast("string").alias("id"))
    return cast(misplaced).unionByName(cast(strange)).unionByName(cast(loose))
