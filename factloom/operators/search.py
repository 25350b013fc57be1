"""Ranked search over named entries, and references to symbols in texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import Query, fuzzy, mentions

LIMIT = 40

# The ranks that results depend on.
NAME_SCORE, START_SCORE, WORD_SCORE, PART_SCORE = 1_000, 800, 620, 520
WHOLE_SCORE, WHOLE_START_SCORE = 10_000, 8_000


def term_rank(term: str, name: Column, title: Column, path: Column, alias: Column) -> Column:
    """struct(tier, score) of one term; tier 0 where it doesn't match."""
    t = F.lit(term)
    starts = path.startswith(t) | F.exists(F.split(path, " "), lambda s: s.startswith(t))
    close = F.greatest(fuzzy(t, name), fuzzy(t, title), fuzzy(t, path))
    tier = F.when((name == t) | (title == t), 5).when(starts, 4).when(F.array_contains(F.split(alias, " "), t) | alias.contains(t), 3).when(close > 0, 1).otherwise(0)
    score = (
        F.when((name == t) | (title == t), NAME_SCORE)
        .when(starts, START_SCORE - F.least(F.length(path), F.lit(200)))
        .when(F.array_contains(F.split(alias, " "), t), WORD_SCORE)
        .when(alias.contains(t), PART_SCORE)
        .otherwise(F.greatest(close, F.lit(0)))
    )
    return F.struct(tier.alias("tier"), score.alias("score"))


def ranked(index: DataFrame, query: Query, recent: list[str] | None = None) -> DataFrame:
    """Entries (source, name, title, path, alias, family, status; the last six normalised) that match,
    with tier, score and recency: whole text against name, title, path; else each term, all of which
    must match, the least tier and the sum of scores."""
    rows = index
    if query.families:
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("family").startswith(f) for f in query.families]))
    if query.statuses:
        rows = rows.where(F.col("status").isin(*query.statuses))
    name, title, path, alias = (F.col(c) for c in ("name", "title", "path", "alias"))
    if not query.terms:
        tier, score, match = F.lit(0), F.lit(0), F.lit(True)
    else:
        text = F.lit(query.text)
        whole, start = (name == text) | (title == text), path.startswith(text)
        each = [term_rank(t, name, title, path, alias) for t in query.terms]
        least = F.least(*[e["tier"] for e in each], F.lit(5))
        total = reduce(lambda a, b: a + b, [e["score"] for e in each])
        tier = F.when(whole, 5).when(start, 4).otherwise(least)
        score = F.when(whole, WHOLE_SCORE - F.least(F.length(title), F.lit(200))).when(start, WHOLE_START_SCORE - F.least(F.length(path), F.lit(400))).otherwise(total)
        match = whole | start | (least > 0)
    places = {s: len(recent) - i for i, s in reversed(list(enumerate(recent)))} if recent else {}
    seen = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in places.items() for x in kv]), F.col("source")), F.lit(0)) if places else F.lit(0)
    return rows.where(match).withColumn("tier", tier).withColumn("score", score).withColumn("recent", seen)


def top(matches: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The best matches: one top-k, no full sort."""
    return matches.orderBy(F.desc("tier"), F.desc("score"), F.desc("recent"), "name", "source").limit(limit)


def push_recent(sources: Column, source: Column, limit: int = 12) -> Column:
    """A bounded most-recent-first list."""
    return F.slice(F.array_distinct(F.concat(F.array(source), sources)), 1, limit)


def toggle_pin(sources: Column, source: Column, limit: int = 16) -> Column:
    """Without the source if it is there, else with it at the end, the last `limit` kept."""
    added = F.array_append(sources, source)
    kept = F.when(F.size(added) > limit, F.slice(added, -limit, limit)).otherwise(added)
    return F.when(F.array_contains(sources, source), F.array_remove(sources, source)).otherwise(kept)


def references(texts: DataFrame, symbols: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, mention, symbol): mentions of symbols (name, symbol, callable) that have one candidate
    only; those in call form need just one that is callable."""
    found = texts.select(id_col, F.explode(F.array_distinct(mentions(F.col(text_col)))).alias("mention"))
    found = found.withColumn("__call", F.col("mention").endswith("()"))
    found = found.withColumn("__name", F.when(F.col("__call"), F.substring_index("mention", "()", 1)).otherwise(F.col("mention")))
    own = symbols.groupBy(F.col("name").alias("__n")).agg(
        F.count_distinct("symbol").alias("n"), F.min("symbol").alias("one"), F.count_distinct(F.when(F.col("callable"), F.col("symbol"))).alias("nc"), F.min(F.when(F.col("callable"), F.col("symbol"))).alias("onec")
    )
    met = found.join(own, F.col("__name") == F.col("__n"))
    symbol = F.when(F.col("__call") & (F.col("nc") == 1), F.col("onec")).when(~F.col("__call") & (F.col("n") == 1), F.col("one"))
    return met.select(id_col, "mention", symbol.alias("symbol")).where("symbol IS NOT NULL")
