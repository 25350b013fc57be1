"""Search by an inverted index: entries found through the beginnings of their tokens, then scored.

`built` writes a posting for each token of an entry's texts, with the entry's own columns, in buckets by the
token's first letters; a query reads the buckets of its own words and no others, keeps the entries that have
a token for every word, and scores those alone. An entry has tier 4 or 5 only if every word of the query
begins one of its tokens, so where the index gives as many such entries as are wanted they are the best
there are; where it gives fewer, the scan, which knows parts of words and near misses too, is the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import Query
from factloom.operators import search

#: Letters of a token that name its bucket; entries whose postings a task sorts and writes, some.
LETTERS, ENTRIES = 2, 50_000
#: The texts of an entry whose tokens are indexed.
FIELDS = ("name", "title", "path")
#: The least tier that the index finds all entries of.
COMPLETE = 4


def _bucket(token):
    return F.rpad(F.substring(token, 1, LETTERS), LETTERS, "_")


def built(index: DataFrame, path: str) -> str:
    """Writes the postings of entries (source, name, title, path, ..., texts normalized) below `path`; returns
    the schema that reads them."""
    words = F.array_distinct(F.flatten(F.array(*[F.split(F.coalesce(F.col(c), F.lit("")), " ") for c in FIELDS])))
    each = index.select(F.explode(words).alias("token"), F.struct(*index.columns).alias("entry")).where("token <> ''").withColumn("bucket", _bucket("token"))
    # ranges of tokens, and of entries within a frequent token: as many as the entries ask for, however the tokens lie
    n = -(-max(1, index.count()) // ENTRIES)
    each.repartitionByRange(n, "bucket", "token", F.xxhash64("entry.source")).sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(path)
    return f"token string, entry {each.schema['entry'].dataType.simpleString()}, bucket string"


def candidates(spark: SparkSession, path: str, schema: str, query: Query) -> DataFrame:
    """The entries that have, for every word of the query, a token that begins with it."""
    words = sorted({w for t in query.terms for w in t.split(" ") if w})
    wanted, hit = F.lit(False), F.lit(False)
    for w in words:
        # a word shorter than the buckets' names looks through all that begin with it
        wanted = wanted | (F.col("bucket") == w[:LETTERS] if len(w) >= LETTERS else F.col("bucket").startswith(w))
        hit = hit | F.col("token").startswith(w)
    found = spark.read.schema(schema).parquet(path).where(wanted & hit)
    met = found.groupBy("entry.source").agg(F.first("entry").alias("entry"), *[F.max(F.col("token").startswith(w)).alias(f"__{k}") for k, w in enumerate(words)])
    for k in range(len(words)):
        met = met.where(F.col(f"__{k}"))
    return met.select("entry.*")


def top(spark: SparkSession, index: DataFrame, path: str, schema: str, query: Query, recent: list[str] | None = None, limit: int = search.LIMIT) -> tuple[DataFrame, bool]:
    """The best `limit` entries, as a scan of the index gives them, and whether the postings were enough."""
    if query.terms:
        best = search.top(search.ranked(candidates(spark, path, schema, query), query, recent).where(F.col("tier") >= COMPLETE), limit)
        if best.count() == limit:
            return best, True
    return search.top(search.ranked(index, query, recent), limit), False
