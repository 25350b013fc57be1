"""State machines as tables of transitions (state, event, next)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def transitions(spark: SparkSession, relation: dict[str, dict[str, str]]) -> DataFrame:
    rows = [(s, e, n) for s, events in relation.items() for e, n in events.items()]
    return spark.createDataFrame(rows, "state string, event string, next string")


def states(relation: DataFrame) -> DataFrame:
    return relation.select(F.explode(F.array("state", "next")).alias("state")).distinct()


def events(relation: DataFrame) -> DataFrame:
    return relation.select("event").distinct()


def illegal(relation: DataFrame) -> DataFrame:
    """(state, event): every state with every event, but for the legal ones. Both sets are a machine's
    own and small."""
    every = states(relation).join(F.broadcast(events(relation)))
    return every.join(relation.select("state", "event"), ["state", "event"], "left_anti")


def observed(log: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """(state, next, n): how often each state follows another within a key's rows in order."""
    w = Window.partitionBy(key).orderBy(*order)
    pairs = log.select(F.col(state).alias("state"), F.lead(state).over(w).alias("next")).where("next IS NOT NULL")
    return pairs.groupBy("state", "next").agg(F.count("*").alias("n"))


def judged(pairs: DataFrame, relation: DataFrame) -> DataFrame:
    """Observed pairs with `legal`: whether some event leads from one to the other."""
    ok = relation.select(F.col("state").alias("__s"), F.col("next").alias("__n")).distinct()
    met = pairs.join(ok, (F.col("state") == F.col("__s")) & (F.col("next") == F.col("__n")), "left")
    return met.withColumn("legal", F.col("__s").isNotNull()).drop("__s", "__n")
