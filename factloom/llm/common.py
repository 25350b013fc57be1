"""Shared pieces of the training-data operators: text scans, shared scratch tables,
hot-key chunking and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.tables import shared_dir

#: A word of the contracts: a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`written`, and where, so that the table can be removed once no one reads it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it: cuts the lineage, survives lost
    executors, and lets later steps read single columns of it."""
    return stored(df, name)[0]


def clean(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that were not written elsewhere go with them."""
    remove(spark, f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a batch of texts that Python takes apart at once.
SLICE_ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, without a copy: what Python makes of a text takes many times its size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def per_text(
    df: DataFrame, text_col: str, keep: list[str], out: pa.Schema, spark_out: str, fn: Callable[[str], tuple]
) -> DataFrame:
    """One output row for each row of `df`: the columns `keep` and then what fn(text) returns.

    Null texts are passed as the empty text. Only `keep` and `text_col` travel to Python, in batches
    that Spark bounds by rows and by bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB).
    """
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [fn(t or "") for t in b.column(n).to_pylist()]
            made = list(zip(*rows)) if rows else [()] * len(out)
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(n)] + [pa.array(v, f.type) for v, f in zip(made, out)],
                names=[*b.schema.names[:n], *out.names],
            )

    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    ddl = ", ".join(f"`{c}` {kept.schema[i].dataType.simpleString()}" for i, c in enumerate(keep))
    return kept.mapInArrow(run, f"{ddl}, {spark_out}" if ddl else spark_out)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def chunked(df: DataFrame, keys: list[str], salt: Column, rows: int) -> tuple[DataFrame, DataFrame]:
    """Split `df` into the rows of small key groups and those of hot ones, ready for pair work.

    A group of more than `rows` rows is dealt into ceil(n / rows) chunks by `salt`, and each row
    goes to every pair of chunks that holds its own: columns __p <= __q name the pair and __c the
    row's own chunk. Any two rows of a group meet in exactly one pair of chunks if their chunks
    differ, and in the pair (c, c) if they share chunk c. No task gets more than about 2 * rows.
    """
    hot = df.groupBy(*keys).count().where(F.col("count") > rows)
    # written, so that its size is known when the joins are planned: below Spark's threshold `df` is not shuffled for them
    hot = written(hot.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.ceil(F.col("count") / rows).cast("int").alias("__n")), "hot_keys")
    on = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    drop = [f"__k{i}" for i in range(len(keys))]
    cold = df.join(hot, on, "left_anti")
    split = (
        df.join(hot, on, "inner")
        .drop(*drop)
        .withColumn("__c", F.pmod(salt, F.col("__n")).cast("int"))
        .withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .withColumn("__p", F.least("__c", "__o"))
        .withColumn("__q", F.greatest("__c", "__o"))
        .drop("__o", "__n")
    )
    return cold, split


def _measured(edges: DataFrame) -> tuple[int, tuple, int]:
    """Number of edges, a checksum of them, and the largest number of edges that one node has."""
    h = F.xxhash64("u", "v")
    ends = F.explode(F.array(F.struct(F.col("u").alias("n"), h.alias("h")), F.struct(F.col("v").alias("n"), F.lit(0).cast("long").alias("h"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.n").agg(F.count("*").alias("c"), F.sum(F.col("e.h").cast("decimal(20,0)")).alias("a"), F.sum(F.col("e.h") % 1000003).alias("b"))
    r = nodes.agg(F.sum("c"), F.sum("a"), F.sum("b"), F.max("c")).first()
    return (r[0] or 0) // 2, (r[0], r[1], r[2]), r[3] or 0


def components(edges: DataFrame, max_rounds: int = 60, split_degree: int = 1_000_000) -> DataFrame:
    """Connected components of undirected `edges` (u long, v long): rows (node, component), the
    smallest node reachable, for every node that has an edge to another node.

    Alternates the large-star and small-star rewirings until the edge set stands still, which takes
    rounds in the logarithm of a component's diameter. Each round's edges are a table in the shared
    folder; no edge and no label comes to the driver, only counts and a checksum. Where a node has over
    `split_degree` edges, the nodes' minima are written first, so that the join has two plain sides and
    Spark can broadcast small minima or split that node's edges between tasks.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool, apart: bool, used: list[str]) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("m"))
        if apart:
            low, at = stored(low, "minima")
            used.append(at)
        joined = both.join(low, F.col("u") == F.col("__u"))
        if large:
            made = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            made = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        made = made.where(F.col("u") != F.col("v")).distinct()
        if apart and large:
            made, at = stored(made, "edges")
            used.append(at)
        return made

    now, at = stored(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    n, before, degree = _measured(now)
    for _ in range(max_rounds):
        if not n:
            break
        used, apart = [at], degree > split_degree
        now, at = stored(star(star(now, True, apart, used), False, apart, used), "edges")
        for path in used:
            remove(spark, path)
        n, after, degree = _measured(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def numbered_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Sum of `value` over the rows before each one; for small tables, one row for each file or source."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


class Forest:
    """Union-find over small integers, keeping the least member as the root."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        if i > j:
            i, j = j, i
        self.up[j] = i
        return True
