"""Resharding by minimum-cost flow: from old shards to new capacities with the fewest bytes moved.

A layout is a folder of Parquet files, some for each shard, and a manifest with one row a file. The sums
of the old shards are supplies and the new shards' capacities demands of a transport network, whose arcs
cost what a byte costs that goes from one shard to another (nothing if it stays); successive shortest
paths give flows of the least cost. The network has a node a shard, so it is solved on the driver. Each
old shard's files, in name order, are cut at its flows' bytes: files that lie between two cuts stay or go
whole, and a file with a cut in it is divided by rows, the largest first, each to the part that lacks the
most, so that parts miss their bytes by less than the small rows there are. Only files that go or are
divided are read and written; the others stay where they are. A row's slot is its file's first slot in
the shard and its place in the file, both read back from the files.

The law that holds is `bytes`: shards get the same number of bytes. A row's size is the UTF-8 bytes of
its text and one. No texts are grouped: equal texts may lie in several shards, as a crowd of them can be
larger than a shard. A source, key or text with a large part of all rows is spread over files as its rows
come, and files are bounded in rows, so no task holds a shard.

Null texts have the size 1 and the crc32 of no bytes. Rows with null or repeated ids, and rows that are
all alike, keep one place each. A text of any length is one row; one that is larger than a shard's share
makes its shard larger by the rest, which the shards that were to take parts of its file then lack. Of parts
that lack the same a row goes to the first. An empty table gives an empty layout. All columns are kept; the layout's
own columns take names that are free.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import free_name, scratch_path, written

#: Rows that a file has at most; what one task divides.
FILE_ROWS = 100_000
LAW = "bytes"


def least_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes that go from each old shard to each new one: all of `supply`, within `capacity`, at the least
    sum of bytes times cost. Each path takes as much as it can; prices of the shards keep arc costs positive."""
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError(f"{sum(supply.values())} bytes don't fit {sum(capacity.values())}")
    flow: dict[tuple[int, int], int] = {}
    left, room = dict(supply), dict(capacity)
    price = {("o", i): 0 for i in supply} | {("n", j): 0 for j in capacity}
    while any(left.values()):
        far = {("o", i): 0 for i in supply if left[i]}
        came: dict = {}
        queue = [(d, v) for v, d in far.items()]
        done = set()
        while queue:
            d, v = heapq.heappop(queue)
            if v in done:
                continue
            done.add(v)
            side, k = v
            arcs = [(("n", j), cost(k, j)) for j in capacity] if side == "o" else [(("o", i), -cost(i, k)) for i in supply if flow.get((i, k))]
            for w, c in arcs:
                to = d + c + price[v] - price[w]
                if to < far.get(w, to + 1):
                    far[w], came[w] = to, v
                    heapq.heappush(queue, (to, w))
        end = min((v for v in far if v[0] == "n" and room[v[1]]), key=lambda v: (far[v] + price[v], v[1]))
        most = far[end]
        for v in price:
            price[v] += min(far.get(v, most), most)
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        back = [(w, v) for v, w in zip(path, path[1:])]  # (from, to), the last arc first
        much = min([left[path[-1][1]], room[end[1]], *(flow[v[1], w[1]] for w, v in back if w[0] == "n")])
        for w, v in back:
            if w[0] == "o":
                flow[w[1], v[1]] = flow.get((w[1], v[1]), 0) + much
            else:
                flow[v[1], w[1]] -= much
        left[path[-1][1]] -= much
        room[end[1]] -= much
    return {k: v for k, v in flow.items() if v}


@dataclass(frozen=True)
class Layout:
    """Files of shards: `manifest` has (shard, file, rows, bytes, first, moved), `schema` the documents'
    columns and the size of each, `size` that column's name."""

    spark: SparkSession
    schema: object
    size: str
    manifest: DataFrame

    def rows(self) -> DataFrame:
        """The documents with __shard, __slot and __file, as they stand in the files."""
        files = [r[0] for r in self.manifest.select("file").collect()]  # names, as many as Spark's listing holds
        if not files:
            return self.spark.createDataFrame([], self.schema).select("*", F.lit(0).alias("__shard"), F.lit(0).cast("long").alias("__slot"), F.lit("").alias("__file"))
        read = _located(self.spark.read.schema(self.schema).parquet(*files))
        places = self.manifest.select(F.col("file").alias("__f"), F.col("shard").alias("__shard"), "first")
        return read.join(places, F.col("__file") == F.col("__f")).withColumn("__slot", F.col("first") + F.col("__row")).drop("__f", "first", "__row")


def _located(read: DataFrame) -> DataFrame:
    return read.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def _written(rows: DataFrame, path: str, shard: str) -> None:
    rows.write.partitionBy(shard).option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def _measured(spark: SparkSession, path: str, schema, size: str, shard: str) -> DataFrame:
    """(shard, file, rows, bytes) of the files below `path`, from the sizes alone."""
    found = spark.read.schema(f"`{size}` long, `{shard}` int").parquet(path)
    return found.groupBy(F.col(shard).alias("shard"), F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))


def _manifest(files: DataFrame) -> DataFrame:
    """Written files, with the shard's rows before each."""
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return written(files.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))), "manifest")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def layout(docs: DataFrame, shard: Column, path: str, text_col: str = "text") -> Layout:
    """Writes `docs` in files by `shard` (an int). Rows are not shuffled: each task writes its own of each shard."""
    spark, size = docs.sparkSession, free_name(docs, "size_bytes")
    rows = docs.withColumn(size, size_of(F.col(f"`{text_col}`")))
    name = free_name(rows, "shard")
    _written(rows.withColumn(name, shard.cast("int")), path, name)
    return Layout(spark, rows.schema, size, _manifest(_measured(spark, path, rows.schema, size, name).withColumn("moved", F.lit(False))))


def _divided(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of one file, each given to the part that lacks the most bytes, the largest first."""
    lacks = [(-q, d) for d, q in zip(pdf["dests"].iloc[0], pdf["quotas"].iloc[0])]
    heapq.heapify(lacks)
    pdf = pdf.sort_values(["size", "row"], ascending=[False, True])
    out = []
    for n in pdf["size"].tolist():
        q, d = lacks[0]
        out.append(d)
        heapq.heapreplace(lacks, (q + n, d))
    return pd.DataFrame({"file": pdf["file"], "row": pdf["row"], "dest": pd.Series(out, index=pdf.index, dtype="int32")})


def reshard(old: Layout, capacities: dict[int, int], path: str, cost: Callable[[int, int], int] = lambda i, j: int(i != j)) -> Layout:
    """The layout with shards of `capacities` that moves the fewest bytes; new files go below `path`."""
    spark, files = old.spark, old.manifest
    supply = {r[0]: r[1] for r in files.groupBy("shard").agg(F.sum("bytes")).collect()}  # a row a shard
    cuts = []
    flows = least_cost_flow(supply, capacities, cost)
    for i in supply:
        at = 0
        for j in sorted((j for k, j in flows if k == i), key=lambda j: (j != i, j)):
            cuts.append((i, j, at, at + flows[i, j]))
            at += flows[i, j]
    told = spark.createDataFrame(cuts, "__i int, dest int, low long, high long")
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    spans = files.withColumn("from", F.coalesce(F.sum("bytes").over(before), F.lit(0))).withColumn("to", F.col("from") + F.col("bytes"))
    met = spans.join(told, (F.col("shard") == F.col("__i")) & (F.col("low") < F.col("to")) & (F.col("high") > F.col("from")))
    part = F.struct("dest", (F.least("high", "to") - F.greatest("low", "from")).alias("quota"))
    parts = written(met.groupBy("shard", "file", "rows", "bytes").agg(F.array_sort(F.collect_list(part)).alias("parts")), "parts")
    whole = F.size("parts") == 1
    goes = parts.where(whole & (F.col("parts")[0]["dest"] != F.col("shard"))).select(F.col("parts")[0]["dest"].alias("dest"), "file")
    by_dest: dict[int, list[str]] = {}
    for r in goes.collect():  # names of files that go, as above
        by_dest.setdefault(r.dest, []).append(r.file)
    cut = [r[0] for r in parts.where(~whole).select("file").collect()]  # one for each cut at most
    read = lambda names: spark.read.schema(old.schema).parquet(*names)
    name = free_name(spark.createDataFrame([], old.schema), "shard")
    made = [read(names).withColumn(name, F.lit(j)) for j, names in sorted(by_dest.items())]
    if cut:
        sizes = _located(spark.read.schema(f"`{old.size}` long").parquet(*cut)).select(F.col("__file").alias("file"), F.col("__row").alias("row"), F.col(old.size).alias("size"))
        quotas = parts.where(~whole).select(F.col("file").alias("__f"), F.col("parts.dest").alias("dests"), F.col("parts.quota").alias("quotas"))
        given = sizes.join(quotas, F.col("file") == F.col("__f")).drop("__f").groupBy("file").applyInPandas(_divided, "file string, row long, dest int")
        given = given.select(F.col("file").alias("__f"), F.col("row").alias("__r"), F.col("dest").alias(name))
        made.append(_located(read(cut)).join(given, (F.col("__file") == F.col("__f")) & (F.col("__row") == F.col("__r"))).drop("__file", "__row", "__f", "__r"))
    stay = parts.where(whole & (F.col("parts")[0]["dest"] == F.col("shard"))).select("shard", "file", "rows", "bytes", F.lit(False).alias("moved"))
    if not made:
        return Layout(spark, old.schema, old.size, _manifest(stay))
    all_ = made[0]
    for df in made[1:]:
        all_ = all_.unionByName(df)
    _written(all_, path, name)
    return Layout(spark, old.schema, old.size, _manifest(stay.unionByName(_measured(spark, path, old.schema, old.size, name).withColumn("moved", F.lit(True)))))


def even(total: int, shards: int) -> dict[int, int]:
    """Capacities for `total` bytes that are at most one apart."""
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def resharded(docs: DataFrame, shards: int = 8, old_shards: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of documents that lie in `old_shards` by
    their source, uneven as sources are, and are dealt anew to `shards` of the same size; read from the files."""
    spark = docs.sparkSession
    by_source = F.pmod(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(old_shards))
    old = layout(docs, by_source, scratch_path(spark, "layout"), text_col)
    total = old.manifest.agg(F.sum("bytes")).first()[0] or 0
    rows = reshard(old, even(total, shards), scratch_path(spark, "resharded")).rows()
    crc = F.crc32(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))
    return rows.select(F.col(f"`{id_col}`").alias("doc_id"), size_of(F.col(f"`{text_col}`")).alias("size"), crc.alias("text_crc32"), F.lit(LAW).alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
