"""Working tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where that is unset and the master local (tests, a laptop)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole or not at all; False, with nothing changed, if it is there already.

    The text goes to a file beside it, which is renamed without overwriting, so of two writers one wins.
    """
    jvm = spark.sparkContext._jvm
    hadoop, at, side = jvm.org.apache.hadoop.fs, jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = at.getFileSystem(conf)
    fs.mkdirs(at.getParent())
    out = fs.create(side, False)
    out.write(bytearray(text.encode()))
    out.close()
    keep = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    keep[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(fs.makeQualified(at).toUri(), conf).rename(fs.makeQualified(side), fs.makeQualified(at), keep)
    except Py4JJavaError as e:
        fs.delete(side, False)
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()) or fs.exists(at):
            return False
        raise
    return True


def small_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it isn't there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    read = fs.open(at)
    try:
        return bytes(read.readAllBytes()).decode()
    finally:
        read.close()


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    """A number of partitions of some `each` rows at most, so that a task's memory doesn't grow with a table;
    the session's own number where that is larger."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


class Rounds:
    """Tables of the rounds of a fixpoint, each written once and read by the next."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.name = f"{name}-{uuid.uuid4().hex}"
        self.root = f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}/{self.name}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Writes `df` and returns the written table: no lineage, and no loss with an executor."""
        return self.counted(df)[0]

    def counted(self, df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
        """`put`, and the number of rows, or of those for which `which` holds, counted as they are written."""
        self.n += 1
        path, seen = f"{self.root}/{self.n}", Observation()
        df.observe(seen, F.count_if(F.lit(True) if which is None else which).alias("n")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"]

    def clean(self) -> None:
        """Deletes all tables of these rounds; nothing that is still to be read may come from them."""
        remove(self.spark, self.root)


class Buckets(Rounds):
    """Rounds whose tables lie in `n` buckets of one column. Windows and groups on columns that begin with
    it need no shuffle, nor do joins in the tables' own session: the setting by which a join asks for all
    its columns is another one there, and no one else's. What is put should be dealt by the column already."""

    def __init__(self, spark: SparkSession, name: str, column: str, n: int) -> None:
        super().__init__(spark, name)
        self.column, self.buckets, self.own = column, n, spark.newSession()
        self.places: list[tuple[DataFrame, str]] = []
        self.own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def counted(self, df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
        self.n += 1
        name, seen = f"default.factloom_{uuid.uuid4().hex}", Observation()
        df = df.observe(seen, F.count_if(F.lit(True) if which is None else which).alias("n"))
        df.write.bucketBy(self.buckets, self.column).option("path", f"{self.root}/{self.n}").option("compression", "zstd").format("parquet").saveAsTable(name)
        table = self.own.table(name)
        self.own.sql(f"DROP TABLE {name}")  # the name only; the files are those of these rounds
        self.places.append((table, f"{self.root}/{self.n}"))
        return table, seen.get["n"]

    def free(self, *tables: DataFrame) -> DataFrame:
        """Tables that were put, as one of the caller's session."""
        return self.spark.read.schema(tables[0].schema).parquet(*[at for t, at in self.places if any(t is each for each in tables)])


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder through Hadoop's file system API."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
