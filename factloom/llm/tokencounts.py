"""Token counts in delta-maintained rollups.

A rollup keeps, in a folder, for each committed batch the changes of single documents (its state)
and their effect on the totals (its delta): signed numbers of documents and tokens by source,
language and tokenizer version. An insert adds, a delete takes away what the state held, a revised
count takes that away and adds the new one, so totals are sums of deltas and texts are never counted
again.

A batch counts from the moment its commit file, written whole and only once, names the folder of its
data: one that is sent again changes nothing, one whose writer was lost before is done anew, of two
writers of a batch one wins. Batches come by rising numbers; one below the last that isn't committed
is refused, since its effect would depend on later ones.

State lies in folders by a hash of the document's id. A batch reads only the folders that its own
documents fall in, of the last snapshot and the batches after it; every `compact_after` batches the
state is drawn together in a new snapshot, so a batch's cost doesn't grow with the number of batches.

A change is (doc_id, tokenizer, op, source, lang, n_tokens, seq): op is insert, revise or delete; an
insert of a known document revises it, a revision of an unknown one inserts it, a delete of an
unknown one does nothing. Of several changes to one document and tokenizer in a batch the highest
seq counts, of those the most tokens. Null sources and languages are keys of their own; changes with
a null doc_id or tokenizer can't be revised later and are rejected by a filter; null counts are 0.
Empty batches commit and add nothing. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bytebpe, tokenfiles
from factloom.llm.common import per_text, scratch_path, written
from factloom.sources.tables import publish, small_text

KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
_STATE = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean, batch long, bucket int"
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Folders that the state is dealt to by document.
BUCKETS = 64


class BatchLate(ValueError):
    """A batch that comes after one with a higher number."""


def _latest(state: DataFrame) -> DataFrame:
    """Rows (KEY, s): each document's last state."""
    return state.groupBy(*KEY).agg(F.max(F.struct("batch", "source", "lang", "n_tokens", "alive")).alias("s"))


class TokenRollup:
    """The rollup in `root`, a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, compact_after: int = 8, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.compact_after, self.buckets = spark, root.rstrip("/"), compact_after, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self, folder: str) -> dict[int, str]:
        """Number -> folder of its data, of the files in `folder`."""
        at = self._path(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return {int(n): f"{self.root}/data/{small_text(self.spark, f'{self.root}/{folder}/{n}')}" for n in sorted(names) if n.isdigit()}

    def commits(self) -> dict[int, str]:
        """Batch -> folder of its data."""
        return self._named("commits")

    def _since(self) -> tuple[str | None, list[str]]:
        """The folder of the last snapshot, and those of the batches after it."""
        snapshots = self._named("snapshots")
        upto = max(snapshots, default=None)
        return snapshots.get(upto), [d for b, d in self.commits().items() if upto is None or b > upto]

    def _state(self, buckets: list[int] | None = None) -> DataFrame:
        """The state since the last snapshot, in whole or in some buckets only."""
        snapshot, later = self._since()
        out = self.spark.createDataFrame([], _STATE)
        for folder in ([snapshot] if snapshot else []) + later:
            if self._fs.exists(self._path(f"{folder}/state")):
                out = out.unionByName(self.spark.read.schema(_STATE).parquet(f"{folder}/state"))
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def _put(self, state: DataFrame, path: str) -> None:
        """Writes state to its buckets' folders, by as many tasks as a shuffle has, at least one a bucket."""
        spread = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        state.repartition("bucket", F.pmod(F.shiftright(F.xxhash64("doc_id"), 32), F.lit(spread))).write.partitionBy("bucket").parquet(path)

    def _bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commits a batch; False, with nothing changed, if it is committed already; BatchLate if a later one is."""
        known = self.commits()
        if batch in known:
            return False
        if known and batch < max(known):
            raise BatchLate(f"batch {batch} comes after batch {max(known)}")
        good = changes.where(F.col("doc_id").isNotNull() & F.col("tokenizer").isNotNull()).select(
            F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", "op", "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.coalesce("seq", F.lit(0)).alias("seq")
        )
        new = good.groupBy(*KEY).agg(F.max(F.struct("seq", "n_tokens", "op", "source", "lang")).alias("c")).select(*KEY, "c.op", "c.source", "c.lang", "c.n_tokens", self._bucket())
        attempt = f"{batch}-{uuid.uuid4().hex}"
        at = f"{self.root}/data/{attempt}"
        if known:
            # written, since it is read for its buckets and again for its rows; the buckets are few
            new.write.parquet(f"{at}/changes")
            new = self.spark.read.schema(new.schema).parquet(f"{at}/changes")
            touched = [r[0] for r in new.select("bucket").distinct().collect()]
            old = _latest(self._state(touched)).where("s.alive")
        else:
            old = _latest(self.spark.createDataFrame([], _STATE))
        old = old.select(F.col("doc_id").alias("__d"), F.col("tokenizer").alias("__t"), F.col("s.source").alias("old_source"), F.col("s.lang").alias("old_lang"), F.col("s.n_tokens").alias("old_tokens"), F.lit(True).alias("known"))
        met = new.join(old, (F.col("doc_id") == F.col("__d")) & (F.col("tokenizer") == F.col("__t")), "left").drop("__d", "__t")
        gone = F.col("op") == "delete"
        effect = met.where(~gone | F.col("known"))
        effect = effect.select(*KEY, "source", "lang", "n_tokens", (~gone).alias("alive"), F.lit(batch).cast("long").alias("batch"), "known", "old_source", "old_lang", "old_tokens", "bucket")
        self._put(effect, f"{at}/state")
        made = self.spark.read.schema(effect.schema).parquet(f"{at}/state")
        signed = F.array(
            F.when(F.col("alive"), F.struct("source", "lang", "tokenizer", F.lit(1).alias("d"), F.col("n_tokens").alias("n"))),
            F.when(F.col("known"), F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "tokenizer", F.lit(-1).alias("d"), (-F.col("old_tokens")).alias("n"))),
        )
        delta = made.select(F.explode(F.filter(signed, lambda x: x.isNotNull())).alias("x")).select("x.*")
        delta.groupBy(*GROUP).agg(F.sum("d").alias("n_docs"), F.sum("n").alias("n_tokens")).write.parquet(f"{at}/delta")
        if not publish(self.spark, f"{self.root}/commits/{batch}", attempt):
            return False
        if len(self._since()[1]) >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> None:
        """Draws state and deltas up to the last batch together in a snapshot. Batches' own folders stay
        until their owner removes them; nothing reads those that a snapshot holds."""
        upto = max(self.commits(), default=None)
        if upto is None or upto in self._named("snapshots"):
            return
        attempt = f"snapshot-{upto}-{uuid.uuid4().hex}"
        at = f"{self.root}/data/{attempt}"
        kept = _latest(self._state()).where("s.alive").select(*KEY, "s.source", "s.lang", "s.n_tokens", "s.alive", "s.batch", self._bucket())
        self._put(kept, f"{at}/state")
        self.totals().write.parquet(f"{at}/delta")
        publish(self.spark, f"{self.root}/snapshots/{upto}", attempt)

    def totals(self) -> DataFrame:
        """Rows (source, lang, tokenizer, n_docs, n_tokens) of keys that hold a document."""
        snapshot, later = self._since()
        paths = [f"{d}/delta" for d in ([snapshot] if snapshot else []) + later]
        rows = self.spark.read.schema(_DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTA)
        sums = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where(F.col("n_docs") != 0)


#: Tokenizer versions of the query, by the file that each one reads.
WORDS, BYTES = "word_bpe_49k", "byte_bpe_multi_50k"
SIGNS = "#*$%&|<>"


def counted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Rows (id, also..., words, bytes, clean_words, clean_bytes): numbers of tokens of whole texts by both
    tokenizers; where a text holds signs, those of the text without them as well, else null."""
    words, ranks, pattern = tokenfiles.default_tokenizer(), bytebpe.default_ranks(), public_tokenizers.PATTERN
    bare = str.maketrans("", "", SIGNS)

    def both(text: str) -> tuple[int, int]:
        return len(tokenfiles.encoder(words).encode(text)) // 4, len(bytebpe.encode(text, ranks, pattern))

    def of(text: str) -> tuple[int | None, ...]:
        clean = text.translate(bare)
        return *both(text), *(both(clean) if len(clean) < len(text) else (None, None))

    names = ["words", "bytes", "clean_words", "clean_bytes"]
    return per_text(documents, text_col, [id_col, *also], pa.schema([(n, pa.int64()) for n in names]), ", ".join(f"{n} long" for n in names), of)


#: Equal rows that one task numbers.
BLOCK = 10_000


def history(documents: DataFrame, labels: DataFrame) -> list[tuple[int, DataFrame]]:
    """Batches over whole tables: all documents' tokens by one tokenizer and by another, those with signs
    counted anew without them, and those labelled poor deleted.

    A change's doc_id is the row's: the document's id, or, where that is null or repeated, a hash of the
    row's columns and its number among equal ones, so that every row counts; rows without an id are never
    deleted."""
    rows = written(counted(documents), "counts")
    repeated = rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__d")).count().where("count > 1").select("__d")
    alone = rows.where("doc_id IS NOT NULL").join(repeated, F.col("doc_id") == F.col("__d"), "left_anti").withColumn("key", F.col("doc_id").cast("long"))
    others = rows.join(repeated, F.col("doc_id") == F.col("__d"), "left_semi").unionByName(rows.where("doc_id IS NULL"))
    # equal rows are counted and then numbered in blocks, so that a crowd of them is dealt over tasks
    held = others.groupBy(*rows.columns).agg(F.count("*").alias("__k"))
    blocks = held.withColumn("__from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__k"), F.lit(BLOCK).cast("long"))))
    blocks = blocks.repartition(F.xxhash64(*rows.columns), "__from")
    number = F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + BLOCK - 1, F.col("__k")))).alias("__n")
    # null columns don't change a hash, so their places are hashed too
    nulls = F.array(*[F.col(c).isNull() for c in rows.columns])
    numbered = blocks.select(*rows.columns, number).withColumn("key", F.xxhash64(F.lit("row"), nulls, *rows.columns, F.col("__n").cast("int"))).drop("__n")
    keyed = written(alone.unionByName(numbered), "keyed_counts")
    change = lambda df, op, tokenizer, n: df.select(F.col("key").alias("doc_id"), F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), "source", "lang", n.alias("n_tokens"), F.lit(0).alias("seq"))
    poor = labels.where("quality = 0").select(F.col("doc_id").alias("__poor")).distinct()
    gone = keyed.join(poor, F.col("doc_id") == F.col("__poor"), "left_semi").withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    signed, zero = keyed.where("clean_words IS NOT NULL"), F.lit(0)
    return [
        (1, change(keyed, "insert", WORDS, F.col("words"))),
        (2, change(keyed, "insert", BYTES, F.col("bytes"))),
        (3, change(signed, "revise", WORDS, F.col("clean_words")).unionByName(change(signed, "revise", BYTES, F.col("clean_bytes")))),
        (4, change(gone, "delete", WORDS, zero).unionByName(change(gone, "delete", BYTES, zero))),
    ]


def maintained(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The totals after `history`, with every batch sent twice."""
    spark = documents.sparkSession
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    for batch, changes in history(documents, labels):
        rollup.apply(batch, changes)
        rollup.apply(batch, changes)
    return rollup.totals()
