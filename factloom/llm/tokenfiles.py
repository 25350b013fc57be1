"""Token ids in Parquet files: a list column in dictionary encoding, bounded row groups, page indexes.

Documents are dealt by ranges of their id, so the files in name order hold ascending ids, and each
task encodes its documents in that order. A row holds the id, the place of its first token among the
file's tokens, the number of tokens and the tokens; the file's number is a column too. Parquet keeps
page indexes of every column, so a reader can take the counts without the ids, or the ids of a range
of documents without the other pages. Offsets among all tokens follow from one total for each file.

With a tokenizer that drops white space and lower-cases as word_bpe_49k.json does, texts are cut at
blanks and line feeds, which it never joins over, and words are encoded once and remembered, in a cache
of bounded size. A word of plain letters and closing marks is pre-split here and merged by the
library's model; any other goes through the library whole. With any other tokenizer whole texts do.

There are as many files as shuffle partitions, and more where a file would take over `file_bytes` of
text on average. Null texts count as empty and have the end id alone. Rows that repeat an id keep one
place each, in the order of their texts' hashes, and may lie in several files. Null ids come first. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm.common import numbered_total, scratch_path, slices

#: Words of each of the two generations that a worker remembers.
CACHE = 300_000
#: Letters of one code point that NFC leaves alone and whose lower case is one such letter, then marks.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*$%&|]*)")


#: What a tokenizer has to do before its merges for words to be taken one by one.
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it: itself where printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder(dict):
    """Word -> its ids as little-endian 32-bit integers; words not met yet are encoded.

    Two generations of up to `cache` words are kept: a full one becomes the old one, and words of the
    old one that come again move to the new one.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_words = all(told.get(k) == v for k, v in SPLITTING.items()) and not any(" " in t["content"] or "\n" in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"])
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.cache, self.old = cache, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._encode(word)
        if len(word) <= 40:
            if len(self) >= self.cache:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _encode(self, word: str) -> bytes:
        if not word:
            return b""
        if word.isascii() and word.isalpha():
            letters, marks = word, ""
        elif m := _PLAIN.fullmatch(word):
            letters, marks = m.groups()
        else:
            return array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low = letters.lower()
        if marks:
            return self[low] + self[marks]
        return self[low] if low != word else self._merge(word)

    def _merge(self, piece: str) -> bytes:
        """The library's merges of one piece that needs no more splitting."""
        text = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("i", [t.id for t in self.model.tokenize(text)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids that the library gives for the whole text without special tokens."""
        if not self.by_words:
            return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def write(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2,
    files: int | None = None, file_bytes: int = 1 << 30, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10,
) -> None:
    """Encode `df` into token files under `path`, ascending by id. `files`: their number, if not to be
    taken from the session's shuffle partitions and the size of the texts."""
    spark = df.sparkSession
    model = tokenizer or default_tokenizer()
    n = files
    if not n:
        size = df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / file_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at, part, end = encoder(model), 0, TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        for b in slices(batches):
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            sizes = np.array([len(x) // 4 + 1 for x in ids], np.int64)
            ends = np.cumsum(sizes)
            flat = np.frombuffer(end.join([*ids, b""]), "<i4")
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), b.column(0), pa.array(at + ends - sizes), pa.array(sizes), tokens],
                names=["file", "id", "at", "n_tokens", "tokens"],
            )
            at += int(ends[-1]) if len(ends) else 0

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # texts are second, so that rows without an id or with the same one are dealt out too
    dealt = rows.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    (
        dealt.mapInArrow(run, "file int, id long, at long, n_tokens long, tokens array<int>").write
        .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
        .option("parquet.enable.dictionary", "true").option("parquet.writer.version", "v2").option("compression", "zstd")
        .parquet(path)
    )


SCHEMA = "file int, id long, at long, n_tokens long, tokens array<int>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows (file, id, at, n_tokens, tokens). Reading no tokens reads none of their pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def started(rows: DataFrame, files: DataFrame) -> DataFrame:
    """`rows` with `start`, the tokens of all documents before, in place of file and at; `files`: the
    rows of all files, of which two narrow columns are read."""
    before = numbered_total(files.groupBy("file").agg(F.sum("n_tokens").alias("n")), "file", "n", "base").select(F.col("file").alias("__file"), "base")
    met = rows.join(before, F.col("file") == F.col("__file"))
    return met.select("id", (F.col("base") + F.col("at")).alias("start"), *[c for c in rows.columns if c not in ("id", "file", "at")])


def digests(rows: DataFrame) -> DataFrame:
    """Rows (file, id, at, n_tokens, ids_crc32) of token rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column(3)
            at = tokens.offsets.to_numpy()
            flat = tokens.values.to_numpy(False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[p:q]) for p, q in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "id", "at", "n_tokens", "ids_crc32"])
    return rows.select("file", "id", "at", "tokens").mapInArrow(run, "file int, id long, at long, n_tokens long, ids_crc32 long")


def write_and_read(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes token files of `df` in the shared folder and reads their digests.

    Ids are digested before the files' offsets are joined, so the join moves no ids.
    """
    path = scratch_path(df.sparkSession, "tokens")
    write(df, path, id_col, text_col, tokenizer, end_id)
    rows = read(df.sparkSession, path)
    return started(digests(rows), rows).withColumnRenamed("id", id_col)
