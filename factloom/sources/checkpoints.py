"""Checkpoints: named tables with a manifest, restored only if all of it fits, else missed for a reason."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.identity import canonical_json, set_digest
from factloom.sources.tables import publish, small_text

#: Why a restore misses.
MISSES = ("absent", "unreadable", "format", "key", "schema", "rows", "digest", "blob-absent", "blob-unreadable")
FORMAT = 1


class Miss(Exception):
    def __init__(self, reason: str) -> None:
        super().__init__(reason)
        self.reason = reason


class Checkpoints:
    """Checkpoints below a folder of any file system that Spark reaches. A save writes its tables to new
    folders and a numbered manifest last, whole and only once; the highest counts. A miss means that the
    tables are to be made again. At most `most` scopes and `most_bytes` of them are kept, the newest."""

    def __init__(self, spark: SparkSession, root: str, most: int = 32, most_bytes: int = 256 << 20) -> None:
        self.spark, self.root, self.most, self.most_bytes = spark, root.rstrip("/"), most, most_bytes
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, scope: str) -> str:
        return f"{self.root}/{hashlib.sha256(scope.encode()).hexdigest()[:24]}"

    def _manifests(self, at: str) -> list[int]:
        """Numbers of a scope's manifests."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(at))] if self._fs.exists(self._path(at)) else []
        return sorted(int(n.split("-")[1]) for n in names if n.startswith("manifest-") and n.split("-")[1].isdigit())

    def _digest(self, df: DataFrame) -> str:
        found = set_digest(df, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).first()
        return found[0] if found else ""

    def attempt(self, scope: str) -> str:
        """The folder of a scope's last save."""
        at = self._at(scope)
        return json.loads(small_text(self.spark, f"{at}/manifest-{self._manifests(at)[-1]}"))["attempt"]

    def save(self, scope: str, key: dict, tables: dict[str, DataFrame]) -> None:
        at, attempt, found = self._at(scope), uuid.uuid4().hex, {}
        for name, df in sorted(tables.items()):
            df.write.parquet(f"{at}/{attempt}/{name}")
            back = self.spark.read.schema(df.schema).parquet(f"{at}/{attempt}/{name}")
            found[name] = {"schema": df.schema.json(), "rows": back.count(), "digest": self._digest(back)}
        text = json.dumps({"format": FORMAT, "key": canonical_json(key), "attempt": attempt, "tables": found})
        while not publish(self.spark, f"{at}/manifest-{max(self._manifests(at), default=0) + 1}", text):
            pass  # another writer took the number: this save comes after it
        last = max(self._manifests(at))
        for s in self._fs.listStatus(self._path(at)):
            name = s.getPath().getName()
            if (s.isDirectory() and name != attempt) or (name.startswith("manifest-") and name != f"manifest-{last}"):
                self._fs.delete(s.getPath(), True)
        self.prune()

    def restore(self, scope: str, key: dict) -> dict[str, DataFrame]:
        at = self._at(scope)
        known = self._manifests(at)
        if not known:
            raise Miss("absent")
        try:
            found = json.loads(small_text(self.spark, f"{at}/manifest-{known[-1]}"))
            form, attempt, tables = found["format"], found["attempt"], found["tables"]
        except (ValueError, KeyError, TypeError):
            raise Miss("unreadable") from None
        if form != FORMAT:
            raise Miss("format")
        if found["key"] != canonical_json(key):
            raise Miss("key")
        out = {}
        for name, t in tables.items():
            path = f"{at}/{attempt}/{name}"
            if not self._fs.exists(self._path(path)):
                raise Miss("blob-absent")
            try:
                df = self.spark.read.parquet(path)
                rows = df.count()
            except Exception:
                raise Miss("blob-unreadable") from None
            if json.loads(df.schema.json()) != json.loads(t["schema"]):
                raise Miss("schema")
            if rows != t["rows"]:
                raise Miss("rows")
            if self._digest(df) != t.get("digest"):
                raise Miss("digest")
            out[name] = df
        return out

    def prune(self) -> None:
        """Keeps the scopes saved last, up to their number and bytes."""
        held = [(s.getModificationTime(), s.getPath()) for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory()]
        kept, size = 0, 0
        for _, p in sorted(held, key=lambda x: (x[0], x[1].toString()), reverse=True):
            size += self._fs.getContentSummary(p).getLength()
            if kept >= self.most or (kept and size > self.most_bytes):
                self._fs.delete(p, True)
            else:
                kept += 1
