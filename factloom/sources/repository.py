"""Repositories as tables: scan, inventory, pinned reads, changes, and facts of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import classify
from factloom.functions.identity import derive_id, path_in_scope, set_digest

#: A pinned read gives no more than this.
MAX_SOURCE_BYTES = 16 << 20


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(path, bytes, digest, content, body) of the regular files below `root`, without .git; content is
    text where the bytes are UTF-8. Spark's file sources skip files without a byte, so these are left out.

    The paths are tested by the files' metadata, so a file out of scope is dropped from the listing and
    its bytes are never read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    inner = (base.split(":", 1)[1] if ":" in base.split("/", 1)[0] else base).strip("/")
    # the metadata's name is percent-encoded; what follows the root in it, whatever scheme stands before
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.substr(whole, F.locate(f"/{inner}/", whole) + len(inner) + 2)
    rows = files.where(~path.startswith(".git/") & path_in_scope(path, include, exclude)).select(path.alias("path"), F.col("length").alias("bytes"), F.col("content").alias("body"))
    text = F.try_validate_utf8(F.col("body").cast("string")).isNotNull() | (F.length("body") == 0)
    return rows.select("path", "bytes", F.sha2("body", 256).alias("digest"), F.when(text, "text").otherwise("binary").alias("content"), "body")


#: A classifier: priority, id, and what a path says: axis -> value, evidence as an array or None.
Classifier = tuple[int, str, Callable[[Column], tuple[dict[str, Column], Column | None]]]


def inventory(files: DataFrame, repository: str = "local", wanted: dict[str, list[str] | None] | None = None, classifiers: Iterable[Classifier] = ()) -> DataFrame:
    """Scan rows with source and revision ids, language, owners and the four classification axes, which
    classifiers of the caller's settle before the paths' own do, by falling priority, then id."""
    p = F.col("path")
    axes = {name: rung(p) for name, rung in classify.AXES.items()}
    if classifiers:
        told = [(priority, name, *of(p)) for priority, name, of in classifiers]
        lowest = min(priority for priority, *_ in told) - 1
        axes = classify.merge([*told, (lowest, "path", axes, None)])
    rows = files.select(
        derive_id("source", repository, p).alias("source"), derive_id("source-revision", repository, F.concat(p, F.lit("\n"), F.col("digest"))).alias("revision"),
        "path", "bytes", "digest", "content", classify.language(p, F.col("content")).alias("language"), classify.package(p).alias("package"), classify.area(p).alias("area"),
        *[c.alias(n) for n, c in axes.items()],
    )
    return rows.where(classify.in_scope({n: F.col(n) for n in classify.AXES}, wanted)) if wanted else rows


def manifest_id(rows: DataFrame) -> DataFrame:
    """One row (source_manifest): a digest over all (path, revision), independent of their order."""
    found = set_digest(rows, F.concat_ws("\n", "path", "revision"))
    return found.select(F.concat(F.lit("source-manifest:"), "digest").alias("source_manifest"))


def pinned(requests: DataFrame, rows: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status, reason, text) of requests (path, revision): current, stale, or unavailable as
    not-in-inventory, not-text, too-large or unreadable. The bytes are hashed again before they count."""
    own = rows.select(F.col("path").alias("__p"), F.col("revision").alias("__rev"), F.col("digest").alias("__digest"), "content", "bytes")
    bodies = files.select(F.col("path").alias("__q"), "body")
    met = requests.join(own, F.col("path") == F.col("__p"), "left").join(bodies, F.col("path") == F.col("__q"), "left")
    reason = (
        F.when(F.col("__p").isNull(), "not-in-inventory").when(F.col("content") != "text", "not-text").when(F.col("bytes") > MAX_SOURCE_BYTES, "too-large").when(F.col("body").isNull(), "unreadable")
    )
    stale = (F.sha2("body", 256) != F.col("__digest")) | (F.col("revision").isNotNull() & (F.col("revision") != F.col("__rev")))
    status = F.when(reason.isNotNull(), "unavailable").when(stale, "stale").otherwise("current")
    return met.select("path", status.alias("status"), reason.alias("reason"), F.when(status == "current", F.col("body").cast("string")).alias("text"))


def facts(rows: DataFrame, repository: str = "local") -> DataFrame:
    """One fact for each inventory row, in a single shard of the namespace repository.file."""
    return rows.select(
        F.lit("repository.file").alias("shard_key"), F.lit(None).cast("string").alias("shard_digest"), derive_id("fact", repository, F.concat(F.lit("file\n"), F.col("path"))).alias("fact_id"),
        F.lit("repository.file").alias("namespace"), F.lit(1).alias("schema_version"), F.lit("file").alias("kind"), F.col("source").alias("subject"),
        F.struct(F.lit("complete").alias("kind"), F.array().cast("array<struct<code:string,message:string>>").alias("reasons")).alias("completeness"),
        F.lit("repository.inventory").alias("pass_id"), F.lit("1").alias("pass_version"),
        F.array(F.struct("source", "revision", F.lit(0).cast("bigint").alias("start"), F.col("bytes").cast("bigint").alias("end"))).alias("evidence"),
        F.array().cast("array<string>").alias("inputs"), F.to_json(F.struct("path", "language", "package", "area", *classify.AXES)).alias("payload"),
    )


def changes(*sources: DataFrame) -> DataFrame:
    """(path) of the union of change lists, each once."""
    out = sources[0].select("path")
    for s in sources[1:]:
        out = out.unionByName(s.select("path"))
    return out.distinct()


def coherence(resources: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, code): resources (path, revision) that the inventory lacks or has at another revision."""
    own = rows.select(F.col("path").alias("__p"), F.col("revision").alias("__r"))
    met = resources.join(own, F.col("path") == F.col("__p"), "left")
    code = F.when(F.col("__p").isNull(), "RESOURCE_MISSING").when(F.col("revision") != F.col("__r"), "REVISION_MISMATCH")
    return met.select("path", code.alias("code")).where("code IS NOT NULL")
