"""Transactions that come as frames: bodies in chunks, put together by sequence and checked against what was announced.

Frames (FRAMES) of a transaction are taken in the order in which they stand. Each frame is judged by a
ladder of refusals against what came before it, all in one window over a transaction's frames without
their data; the first refusal counts. Only transactions without one are put together, each in one row,
whose size the limits bound, and checked by digest and content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: at: the frame's place; kind: start, chunk, end, or any other, which is a whole answer; of start and end:
#: what is announced; of chunk: its place and base64 data; size: bytes of the frame's line.
FRAMES = "id long, at long, kind string, payload string, bytes long, chunks long, sha256 string, sequence long, data string, size long"

MAX_FRAME_BYTES = 64 << 20
MAX_TRANSACTION_BYTES = 512 << 20


def _decoded(data: Column) -> Column:
    """The bytes of canonical base64, else null."""
    raw = F.try_to_binary(data, F.lit("base64"))
    return F.when(F.regexp_replace(F.base64(raw), "[\r\n]", "") == data, raw)


def _judged(frames: DataFrame, max_frame: int, max_bytes: int) -> DataFrame:
    """(id, at, code): each frame with its refusal, null if it has none."""
    part = F.octet_length(_decoded(F.col("data")))
    kind = F.col("kind")
    rows = frames.select("id", "at", "kind", "payload", "bytes", "chunks", "sha256", "sequence", "size", F.when(kind == "chunk", part).alias("part"))
    before = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    said = lambda c: F.first(F.when(kind == "start", F.col(c)), ignorenulls=True).over(before)
    count = lambda k: F.coalesce(F.count_if(kind == k).over(before), F.lit(0))
    rows = rows.select(
        "*", count("start").alias("starts"), count("chunk").alias("got"), count("end").alias("ends"), F.coalesce(F.count_if(~kind.isin("start", "chunk", "end")).over(before), F.lit(0)).alias("answers"), F.coalesce(F.sum("part").over(before), F.lit(0)).alias("held"),
        *[said(c).alias(f"said_{c}") for c in ("payload", "bytes", "chunks", "sha256")],
    )
    start, chunk, end, active = kind == "start", kind == "chunk", kind == "end", F.col("starts") > 0
    differs = ~(F.col("payload").eqNullSafe(F.col("said_payload")) & F.col("bytes").eqNullSafe(F.col("said_bytes")) & F.col("chunks").eqNullSafe(F.col("said_chunks")) & F.col("sha256").eqNullSafe(F.col("said_sha256")))
    ladder = [
        (F.col("size") > max_frame, "FRAME_TOO_LARGE"), ((F.col("ends") > 0) | (F.col("answers") > 0), "FRAME_UNEXPECTED"),
        (start & active, "TRANSACTION_ACTIVE"), (start & (F.col("bytes") > max_bytes), "TRANSACTION_TOO_LARGE"), (start & (F.col("chunks") > F.col("bytes")), "CHUNKS_EXCEED_BYTES"),
        (start & (F.col("bytes").isNull() | F.col("chunks").isNull() | ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)) | ~F.coalesce(F.col("payload").isin("transaction", "delta"), F.lit(False))), "START_INVALID"),
        (chunk & ~active, "CHUNK_BEFORE_START"), (chunk & (F.col("got") >= F.col("said_chunks")), "CHUNK_UNANNOUNCED"), (chunk & ~F.col("sequence").eqNullSafe(F.col("got")), "CHUNK_ORDER"),
        (chunk & F.col("part").isNull(), "CHUNK_ENCODING"), (chunk & (F.col("part") < 1), "CHUNK_EMPTY"), (chunk & (F.col("held") + F.col("part") > F.col("said_bytes")), "BYTES_EXCEEDED"),
        (end & ~active, "END_BEFORE_START"), (end & differs, "END_MISMATCH"), (end & (F.col("got") != F.col("said_chunks")), "CHUNKS_MISSING"), (end & (F.col("held") != F.col("said_bytes")), "BYTES_MISSING"),
        (~start & ~chunk & ~end & active, "TRANSACTION_INTERRUPTED"),
    ]
    code = F.lit(None).cast("string")
    for holds, name in reversed(ladder):
        code = F.when(holds, name).otherwise(code)
    return rows.select("id", "at", "kind", code.alias("code"))


def assembled(frames: DataFrame, max_frame: int = MAX_FRAME_BYTES, max_bytes: int = MAX_TRANSACTION_BYTES) -> DataFrame:
    """(id, payload, code, body): each transaction's JSON text, or the code of the first refusal: one of its
    frames', TRANSACTION_UNFINISHED without an end, DIGEST_INVALID, BODY_INVALID for what isn't a JSON object.
    An answer without a transaction has no row."""
    judged = _judged(frames, max_frame, max_bytes)
    per = judged.groupBy("id").agg(F.min(F.when(F.col("code").isNotNull(), F.struct("at", "code"))).alias("bad"), F.max(F.col("kind") == "end").alias("ended"), F.max(F.col("kind").isin("start", "chunk", "end")).alias("any"))
    per = per.where("any").select(F.col("id").alias("__t"), F.coalesce("bad.code", F.when(~F.col("ended"), F.lit("TRANSACTION_UNFINISHED"))).alias("code"))
    sound = per.where("code IS NULL").select("__t")
    parts = frames.join(sound, F.col("id") == F.col("__t"), "left_semi").where("kind IN ('start', 'chunk')")
    told = F.when(F.col("kind") == "chunk", F.struct("sequence", F.hex(_decoded(F.col("data"))).alias("h")))
    whole = parts.groupBy("id").agg(F.max(F.when(F.col("kind") == "start", F.col("payload"))).alias("payload"), F.max(F.when(F.col("kind") == "start", F.col("sha256"))).alias("sha256"), F.array_sort(F.collect_list(told)).alias("x"))
    raw = whole.select("id", "payload", "sha256", F.unhex(F.array_join(F.transform("x", lambda c: c["h"]), "")).alias("raw"))
    text = F.try_validate_utf8(F.col("raw"))
    fits = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    checked = raw.select("id", "payload", F.when(F.sha2("raw", 256) != F.col("sha256"), "DIGEST_INVALID").when(~fits, "BODY_INVALID").alias("late"), text.alias("text"))
    met = per.join(checked, F.col("__t") == F.col("id"), "left")
    code = F.coalesce("code", "late")
    return met.select(F.col("__t").alias("id"), "payload", code.alias("code"), F.when(code.isNull(), F.col("text")).alias("body"))
