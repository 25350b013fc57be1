"""Content-addressed ids and the path grammar."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Domain that separates our ids from other uses of the hash.
DOMAIN = "factloom.identity"

ID_GRAMMAR = r"^[a-z][a-z0-9-]*:[a-f0-9]{64}$"


def derive_id(kind: str, namespace: str, content: Column) -> Column:
    """kind ":" sha256 over domain, kind, namespace and content, set apart by NUL."""
    nul = F.lit("\0")
    whole = F.concat(F.lit(DOMAIN), nul, F.lit(kind), nul, F.lit(namespace), nul, content)
    return F.concat(F.lit(f"{kind}:"), F.sha2(whole, 256))


def is_id(c: Column) -> Column:
    return c.rlike(ID_GRAMMAR)


def canonical_json(value: object) -> str:
    """JSON with keys in code point order, tagged big integers and dates, and U+2028/9 escaped.

    Fields whose value is None in a dict stay; what should be absent is left out by the caller.
    """

    def plain(v: object) -> object:
        if isinstance(v, bool) or v is None or isinstance(v, (str, float)):
            return v
        if isinstance(v, int):
            return v if abs(v) <= 2**53 - 1 else {"$bigint": str(v)}
        if isinstance(v, (dt.date, dt.datetime)):
            return {"$date": v.isoformat()}
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        raise TypeError(f"no canonical form for {type(v).__name__}")

    text = json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return text.replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def canonical_column(*columns: str) -> Column:
    """Canonical JSON of columns: keys in code point order, nulls kept, U+2028/9 escaped; equal for equal
    values whatever the order of the columns."""
    whole = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return F.replace(F.replace(whole, F.lit("\u2028"), F.lit("\\u2028")), F.lit("\u2029"), F.lit("\\u2029"))


def derive_value_id(kind: str, namespace: str, value: object) -> str:
    """`derive_id` of one value on the driver, by its canonical JSON."""
    return f"{kind}:{hashlib.sha256(chr(0).join([DOMAIN, kind, namespace, canonical_json(value)]).encode()).hexdigest()}"


def snapshot_set_id(inventory: str, generations: dict[str, str]) -> str:
    """The id of pinned generations, universe -> generation, over one inventory."""
    return derive_value_id("snapshot-set", "snapshots", {"inventory": inventory, "generations": generations})


def qualification_id(spec: str, analysis: str, scope: str, results: list[tuple[str, str]]) -> str:
    """The id of a specification's results, (rule, status) in any order, against one analysis."""
    return derive_value_id("qualification", "results", {"spec": spec, "analysis": analysis, "scope": scope, "results": sorted(results)})


def json_pointer(parts: Column) -> Column:
    """A JSON pointer of an array of keys; the empty array is the whole document."""
    escaped = F.transform(parts, lambda p: F.concat(F.lit("/"), F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))))
    return F.array_join(escaped, "")


def portable_path(path: Column) -> Column:
    """True for a relative POSIX path that doesn't leave its root; "." and empty segments are normal."""
    segments = F.split(path, "/")
    return (
        path.isNotNull()
        & (F.length(path) > 0)
        & ~path.startswith("/")
        & ~path.contains("\\")
        & ~path.contains("\0")
        & ~path.rlike("^[A-Za-z]:")
        & (F.size(F.filter(segments, lambda s: s == "..")) == 0)
    )


def canonical_path(path: Column) -> Column:
    """True for a portable path that needs no normalisation at all."""
    return portable_path(path) & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))


def encode_cursor(**fields: object) -> str:
    return base64.urlsafe_b64encode(canonical_json(fields).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError:
        raise ValueError("the cursor is invalid or stale") from None
    if not isinstance(found, dict):
        raise ValueError("the cursor is invalid or stale")
    return found


def glob_regex(pattern: str) -> str:
    """A Java regular expression for a glob: * and ? within a segment, ** across, [..] and {a,b}."""
    out, i, braces = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            braces += 1
        elif c == "}" and braces:
            out.append(")")
            braces -= 1
        elif c == "," and braces:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def path_in_scope(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Included by any pattern (all if there is none) and excluded by no pattern."""
    keep = F.lit(True)
    if include:
        keep = F.lit(False)
        for p in include:
            keep = keep | path.rlike(glob_regex(p))
    for p in exclude or []:
        keep = keep & ~path.rlike(glob_regex(p))
    return keep


def ancestors(path: Column, itself: bool = True) -> Column:
    """The path's parent directories, deepest last, and the path itself if wanted."""
    segments = F.split(path, "/")
    upto = F.size(segments) if itself else F.size(segments) - 1
    return F.when(upto >= 1, F.transform(F.sequence(F.lit(1), upto), lambda n: F.array_join(F.slice(segments, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def set_digest(rows: DataFrame, line: Column, out: str = "digest") -> DataFrame:
    """One row (out): a digest over the lines of all rows, whatever their order.

    Lines are hashed, and hashes of one beginning are sorted and hashed together, in levels of 4, 2 and
    0 letters, so no task holds more than its share of a large table.
    """
    level = rows.select(F.sha2(line, 256).alias("h"))
    for letters in (4, 2, 0):
        key = F.substring("h", 1, letters) if letters else F.lit("")
        level = level.groupBy(key.alias("k")).agg(F.concat("k", F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256)).alias("h")).select("h")
    return level.select(F.col("h").alias(out))
