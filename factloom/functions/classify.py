"""Classification of repository paths along four axes, languages and owners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns that classification results depend on.
CODE = r"\.(?:[cm]?[jt]sx?|go|rs|py|java|kt|swift|rb|php|cs|c|cc|cpp|h|hpp)$"
PURPOSES = [
    ("specification", r"(^|/)\.spec/"),
    ("fixture", r"(^|/)(?:fixtures?|testdata)(/|$)"),
    ("test", r"(^|/)(?:__tests__|tests?)(/|$)|\.(?:test|spec)\.[cm]?[jt]sx?$"),
    ("test-support", r"(^|/)(?:test-support|testing)(/|$)"),
    ("evidence", r"(^|/)(?:evidence|qualification|benchmarks?)(/|$)"),
    ("implementation", CODE),
]
PROVENANCE = [
    ("vendored", r"(^|/)(?:node_modules|vendor|third_party)(/|$)"),
    ("generated", r"(^|/)(?:dist|build|coverage|generated|\.cache)(/|$)|\.(?:generated|gen)\.[cm]?[jt]sx?$"),
]
LIFECYCLE = [("historical", r"(^|/)(?:\.history|history|archive)(/|$)"), ("deprecated", r"(^|/)(?:deprecated|legacy)(/|$)")]
DELIVERY = [
    ("documentation", r"(^|/)(?:docs?|website)(/|$)|\.mdx?$"),
    ("build", r"(^|/)(?:scripts?|build|dist)(/|$)"),
    ("development", r"(^|/)(?:__tests__|tests?|fixtures?|dev|\.github)(/|$)"),
    ("runtime", CODE),
]
TEXT_LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".go": "go", ".rs": "rust", ".py": "python", ".json": "json", ".md": "markdown",
    ".mdx": "markdown", ".yaml": "yaml", ".yml": "yaml", ".sql": "sql", ".svg": "svg",
}
BINARY_LANGUAGES = {
    ".png": "image", ".jpg": "image", ".jpeg": "image", ".gif": "image", ".webp": "image", ".ico": "image", ".pdf": "document",
    ".zip": "archive", ".gz": "archive", ".tgz": "archive", ".tar": "archive", ".woff": "font", ".woff2": "font", ".ttf": "font", ".otf": "font",
}

PRESENTATIONS = {
    "markdown": ["md"], "pdf": ["pdf"], "image": ["png", "jpg", "jpeg", "gif", "webp", "svg"],
    "text": ["ts", "tsx", "js", "jsx", "json", "yaml", "yml", "txt", "css", "html", "xml"],
}
MEDIA_TYPES = {"md": "text/markdown", "pdf": "application/pdf", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "json": "application/json"}


def _ladder(path: Column, rungs: list[tuple[str, str]], last: str) -> Column:
    """The first rung whose pattern the lower-cased path has."""
    low = F.lower(path)
    out = None
    for name, pattern in rungs:
        hit = low.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(last)


def purpose(path: Column) -> Column:
    return _ladder(path, PURPOSES, "unknown")


def provenance(path: Column) -> Column:
    return _ladder(path, PROVENANCE, "authored")


def lifecycle(path: Column) -> Column:
    return _ladder(path, LIFECYCLE, "active")


def delivery(path: Column) -> Column:
    return _ladder(path, DELIVERY, "unknown")


AXES = {"purpose": purpose, "provenance": provenance, "lifecycle": lifecycle, "delivery": delivery}


def merge(candidates: list[tuple[int, str, dict[str, Column], Column | None]]) -> dict[str, Column]:
    """Joins classifiers (priority, id, axis -> value, evidence): by falling priority, then id, the
    first value of each axis that is known; evidence is the sorted union."""
    order = sorted(candidates, key=lambda c: (-c[0], c[1]))
    out = {}
    for axis in AXES:
        known = [F.nullif(c[2][axis], F.lit("unknown")) for c in order if axis in c[2]]
        out[axis] = F.coalesce(*known, F.lit("unknown")) if known else F.lit("unknown")
    evidence = [c[3] for c in order if c[3] is not None]
    out["evidence"] = F.array_sort(F.array_distinct(F.concat(*evidence))) if evidence else F.array().cast("array<string>")
    return out


def language(path: Column, content: Column) -> Column:
    """By extension; `content` is "text" or "binary"."""
    base = F.element_at(F.split(path, "/"), -1)
    extension = F.lower(F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_extract(base, r"(\.[^.]*)$", 1)).otherwise(""))

    def pick(names: dict[str, str], last: str) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), extension), F.lit(last))

    return F.when(content == "binary", pick(BINARY_LANGUAGES, "binary")).otherwise(pick(TEXT_LANGUAGES, "unknown"))


def package(path: Column) -> Column:
    """packages/<name> or packages/@scope/<name>; null elsewhere."""
    s = F.split(path, "/")
    second, third = F.nullif(F.get(s, F.lit(1)), F.lit("")), F.nullif(F.get(s, F.lit(2)), F.lit(""))
    scoped = second.startswith("@") & third.isNotNull()
    return F.when(F.get(s, F.lit(0)) == "packages", F.when(scoped, F.concat(second, F.lit("/"), third)).otherwise(second))


def area(path: Column) -> Column:
    """The first segment of a path that has more than one."""
    s = F.split(path, "/")
    return F.when(F.size(s) > 1, F.nullif(F.get(s, F.lit(0)), F.lit("")))


def in_scope(values: dict[str, Column], wanted: dict[str, list[str] | None]) -> Column:
    """IN-lists over the axes, all of which must hold; None is no constraint, an empty list matches nothing."""
    keep = F.lit(True)
    for axis, names in wanted.items():
        if names is not None:
            keep = keep & (values[axis].isin(names) if names else F.lit(False))
    return keep


def _extension(path: Column) -> Column:
    """What follows the last dot, or the whole path without one, in lower case."""
    return F.lower(F.substring_index(path, ".", -1))


def presentation(path: Column) -> Column:
    """How a file is shown: markdown, pdf, image, text or binary."""
    pairs = [F.lit(x) for name, endings in PRESENTATIONS.items() for e in endings for x in (e, name)]
    return F.coalesce(F.element_at(F.create_map(*pairs), _extension(path)), F.lit("binary"))


def media_type(path: Column) -> Column:
    pairs = [F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), _extension(path)), F.when(presentation(path) == "text", "text/plain").otherwise("application/octet-stream"))
