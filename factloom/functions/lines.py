"""Line metrics of source texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BREAK = r"\r\n|\r|\n"


def physical_lines(text: Column) -> Column:
    """Breaks are CRLF, CR and LF; a break at the end adds no line; an empty text has none."""
    breaks = F.regexp_count(text, F.lit(_BREAK))
    return F.when(F.length(text) == 0, 0).otherwise(breaks + F.when(text.rlike(r"[\r\n]\z"), 0).otherwise(1)).cast("long")


def split_lines(text: Column) -> Column:
    """The physical lines themselves."""
    lines = F.split(text, _BREAK, -1)
    whole = F.when(text.rlike(r"[\r\n]\z"), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(whole)


def blank_lines(text: Column) -> Column:
    return F.size(F.filter(split_lines(text), lambda x: x.rlike(r"\A[\s\p{Z}\uFEFF]*\z"))).cast("long")


def text_metrics(text: Column) -> Column:
    """struct(physical, code, comment, blank, unclassified) of a text without a scanner of its own."""
    physical, blank, zero = physical_lines(text), blank_lines(text), F.lit(0).cast("long")
    return F.struct(physical.alias("physical"), zero.alias("code"), zero.alias("comment"), blank.alias("blank"), (physical - blank).alias("unclassified"))


#: What a scan steps over at once. A slash opens a regular expression where no value stands before it.
_TOKEN = re.compile(
    r"""(?P<space>[^\S\n]+) | (?P<line>\n) | (?P<rest>//[^\n]*) | (?P<block>/\*.*?(?:\*/|\Z))
      | (?P<string>'(?:\\.|[^'\\\n])*'? | "(?:\\.|[^"\\\n])*"?) | (?P<template>`) | (?P<open>\{) | (?P<close>\})
      | (?P<word>[\w$]+) | (?P<slash>/) | (?P<value>[)\]]) | (?P<sign>.)""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
#: A template's text up to its end or to the code within it.
_TEMPLATE = re.compile(r"(?:\\.|(?!\$\{)[^`\\])*(?P<end>`|\$\{|\Z)", re.S)
#: Words after which a value is awaited, so that a slash can't divide.
_BEFORE_VALUE = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())


def scan_curly(text: str) -> tuple[int, int, int, int]:
    """(physical, code, comment, blank) of a text with // and /* */ comments, strings, regular
    expressions and templates, which may hold code that holds templates.

    A line that has code counts as code, also if a comment is on it.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text:
        return 0, 0, 0, 0
    code, comment = set(), set()
    line, at, value = 0, 0, False
    depth: list[int] = []  # braces open inside each template's code, the innermost last

    def over(token: str, lines: set[int]) -> None:
        """Counts the lines that a token lies on, a break at its end left out, and steps over it."""
        nonlocal line
        lines.update(range(line, line + token[:-1].count("\n") + 1))
        line += token.count("\n")

    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, token = m.lastgroup, m[0]
        at = m.end()
        if kind == "line":
            line += 1
            continue
        if kind == "space":
            continue
        if kind in ("rest", "block"):
            over(token, comment)
            continue
        if kind == "slash" and not value and (r := _REGEX.match(text, at - 1)):
            at, kind = r.end(), "string"
        code.add(line)
        if kind == "open" and depth:
            depth[-1] += 1
        if kind == "close" and depth and depth[-1]:
            depth[-1] -= 1
        elif kind == "template" or kind == "close" and depth:
            if kind == "close":
                depth.pop()
            body = _TEMPLATE.match(text, at)
            over(body[0], code)
            at = body.end()
            if body["end"] == "${":
                depth.append(0)
                value = False
                continue
            kind = "string"
        elif kind == "string":
            over(token, code)
        value = kind in ("string", "value", "close") or kind == "word" and token not in _BEFORE_VALUE
    n = text.count("\n") + (not text.endswith("\n"))
    comment -= code
    return n, len(code), len(comment), max(0, n - len(code) - len(comment))


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("physical", "code", "comment", "blank", "unclassified")]))
def curly_metrics(texts: pd.Series) -> pd.DataFrame:
    """Line metrics by a scanner for languages with C-like comments."""
    return pd.DataFrame([(*scan_curly(t or ""), 0) for t in texts], columns=["physical", "code", "comment", "blank", "unclassified"])
