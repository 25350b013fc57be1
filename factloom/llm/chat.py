r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it are context, its reply alone is
trainable. What follows the last reply becomes one more example with nothing trainable, so that no
turn is lost; a conversation without a reply is that one example.

A turn is formatted as `[INST]role[/INST]text</s>`. Where role or text hold one of these three
control strings or a backslash, a backslash goes after the string's first character, or before the
backslash; reading drops each backslash that escapes and gives back what was there.

Rows are ordered by turn, ties by role and text, nulls first; null roles and texts are empty. Rows
with a null conversation id are one conversation. Repeated rows are turns of their own. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (OPEN, CLOSE, END):
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """Rows (conv_id, example, last boolean, formatted, loss_start, loss_length): the text of each
    example and the code points of it under the loss mask, none where loss_length is null."""
    empty = F.lit("")
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")
    )
    turns = df.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE))
    parts = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == trained).alias("trained"))).alias("parts"),
    )
    n = F.size("parts")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("parts", i)["trained"])
    targets = F.when(F.element_at("parts", n)["trained"], replies).otherwise(F.array_append(replies, n))
    each = parts.select("conv_id", "parts", F.posexplode(targets).alias("example", "at"))
    turn_text = F.transform(F.slice("parts", 1, F.col("at") - 1), lambda p: F.concat(p["head"], p["body"], F.lit(END)))
    goal = F.element_at("parts", F.col("at"))
    context = F.concat(F.array_join(turn_text, ""), goal["head"])
    return each.select(
        "conv_id", "example", (F.col("at") == n).alias("last"),
        F.concat(context, goal["body"], F.lit(END)).alias("formatted"),
        F.when(goal["trained"], F.length(context)).alias("loss_start"), F.when(goal["trained"], F.length(goal["body"])).alias("loss_length"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text, as structs (role, text)."""
    split = F.split(formatted, r"\Q" + END + r"\E", -1)
    whole = F.slice(split, 1, F.size(split) - 1)

    def turn(piece: Column) -> Column:
        two = F.split(piece, r"\Q" + CLOSE + r"\E", 2)
        return F.struct(unescape(F.substring(two[0], len(OPEN) + 1, 2**31 - 1)).alias("role"), unescape(two[1]).alias("text"))

    return F.transform(whole, turn)


def digests(made: DataFrame) -> DataFrame:
    """Reads the examples back: for each conversation its turns, its loss text and its formatted length."""
    loss = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))
    per = made.groupBy("conv_id").agg(
        F.max(F.when(F.col("last"), F.col("formatted"))).alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", loss.alias("text"))))).alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    got = per.select("conv_id", parsed(F.col("longest")).alias("turns"), F.array_join(F.transform("loss", lambda x: unescape(x["text"])), "").alias("loss"), "formatted_chars")
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return got.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>'))
    + length(replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>')) + 17 AS chars
  FROM rows
), summed AS (
  SELECT *, sum(chars) OVER w AS upto, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM sized
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR k = n), 0)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""
