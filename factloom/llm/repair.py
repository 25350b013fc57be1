"""Conversation structure repair: the cheapest edits after which roles read system?, (user, assistant)*.

Each turn is a 4 x 4 matrix over (cost, audit) pairs: its entry (i, j) is the cheapest way to edit the
turn, and to insert turns after it, that leads from state i of the roles' grammar to state j; audit spells
the edits by their initials. Pairs add by the lesser cost, then the ASCII-least audit, and multiply by
summing costs and joining audits. That is a semiring, because two audits of the same turns at the same
cost are never one the beginning of the other (the letters but I fix the cost, and more I cost more), so
the product of a conversation's matrices can be taken in any grouping: turns are dealt by ranges of
(conversation, turn), so that a long one spans tasks, each task multiplies its turns in a balanced tree,
and what meets at the edges of tasks is multiplied in rounds of up to FAN elements a group. The same
elements sum faults, illegal neighbours and gaps. Only role initials, fault marks and the texts' hashes
travel for this. An audit fixes the repaired roles, which `repaired` writes out turn by turn, streaming
the rows of a conversation in their order.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2, Insert an empty user or assistant turn 5; a turn
that stays truncated adds 5. Blank turns and repetitions of an earlier (role, text) have to go.

Null roles and texts count as one space, null turns come first, and a null conv_id is a conversation of
its own. Rows with the same turn are taken by role, then by the SHA-256 of the text; equal rows stand
together, are counted before the shuffle and multiplied by squaring, so that a hot row is one row. A
role's initial is its first letter; an empty role has none that the grammar knows. Texts of any length
are hashed where they are read. An empty table gives an empty result. Other columns are ignored.
`repaired` and the digest of a whole conversation pass it through one task row by row, as a SHA-256 has to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import written

#: States: nothing yet, after the system turn, after a user's, after an assistant's; edges by role initial.
EDGES = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
END = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Elements that one round multiplies in a group.
FAN = 8
SPACE = r"\x20\x09-\x0D"

Pair = tuple[int, str]
Matrix = tuple  # 16 pairs or None, by rows


def product(a: Matrix, b: Matrix) -> Matrix:
    out: list[Pair | None] = []
    for i in (0, 4, 8, 12):
        for j in range(4):
            best = None
            for k in range(4):
                x, y = a[i + k], b[4 * k + j]
                if x is not None and y is not None:
                    c = x[0] + y[0]
                    if best is None or c < best[0]:
                        best = (c, x[1] + y[1])
                    elif c == best[0]:
                        best = min(best, (c, x[1] + y[1]))
            out.append(best)
    return tuple(out)


def _matrix(edges: Iterable[tuple[int, int, Pair]]) -> Matrix:
    out: list[Pair | None] = [None] * 16
    for i, j, p in edges:
        out[4 * i + j] = min(p, out[4 * i + j] or p)
    return tuple(out)


UNIT = _matrix((i, i, (0, "")) for i in range(4))
_ONCE = _matrix([(i, i, (0, "")) for i in range(4)] + [(i, j, (INSERT, "I")) for r in "ua" for i, j in EDGES[r]])
#: No way needs more than three insertions in a row.
INSERTS = product(_ONCE, product(_ONCE, _ONCE))


@lru_cache(maxsize=4096)
def turn_matrix(initial: str, gone: bool, truncated: bool) -> Matrix:
    """A turn's edits, then insertions. `gone`: it has to be deleted."""
    edges: list[tuple[int, int, Pair]] = [(i, i, (DELETE, "D")) for i in range(4)]
    if not gone:
        more = TRUNCATED if truncated else 0
        edges += [(i, j, (REROLE + more, "R")) for r in "ua" for i, j in EDGES[r]]
        edges += [(i, j, (more, "K")) for i, j in EDGES.get(initial, [])]
    return product(_matrix(edges), INSERTS)


def power(m: Matrix, n: int) -> Matrix:
    out = UNIT
    while n:
        if n & 1:
            out = product(out, m)
        n >>= 1
        m = product(m, m) if n else m
    return out


def outcome(m: Matrix) -> Pair:
    """The cheapest edits of a conversation with the product `m` of its turns."""
    whole = product(INSERTS, m)
    return min(whole[j] for j in END if whole[j] is not None)


class Element:
    """What neighbouring turns of a conversation come to; `+` puts later ones behind."""

    __slots__ = ("first", "last", "turns", "low", "high", "blank", "duplicate", "truncated", "illegal", "matrix")
    TOLD = ("first", "last", "turns", "low", "high", "blank", "duplicate", "truncated", "illegal")

    def __init__(self, *values) -> None:
        for k, v in zip(self.__slots__, values):
            setattr(self, k, v)

    @classmethod
    def of(cls, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool, n: int) -> Element:
        """One distinct row that occurs n times; the first of them may be sound."""
        m = turn_matrix(initial, blank or duplicate, truncated)
        if n > 1:
            m = product(m, power(turn_matrix(initial, True, False), n - 1))
        faults = (n, 0, 0) if blank else (0, n, 0) if duplicate else (0, n - 1, int(truncated))
        return cls(initial, initial, int(turn is not None), turn, turn, *faults, n - 1, m)

    def __add__(self, b: Element) -> Element:
        turns = self.turns + b.turns - (self.high is not None and self.high == b.low)
        low, high = (b.low if self.low is None else self.low), (self.high if b.high is None else b.high)
        sums = (self.blank + b.blank, self.duplicate + b.duplicate, self.truncated + b.truncated)
        return Element(self.first, b.last, turns, low, high, *sums, self.illegal + b.illegal + (self.last + b.first not in ("su", "ua", "au")), product(self.matrix, b.matrix))

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


class Tree:
    """Elements added one by one and multiplied in a balanced tree: the sums held double in length."""

    def __init__(self) -> None:
        self.held: list[tuple[int, Element]] = []

    def add(self, e: Element) -> None:
        level = 0
        while self.held and self.held[-1][0] == level:
            e, level = self.held.pop()[1] + e, level + 1
        self.held.append((level, e))

    def total(self) -> Element:
        out = self.held[-1][1]
        for _, e in reversed(self.held[:-1]):
            out = e + out
        return out


# --- rows -------------------------------------------------------------------------------------------


def plain(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one space for null roles and texts."""
    return conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """`plain` rows, damaged by crc32("conv_id:turn") mod 20: 0 drops the row, 1 empties its text, 2 takes
    its sentence ends away, 3 repeats it, 4 makes it a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = plain(conversations).withColumn("__d", F.crc32(key.cast("binary")) % 20).where("__d <> 0")
    text = F.when(F.col("__d") == 1, "").when(F.col("__d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("__d") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("__n", F.explode(F.sequence(F.lit(1), F.when(F.col("__d") == 3, 2).otherwise(1)))).drop("__d", "__n")


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, n, blank, duplicate, truncated): the distinct rows, h for the text, how often
    each occurs, and its faults. Texts stay where they are read."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    marks = rows.select("conv_id", "turn", "role", _hash(F.col("text")).alias("h"), blank.alias("blank"), (~blank & ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("truncated"))
    one = written(marks.groupBy("conv_id", "turn", "role", "h").agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")), "turns")
    # the first of several turns with the same role and text; most rows have no other
    first = one.groupBy("conv_id", "role", "h").agg(F.count("*").alias("__k"), F.min(F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))).alias("__f")).where("__k > 1")
    first = first.select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("h").alias("__h"), "__f")
    met = one.join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("h") == F.col("__h")), "left")
    duplicate = F.col("__f").isNotNull() & ~F.col("__f.b").eqNullSafe(F.col("turn"))
    return met.select("conv_id", "turn", "role", "h", "n", "blank", (~F.col("blank") & F.coalesce(duplicate, F.lit(False))).alias("duplicate"), "truncated")


# --- elements ---------------------------------------------------------------------------------------

_PARTS = "first string, last string, turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, cost array<long>, audit array<string>"


def _told(conv, part: int, e: Element) -> tuple:
    """An element that may go on in the next task."""
    return conv, part, False, *(getattr(e, k) for k in Element.TOLD), [p and p[0] for p in e.matrix], [p and p[1] for p in e.matrix]


def _ended(conv, part: int, e: Element) -> tuple:
    """A conversation that is whole: the only pair that is left is its outcome."""
    p = outcome(e.matrix)
    return conv, part, True, *(getattr(e, k) for k in Element.TOLD), [p[0]], [p[1]]


def _element(r) -> Element:
    values = [None if pd.isna(v) else v for v in (getattr(r, k) for k in Element.TOLD)]
    return Element(*values[:2], *(v if v is None else int(v) for v in values[2:]), tuple(None if a is None else (int(c), a) for c, a in zip(r.cost, r.audit)))


def elements(turns: DataFrame) -> DataFrame:
    """(conv_id, part, whole, ...): one row for each conversation and task that holds some of its turns.
    Those that lie within a task are whole; the first and the last of a task may go on in others."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, none = TaskContext.get().partitionId(), object()
        now, tree, out, first = none, Tree(), [], True
        schema = None

        def flush(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            schema = schema or pa.schema([("conv_id", b.schema.field(0).type), ("part", pa.int32()), ("whole", pa.bool_()), ("first", pa.string()), ("last", pa.string()), *[(k, pa.int64()) for k in Element.TOLD[2:]], ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string()))])
            for conv, turn, initial, n, blank, duplicate, truncated in zip(*(c.to_pylist() for c in b.columns)):
                if now is none or conv != now:
                    if now is not none:
                        out.append((_told if first else _ended)(now, part, tree.total()))
                        first = False
                        if len(out) >= 1000:
                            yield flush(out)
                            out = []
                    now, tree = conv, Tree()
                tree.add(Element.of(turn, initial, blank, duplicate, truncated, n))
        if now is not none:
            yield flush([*out, _told(now, part, tree.total())])

    narrow = turns.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "n", "blank", "duplicate", "truncated", "role", "h")
    placed = narrow.repartitionByRange("conv_id", "turn", "role", "h").sortWithinPartitions("conv_id", "turn", "role", "h")
    return placed.drop("role", "h").withColumn("turn", F.col("turn").cast("long")).mapInArrow(run, f"conv_id {kind}, part int, whole boolean, {_PARTS}")


def _multiplied(parts: DataFrame) -> DataFrame:
    """Elements that go on, multiplied in rounds until each conversation has one. There are two a task at most."""
    schema = parts.schema

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.itertuples(index=False), key=lambda r: r.part)
        total = _element(rows[0])
        for r in rows[1:]:
            total = total + _element(r)
        conv = None if pd.isna(rows[0].conv_id) else rows[0].conv_id
        return pd.DataFrame([_told(conv, rows[0].part, total)], columns=schema.names).astype(object)

    most = parts.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("part")) - 1
        keyed = parts.withColumn("__g", F.floor(place / FAN))
        parts = written(keyed.groupBy("conv_id", "__g").applyInPandas(lambda pdf: group(pdf.drop(columns="__g")), schema), "elements")
        most = -(-most // FAN)
    return parts


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of `plain` rows."""
    parts = written(elements(marked(rows)), "elements")
    rest = _multiplied(parts.where("NOT whole"))
    schema, names = parts.schema, parts.columns

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [_ended(None if pd.isna(r.conv_id) else r.conv_id, r.part, _element(r)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(done, columns=names).astype(object)

    whole = parts.where("whole").unionByName(rest.mapInPandas(end, schema))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.get("cost", F.lit(0)).alias("cost"), F.get("audit", F.lit(0)).alias("audit"))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): the turns of `plain` rows after the edits of `audits`, in order
    within a partition, all of a conversation in one. Inserted turns have empty texts."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    turns = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _hash(F.col("text")).alias("h"), "text")
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("h"), F.col("audit").alias("text"))
    placed = turns.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h").select("conv_id", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, position = "", 0, 0, 0

        def inserts(conv) -> Iterator[tuple]:
            nonlocal at, state, position
            while at < len(audit) and audit[at] == "I":
                role, state = ("assistant", 3) if state == 2 else ("user", 2)
                at, position = at + 1, position + 1
                yield conv, position, role, "", "I"

        for b in batches:
            out: list[tuple] = []
            for conv, head, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if not head:
                    audit, at, state, position = text, 0, 0, 0
                else:
                    edit, at = audit[at], at + 1
                    if edit == "R":
                        role = "assistant" if state == 2 else "user"
                    if edit != "D":
                        state = {"s": 1, "u": 2, "a": 3}[role[0]]
                        position += 1
                        out.append((conv, position, role, text, edit))
                out.extend(inserts(conv))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()))], names=["conv_id", "position", "role", "text", "edit"])

    return placed.mapInArrow(run, f"conv_id {kind}, position long, role string, text string, edit string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256): the hash of the `role:text` of `repaired`'s rows, joined by line feeds, as they stand."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]], held[2]), pa.array([held[1].hexdigest()])], names=["conv_id", "sha256"])

        for b in batches:
            for conv, position, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if position == 1:
                    if held:
                        yield told()
                    held = (conv, hashlib.sha256(), b.schema.field(0).type)
                else:
                    held[1].update(b"\n")
                held[1].update(f"{role}:{text}".encode())
        if held:
            yield told()

    return turns.select("conv_id", "position", "role", "text").mapInArrow(run, f"conv_id {kind}, sha256 string")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations`: what `audits` says of `rows` and the repaired turns' hash."""
    found = written(audits(rows), "audits")
    hashes = digests(repaired(rows, found)).select(F.col("conv_id").alias("__h"), "sha256")
    told = found.withColumnRenamed("conv_id", "__c")
    out = conversations.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("__c")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("__h")), "left")
    numbers = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: The same by a recursion over the turns of all conversations at once; pairs are costs and letters in one
#: string, each letter followed by the initial that it gives, which the letters before it fix.
SQL = r"""
WITH RECURSIVE bytes AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
hashed AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)), lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) % 20 AS d
  FROM conversations, bytes),
hit AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE d <> 0),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k, substring(role, 1, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM hit),
f AS MATERIALIZED (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS dup, NOT blank AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
    lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i AS two FROM r),
g AS MATERIALIZED (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(cut AND NOT dup) AS truncated,
    count_if(two IS NOT NULL AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
e AS MATERIALIZED (SELECT conv_id, k, i, blank OR dup AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM f),
walk(conv_id, k, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, '000000005Iu', '000000010IuIa' FROM g
  UNION ALL
  SELECT conv_id, k, s0, s1, u, least(a, lpad((u[1:9]::BIGINT + 5)::VARCHAR, 9, '0') || u[10:] || 'Ia') FROM (
    SELECT conv_id, k, s0, s1, least(u, lpad((s0[1:9]::BIGINT + 5)::VARCHAR, 9, '0') || s0[10:] || 'Iu', lpad((s1[1:9]::BIGINT + 5)::VARCHAR, 9, '0') || s1[10:] || 'Iu', lpad((a[1:9]::BIGINT + 5)::VARCHAR, 9, '0') || a[10:] || 'Iu') AS u, a FROM (
      SELECT w.conv_id, e.k, lpad((s0[1:9]::BIGINT + 2)::VARCHAR, 9, '0') || s0[10:] || 'D-' AS s0,
        least(lpad((s1[1:9]::BIGINT + 2)::VARCHAR, 9, '0') || s1[10:] || 'D-', CASE WHEN NOT gone AND i = 's' THEN lpad((s0[1:9]::BIGINT + more)::VARCHAR, 9, '0') || s0[10:] || 'Ks' END) AS s1,
        least(lpad((s2[1:9]::BIGINT + 2)::VARCHAR, 9, '0') || s2[10:] || 'D-', CASE WHEN NOT gone THEN lpad((m[1:9]::BIGINT + more + CASE WHEN i = 'u' THEN 0 ELSE 1 END)::VARCHAR, 9, '0') || m[10:] || CASE WHEN i = 'u' THEN 'Ku' ELSE 'Ru' END END) AS u,
        least(lpad((s3[1:9]::BIGINT + 2)::VARCHAR, 9, '0') || s3[10:] || 'D-', CASE WHEN NOT gone THEN lpad((s2[1:9]::BIGINT + more + CASE WHEN i = 'a' THEN 0 ELSE 1 END)::VARCHAR, 9, '0') || s2[10:] || CASE WHEN i = 'a' THEN 'Ka' ELSE 'Ra' END END) AS a
      FROM (SELECT *, least(s0, s1, s3) AS m FROM walk) w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.k = w.k + 1))),
best AS MATERIALIZED (SELECT w.conv_id, least(s0, s3) AS p FROM walk w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND w.k = g.n),
letters AS (SELECT conv_id, unnest(range(10, length(p), 2)) AS pos, p FROM best),
placed AS (SELECT conv_id, pos, p[pos] AS edit, p[pos + 1] AS gives, count_if(p[pos] <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM letters),
told AS (
  SELECT p.conv_id, string_agg(edit, '' ORDER BY pos) AS audit,
    sha256(coalesce(string_agg(CASE WHEN edit <> 'D' THEN CASE WHEN edit = 'K' THEN f.role WHEN gives = 'u' THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE f.text END END, chr(10) ORDER BY pos), '')) AS sha
  FROM placed p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = greatest(p.k, 1) GROUP BY p.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(p[1:9]::BIGINT, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id
"""
