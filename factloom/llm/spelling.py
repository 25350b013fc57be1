"""Spelling variants: words one edit apart, the form each word is a variant of, and the root of its forms.

Words are near if they differ by exactly one replaced, inserted or deleted code point. No pair of words
is made. A word stands in one group for each of its places, keyed by the word with a hole there: the
members of a group replace each other's letter, and each has the group's size less one near words and
the group's first word, or the second if it is first itself. It also stands under each word that it
becomes by a deletion, where it meets that word if the vocabulary has it. One window over the keys gives
every member its number of near words and the best of them; one sum over words combines these, since two
words share at most one key. A group has a member for each letter of the alphabet at most (and place,
for deletions), so no key is hot.

A word's form is its near word with the largest count, if that is `ratio` times its own or more; counts
then grow along forms, so following them ends, and takes the logarithm of their number in jumps.

Words are numbered in code-point order once, and only numbers travel with the keys. Keys of up to 64
code points are the letters themselves; longer ones are two polynomial hashes modulo 2^61 - 1 and the
length, so a word of any length makes rows of bounded size in time linear in its length (by the long
words' own small helper; all other work is built-in functions).

Null texts have no words and a null doc_id counts as empty where a run is chosen for damage. Rows that
repeat count again. Very long texts are taken whole, a text at a time; ties go to the smaller word in
code-point order. No documents, or no word often enough, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import written
from factloom.sources.tables import Rounds

#: Letters of a word: ASCII's, and those from U+00C0 to U+00FF with the two signs among them.
LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points up to which a key is spelt out.
SPELT = 64
HOLE = "*"
_P, _B, _C = (1 << 61) - 1, 1_000_003, 7_368_787
#: Kinds of members: a word with a hole, a word itself, a word less a letter.
_HOLED, _WHOLE, _SHORT = 0, 1, 2


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 1) -> DataFrame:
    """(id, run): every maximal run of letters of every text that is long enough, with A-Z in lower case."""
    pattern = F.lit(f"{LETTERS}{{{min_letters},}}")
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), pattern, F.lit(0))).alias("run"))
    # Spark lowers ASCII bytes at once; where other letters stand, only A-Z may change
    ascii_only = F.octet_length("run") == F.char_length("run")
    return found.withColumn("run", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)))


def misprinted(id_: Column, run: Column, one_in: int = 97) -> Column:
    """The run, or where `one_in` divides h = crc32("id:run"), the run without its code point h mod length."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[Column, Column], Column] | None = None, min_letters: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): words with enough letters and occurrences; `change` (id, run) -> run alters runs first."""
    # no change makes a run longer, so short runs aren't taken
    found = runs(docs, id_col, text_col, min_letters)
    word = change(F.col("id"), F.col("run")) if change else F.col("run")
    return found.select(word.alias("word")).where(F.char_length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """`words` with an id that grows with the word in code-point order, written once so that it stays, and
    how many are over SPELT code points."""
    placed = words.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n")
    return Rounds(words.sparkSession, "words").counted(placed, F.char_length("word") > SPELT)


def _long_keys(word: str) -> Iterator[tuple[str, int]]:
    """The keys of a word over SPELT code points and their kinds, in time linear in its length."""
    size, heads, tails, powers = len(word), [(0, 0)], [(0, 0)], [(1, 1)]
    codes = [ord(c) for c in word]
    for c in codes:
        (a, b), (p, q) = heads[-1], powers[-1]
        heads.append(((a * _B + c) % _P, (b * _C + c) % _P))
        powers.append((p * _B % _P, q * _C % _P))
    for k, c in enumerate(reversed(codes)):
        (a, b), (p, q) = tails[-1], powers[k]
        tails.append(((c * p + a) % _P, (c * q + b) % _P))

    def key(length: int, i: int, middle: int | None) -> str:
        """Of the first i letters, the middle if there is one, and the letters from i + 1 on."""
        rest = size - i - 1
        a, b = heads[i]
        if middle is not None:
            a, b = (a * _B + middle) % _P, (b * _C + middle) % _P
        p, q = powers[rest]
        return f"{length}:{(a * p + tails[rest][0]) % _P}:{(b * q + tails[rest][1]) % _P}"

    yield key(size, 0, codes[0]), _WHOLE
    for i in range(size):
        yield key(size, i, ord(HOLE)), _HOLED
    short = (word[:i] + word[i + 1 :] for i in range(size)) if size - 1 <= SPELT else (key(size - 1, i, None) for i in range(size))
    for k in set(short):
        yield k, _SHORT


def keys(words: DataFrame, long_words: bool = True) -> DataFrame:
    """(key, kind, id, n): the groups that words (id, word, n) stand in. `long_words`: whether some are over
    SPELT code points; where none is, no Python runs."""
    w, places = F.col("word"), F.sequence(F.lit(1), F.char_length("word"))
    less = lambda i, middle: F.concat(F.substring(w, F.lit(1), i - 1), F.lit(middle), F.substring(w, i + 1, F.char_length(w)))
    of = lambda a, kind: F.transform(a, lambda k: F.struct(k.alias("key"), F.lit(kind).cast("tinyint").alias("kind")))
    each = F.concat(of(F.transform(places, lambda i: less(i, HOLE)), _HOLED), of(F.array(w), _WHOLE), of(F.array_distinct(F.transform(places, lambda i: less(i, ""))), _SHORT))
    spelt = words.where(F.char_length("word") <= SPELT).select("id", "n", F.explode(each).alias("e")).select("e.key", "e.kind", "id", "n")
    if not long_words:
        return spelt

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("kind", pa.int8()), ("id", pa.int64()), ("n", pa.int64())])
        for b in batches:
            out: list[tuple] = []
            for i, word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for key, kind in _long_keys(word):
                    out.append((key, kind, i, n))
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    long_ = words.where(F.char_length("word") > SPELT).select("id", "word", "n").mapInArrow(hashed, "key string, kind tinyint, id long, n long")
    return spelt.unionByName(long_)


def near(words: DataFrame, long_words: bool = True) -> DataFrame:
    """(id, n_near, best): of each word (id, word, n) with near words, how many and the best (n, o), o the
    negated id of the near word with the largest n, then the smallest id."""
    order = Window.partitionBy("key").orderBy(F.desc("n"), "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("n", (-F.col("id")).alias("o"))
    held = keys(words, long_words).select(
        "id", "kind", F.count("*").over(whole).alias("size"), F.row_number().over(order).alias("place"), F.first(me).over(whole).alias("top"), F.lead(me).over(order).alias("next"),
        F.count_if(F.col("kind") == _SHORT).over(whole).alias("shorts"), F.max(F.when(F.col("kind") == _SHORT, me)).over(whole).alias("longer"), F.max(F.when(F.col("kind") == _WHOLE, me)).over(whole).alias("shorter"),
    ).where("size > 1")
    kind = F.col("kind")
    n = F.when(kind == _HOLED, F.col("size") - 1).when(kind == _WHOLE, F.col("shorts")).otherwise(F.col("shorter").isNotNull().cast("long"))
    other = F.when(kind == _HOLED, F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))).when(kind == _WHOLE, F.col("longer")).otherwise(F.col("shorter"))
    return held.select("id", n.alias("n"), other.alias("other")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n_near"), F.max("other").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of words (id, form): where following forms ends. Each round doubles the distance."""
    rounds = Rounds(forms.sparkSession, "roots")
    now = rounds.put(forms.select("id", F.col("form").alias("root")))
    moved = 1
    while moved:
        on = now.select(F.col("id").alias("__id"), F.col("root").alias("__root"))
        step = now.join(on, F.col("root") == F.col("__id"), "left").select("id", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved"))
        step, moved = rounds.counted(step, F.col("moved"))
        now = step.select("id", "root")
    return now


def variants(words: DataFrame, ratio: float = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n): one row a word. `form` is null where
    no near word has `ratio` times the count; `root` is the last of the forms, the word itself without one."""
    named, long_words = numbered(words)
    best = near(named, long_words > 0).select(F.col("id").alias("__id"), "n_near", (-F.col("best.o")).alias("form"), F.col("best.n").alias("form_n"))
    enough = F.col("form_n") >= ratio * F.col("n")
    met = named.join(best, F.col("id") == F.col("__id"), "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    met = written(met, "forms")
    last = roots(met.where("form IS NOT NULL").select("id", "form")).select(F.col("id").alias("__id"), "root")
    spell = lambda i, w: named.select(F.col("id").alias(i), F.col("word").alias(w))
    out = met.join(last, F.col("id") == F.col("__id"), "left").drop("__id").join(spell("__f", "form_word"), F.col("form") == F.col("__f"), "left").join(spell("__r", "root_word"), F.col("root") == F.col("__r"), "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


#: The same by joins of words on their keys, with crc32 by its table of bytes.
SQL = r"""
WITH RECURSIVE bytes AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
found AS MATERIALIZED (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)),
once AS MATERIALIZED (SELECT doc_id, run, count(*) AS n, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b FROM found WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS MATERIALIZED (
  SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * octet_length(b), 2), lambda i: ('0x' || substring(hex(b), i, 2))::BIGINT)), lambda c, x: xor(c // 256, t[(xor(c, x) % 256) + 1])), 4294967295) AS h FROM once, bytes),
changed AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
holes AS MATERIALIZED (SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: substring(word, 1, i - 1) || '*' || substring(word, i + 1))) AS k FROM v),
less AS MATERIALIZED (SELECT DISTINCT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: substring(word, 1, i - 1) || substring(word, i + 1))) AS k FROM v),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.k = b.k AND a.word <> b.word
  UNION ALL SELECT l.word, v.word, v.n FROM less l JOIN v ON l.k = v.word UNION ALL SELECT v.word, l.word, l.n FROM less l JOIN v ON l.k = v.word),
ranked AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS r FROM pairs),
met AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * v.n THEN other END AS form, CASE WHEN r.n >= 2 * v.n THEN r.n END AS form_n FROM v LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r USING (word)),
walk(word, last, form) AS (SELECT word, word, form FROM met UNION ALL SELECT w.word, m.word, m.form FROM walk w JOIN met m ON m.word = w.form)
SELECT met.word, met.form, last AS root, n, n_near, form_n FROM met JOIN walk w ON met.word = w.word AND w.form IS NULL
"""
