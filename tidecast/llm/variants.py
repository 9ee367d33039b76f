"""Spelling variants by permuterm rotations.

A word is marked with a terminator and turned round: ``b$a`` is a rotation of ``ab$``. Turned so that the character to be
skipped comes last, two words that differ in just that character are neighbours in the sorted rotations, as they share
all of the rotation before it: a prefix range. A word with that character missing has this prefix as a whole rotation and
stands in the same range. So one range holds at most one shorter word and, for each character of the alphabet, one
longer word: it is small whatever the data. All its members are neighbours of each other. The scan of a range gives each
member its count of neighbours and the best of the others, never a pair.

The same shorter word can be reached by skipping any of several equal characters in a row. Only the last of them counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import rows_of, utf8
from tidecast.session import discard, settle

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SHORTEST, LEAST, FACTOR = 6, 5, 5
END = "$"
#: One in so many runs of a document loses a character, see ``with_slips``.
SLIPS = 199
#: Different words that a task counts before it hands them on. Decides only where sums are formed.
HELD = 100_000


def unchanged(doc_id: object, word: str) -> str:
    return word


def with_slips(doc_id: object, word: str) -> str:
    """The word, or the word without one character where a hash of document and word says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % SLIPS:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, slip: Callable[[object, str], str] = unchanged, shortest: int = SHORTEST, least: int = LEAST,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (word, n) of the words of at least ``shortest`` code points that occur at least ``least`` times.

    A word is a maximal run of Latin letters with A-Z lower-cased. NULL is the empty text; repeated rows count
    repeatedly; a row without id has the empty id. Counted per document, then per task, before rows are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return found

        for batch in batches:
            for key, raw in rows_of(batch, "doc_id", "raw"):
                for word, n in Counter(RUN.findall(raw.lower().decode())).items():
                    if len(word) >= shortest and len(word := slip(key, word)) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    chosen = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("raw"))
    counts = chosen.mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """Rows (turned, word, n, skips, last): every rotation as a whole, and without its last character (``skips``).

    ``last``: the skipped character is the last of equal ones in a row.
    """
    length = F.char_length("word")
    places = F.sequence(F.lit(1), length)

    def at(i, n=1):
        return F.substring(F.col("word"), i, n if not isinstance(n, int) else F.lit(n))

    def turned(i, skipped: int):
        """What follows the place i, the terminator, what stands before it."""
        return F.concat(F.substring(F.col("word"), i + skipped, length), F.lit(END), F.substring(F.col("word"), F.lit(1), i - 1))

    skipping = F.transform(places, lambda i: F.struct(
        turned(i, 1).alias("turned"), F.lit(True).alias("skips"), (at(i) != at(i + 1)).alias("last")))
    whole = F.transform(F.sequence(F.lit(1), length + 1), lambda i: F.struct(
        turned(i, 0).alias("turned"), F.lit(False).alias("skips"), F.lit(False).alias("last")))
    return words.select("word", "n", F.inline(F.concat(skipping, whole))).select("turned", "word", "n", "skips", "last")


def neighbours(words: DataFrame) -> DataFrame:
    """Of words (word, n) those with a near word: rows (word, n_near, near, near_n), the nearest one by n, then by code points."""
    key = Window.partitionBy("turned")
    ranked = key.orderBy(F.col("n").desc(), "word")
    best = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct((-F.col("n")).alias("rank"), "word")
    scanned = rotations(words).select(
        "word", "skips", "last",
        F.count("*").over(best).alias("members"),
        F.count_if("skips").over(best).alias("longer"),
        F.count_if("last").over(best).alias("longer_last"),
        F.first(one).over(best).alias("first"),
        F.nth_value(one, 2).over(best).alias("second"),
    ).where("members > 1")
    shorter = F.col("members") > F.col("longer")
    others = F.when(F.col("skips"), F.col("longer") - 1 + (shorter & F.col("last")).cast("int")).otherwise(F.col("longer_last"))
    other = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    per_word = scanned.groupBy("word").agg(F.sum(others).cast("bigint").alias("n_near"), F.min(other).alias("near"))
    return per_word.select("word", "n_near", F.col("near.word").alias("near"), (-F.col("near.rank")).alias("near_n"))


def groups(counts: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) for every word of ``counts`` (word, n).

    ``form``: its near word of largest n (ties: first in code-point order) if that is at least ``factor`` times as frequent,
    else NULL. ``root``: where the forms lead, the word itself without one. Every step multiplies n, so the way ends; each
    round doubles the steps taken, so their number is the logarithm of the longest way. An empty table gives an empty result.
    """
    words = settle(counts.select("word", "n"))
    near = neighbours(words).withColumnRenamed("word", "its_word")
    frequent = F.col("near_n") >= F.lit(factor) * F.col("n")
    formed = settle(words.join(near, F.col("word") == F.col("its_word"), "left").select(
        "word", F.when(frequent, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(frequent, F.col("near_n")).alias("form_n"),
    ))
    steps = settle(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("its_word"), F.col("root").alias("its_root"))
        jumped = settle(steps.join(ahead, F.col("root") == F.col("its_word"), "left").select(
            "word", F.coalesce("its_root", "root").alias("root"), F.col("its_root").isNotNull().alias("moved")
        ))
        discard(steps)
        steps = jumped
        if jumped.where("moved").isEmpty():
            break
    discard(words)
    roots = steps.select(F.col("word").alias("its_word"), "root")
    return formed.join(roots, F.col("word") == F.col("its_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


#: crc32 of a text of code points up to U+00FF: its UTF-8 bytes one by one, each shifted out bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([
    CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END
    FOR c IN string_split({text}, '')])),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SLIPS = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS word FROM documents
), counted AS (
  SELECT doc_id, word, count(*) AS n FROM runs WHERE length(word) >= {SHORTEST} GROUP BY ALL
), hashed AS (
  SELECT word, n, {_CRC.format(text="coalesce(doc_id::VARCHAR, '') || ':' || word")} AS h FROM counted
), words AS MATERIALIZED (
  SELECT CASE WHEN h % {SLIPS} = 0 THEN left(word, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {SHORTEST} AND sum(n) >= {LEAST}
), cut AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), shorter AS (
  SELECT DISTINCT cut.word, cut.n, words.word AS other, words.n AS other_n FROM cut JOIN words ON words.word = cut.rest
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT word, other, other_n FROM shorter UNION ALL SELECT other, word, n FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS MATERIALIZED (
  SELECT word, CASE WHEN other_n >= {FACTOR} * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN other_n >= {FACTOR} * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), ways AS (
  SELECT word, word AS here FROM formed
  UNION ALL
  SELECT w.word, f.form FROM ways w JOIN formed f ON f.word = w.here WHERE f.form IS NOT NULL
), ends AS (
  SELECT w.word, w.here AS root FROM ways w JOIN formed f ON f.word = w.here WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
