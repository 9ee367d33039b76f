"""Quality by the perplexity of a Kneser-Ney language model.

The model is an interpolated modified Kneser-Ney n-gram model (Chen and Goodman, 1998) over symbols: the
characters of a text in 256 classes. It is trained on trusted text, all of it. Symbols keep the model small
against the corpus (it has at most 256**4 n-grams, in practice some hundred thousand) and let it see what
words cannot show: capitals, markup, separators.

* Counts: every task counts the n-grams of its rows before the shuffle; Spark adds the counts up.
* Probabilities: the counts of order 4, the numbers of different continuations for the lower orders, the
  discounts and the shares of every context are joined and grouped as tables, keyed by n-gram.
* Scoring: the model is cut into shards by the two middle symbols of an n-gram, so that all that a place
  in a text needs is in one shard. A pass over the documents counts the n-grams of each, joins them with
  the shard and adds to the document's sum. A shard holds SHARD_ROWS rows at most on average, and only one
  is sent to the tasks per pass; the usual model is one shard. No text is shuffled for scoring.
* Thresholds: per language the quantile of the perplexities of the trusted documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tidecast.llm.common import fresh, plain, rows_of
from tidecast.session import discard, settle

ORDER = 4
SYMBOLS = 256
#: Symbols before the first and after the last of a text.
START, END = 2, 3
SHARD_ROWS = 4_000_000
#: Documents of a language are kept up to this quantile of its trusted ones. As the perplexity of n symbols varies by
#: chance, the limit is raised by the factor exp(NOISE / sqrt(n)): short texts need stronger evidence.
QUANTILE, NOISE = 0.99, 3.0
#: Symbols of a text whose n-grams are counted at once.
BLOCK = 1 << 20
#: n-grams that a task holds before it hands on its counts.
HELD = 1 << 21


def symbols(text: str) -> np.ndarray:
    """ASCII characters as they are, all others in 128 classes by their code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, points, 128 + points % 128).astype(np.uint32)


def grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams that end at each symbol and at the end of a text, as 32-bit numbers, in blocks."""
    all_ = np.concatenate([np.full(ORDER - 1, START, np.uint32), symbols(text), np.array([END], np.uint32)])
    for at in range(0, all_.size - ORDER + 1, BLOCK):
        part = all_[at : at + BLOCK + ORDER - 1]
        n = part.size - ORDER + 1
        yield part[:n] << 24 | part[1 : n + 1] << 16 | part[2 : n + 2] << 8 | part[3 : n + 3]


def _added(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(values, return_inverse=True)
    return distinct, np.bincount(where, counts, distinct.size).astype(np.int64)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (gram, n): how often each n-gram stands in all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            values = np.concatenate([held, *waiting])
            return _added(values, np.concatenate([numbers, np.ones(values.size - held.size, np.int64)]))

        for batch in batches:
            for (content,) in rows_of(batch, "content"):
                for block in grams(content):
                    waiting.append(block)
                    size += block.size
                    if size >= HELD:
                        held, numbers = merged()
                        waiting, size = [], 0
                        if held.size >= HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(numbers)], names=["gram", "n"])
                            held, numbers = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        held, numbers = merged()
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(numbers)], names=["gram", "n"])

    chosen = docs.select(plain(text).alias("content"))
    return chosen.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counted: DataFrame) -> list[float]:
    """The three discounts of an order from the numbers of n-grams seen once to four times; 0.5, 1 and 1.5 where these
    give none (a corpus too small or too even)."""
    few = {r["n"]: r["c"] for r in counted.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
    n1, n2, n3, n4 = (few.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [d if 0 < d < k else k / 2 for k, d in enumerate(found, 1)]


def model(trusted: DataFrame, text: str = "text") -> DataFrame:
    """Rows (length, gram, p, gamma) of the model, a written table.

    ``p`` is the interpolated probability of the n-gram's last symbol after the others, for every n-gram of
    that length seen; ``gamma`` is the share that is left to shorter n-grams after the n-gram as a context,
    NULL where it is none. An n-gram that was not seen has gamma of its context (1 if the context was not
    seen either) times the probability of the shorter n-gram; in the end 1/256. Without text the table is empty.
    """
    counted = settle(counts(trusted, text))
    orders = {ORDER: counted}
    for length in range(ORDER - 1, 0, -1):
        shorter = F.col("gram") % (SYMBOLS**length)
        orders[length] = settle(orders[length + 1].groupBy(shorter.alias("gram")).agg(F.count("*").alias("n")))
    parts, lower, scratch = [], None, list(orders.values())
    for length in range(1, ORDER + 1):
        own = orders[length]
        d = _discounts(own)
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.floor(F.col("gram") / SYMBOLS).cast("bigint")
        shares = own.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), (F.sum(off) / F.sum("n")).alias("gamma"))
        rows = own.withColumn("context", context).join(shares, "context")
        rest = F.col("gram") % (SYMBOLS ** (length - 1))
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / SYMBOLS))
        else:
            below = lower.select(F.col("gram").alias("rest"), F.col("p").alias("below"))
            rows = rows.withColumn("rest", rest).join(below, "rest")
        lower = settle(rows.select("gram", (((F.col("n") - off) / F.col("total")) + F.col("gamma") * F.col("below")).alias("p")))
        scratch.append(lower)
        parts.append(lower.select(F.lit(length).alias("length"), "gram", "p", F.lit(None).cast("double").alias("gamma")))
        parts.append(shares.select(F.lit(length - 1).alias("length"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "gamma"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole = settle(whole.groupBy("length", "gram").agg(F.max("p").alias("p"), F.max("gamma").alias("gamma")))
    discard(*scratch)
    return whole


class Shard:
    """Lookup in a part of the model, or all of it."""

    def __init__(self, rows: list[tuple]):
        """rows: (length, gram, p, gamma)."""
        self.p, self.gamma = {}, {}
        for length in range(ORDER + 1):
            for kind, at in ((self.p, 2), (self.gamma, 3)):
                own = sorted((r[1], r[at]) for r in rows if r[0] == length and r[at] is not None)
                kind[length] = (np.array([k for k, _ in own], np.int64), np.log(np.array([v for _, v in own], float)))

    @staticmethod
    def _find(table: tuple, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not keys.size:
            return np.zeros(wanted.size, bool), np.zeros(wanted.size)
        at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
        seen = keys[at] == wanted
        return seen, np.where(seen, values[at], 0.0)

    def log_p(self, wanted: np.ndarray) -> np.ndarray:
        """The logarithms of the probabilities of n-grams, shorter and shorter ones for those not seen."""
        found, left, wanted = np.zeros(wanted.size), np.arange(wanted.size), wanted.astype(np.int64)
        for length in range(ORDER, 0, -1):
            seen, value = self._find(self.p[length], wanted)
            found[left] += value
            left, wanted = left[~seen], wanted[~seen]
            if not left.size:
                return found
            found[left] += self._find(self.gamma[length - 1], wanted // SYMBOLS)[1]
            wanted = wanted % SYMBOLS ** (length - 1)
        found[left] -= np.log(SYMBOLS)
        return found


def shards_of(whole: DataFrame, shard_rows: int = SHARD_ROWS) -> Iterator[tuple[int, int, Shard]]:
    """The shards one after the other: number, number of shards, lookup.

    The places of an n-gram abcd are dealt by its middle symbols b and c. Those are the last two of its
    context abc and the first two of bcd, so a row of length 3 may be in two shards. Shorter rows, 65,793 at
    most, are in all.
    """
    total = whole.count()
    shards = 1 + total // shard_rows
    pair = lambda c: F.pmod(F.xxhash64(c % 65536), F.lit(shards))
    for k in range(shards):
        gram, length = F.col("gram"), F.col("length")
        inside = (
            (length < 3)
            | ((length == 4) & (pair(F.floor(gram / 256).cast("bigint")) == k))
            | ((length == 3) & ((pair(gram) == k) | (pair(F.floor(gram / 256).cast("bigint")) == k)))
        )
        rows = whole.where(inside) if shards > 1 else whole
        yield k, shards, Shard([tuple(r) for r in rows.select("length", "gram", "p", "gamma").collect()])


def with_log_p(docs: DataFrame, whole: DataFrame, text: str = "text", shard_rows: int = SHARD_ROWS,
               log_p: str = "log_p", n_symbols: str = "n_symbols") -> DataFrame:
    """``docs`` with the sum of log probabilities and the number of symbols of each text, the end counted; one pass per shard.

    NULL is the empty text. No row is dropped and no column changed.
    """
    place = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(log_p, DoubleType()), StructField(n_symbols, LongType())])
    found = docs.withColumns({log_p: F.lit(0.0), n_symbols: F.lit(0).cast("bigint")})
    for number, shards, shard in shards_of(whole, shard_rows):
        def run(batches: Iterator[pa.RecordBatch], number=number, shards=shards, shard=shard) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, sums, sizes = batch.column(place), [], []
                for i in range(batch.num_rows):
                    total, n = 0.0, 0
                    for block in grams(texts[i].as_py() or ""):
                        n += block.size
                        kinds, times = np.unique(block, return_counts=True)
                        if shards > 1:
                            own = shard_numbers(kinds, shards) == number
                            kinds, times = kinds[own], times[own]
                        total += float(shard.log_p(kinds) @ times)
                    sums.append(total)
                    sizes.append(n)
                before = batch.column(batch.num_columns - 2).to_numpy()
                columns = [*batch.columns[:-2], pa.array(before + np.array(sums, float)), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        found = found.mapInArrow(run, schema)
    return found


def shard_numbers(wanted: np.ndarray, shards: int) -> np.ndarray:
    """The shards of n-grams, by the same hash of the middle symbols that Spark uses."""
    pairs = (wanted.astype(np.int64) >> 8) & 0xFFFF
    distinct, where = np.unique(pairs, return_inverse=True)
    hashed = [xxhash.xxh64_intdigest(int(p).to_bytes(8, "little", signed=True), 42) for p in distinct]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashed]
    return np.array([h % shards for h in signed], np.int64)[where]


def trusted_ids(labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """The ids that are labelled as good text; a label that contradicts itself is none."""
    told = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("trusted_id")).agg(F.min("quality").alias("q"))
    return told.where("q = 1").select("trusted_id")


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
           quantile: float = QUANTILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, limits, model): doc_id, lang, perplexity, n_symbols per row of ``docs``; limit per language; the model."""
    ids = settle(trusted_ids(labels))
    # merged at every size: the labels grow with the documents, so that what is moved grows in proportion
    whole = model(docs.join(ids.hint("merge"), docs[doc_id] == ids["trusted_id"], "left_semi"), text)
    plain_docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))
    scored = with_log_p(plain_docs, whole)
    scores = settle(scored.select("doc_id", "lang", F.exp(-F.col("log_p") / F.col("n_symbols")).alias("perplexity"), "n_symbols"))
    good = scores.join(ids, scores["doc_id"] == ids["trusted_id"], "left_semi")
    limits = good.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("limit"))
    return scores, settle(limits), whole


def _raised(limit: Column, n_symbols: Column) -> Column:
    return limit * F.exp(NOISE / F.sqrt(n_symbols))


def decide(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """``scores`` with ``limit`` and ``keep``. A language without trusted documents has no limit and keeps everything."""
    joined = scores.join(limits, "lang", "left")
    return joined.withColumn("keep", F.coalesce(F.col("perplexity") <= _raised(F.col("limit"), F.col("n_symbols")), F.lit(True)))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose perplexity does not exceed the limit of their language.

    A second scoring pass decides row by row, so neither repeated nor missing ids matter and no text is
    shuffled for it; limits are joined by language. Without trusted text everything stays.
    """
    _, limits, whole = judged(docs, labels, doc_id, text, lang, **options)
    sum_, size, key, limit = (fresh(n, docs) for n in ("log_p", "n_symbols", "limit_lang", "limit"))
    scored = with_log_p(docs, whole, text, log_p=sum_, n_symbols=size)
    limits = limits.select(F.col("lang").alias(key), F.col("limit").alias(limit))
    joined = scored.join(limits, F.coalesce(F.col(lang).cast("string"), F.lit("")) == F.col(key), "left")
    good = F.coalesce(F.exp(-F.col(sum_) / F.col(size)) <= _raised(F.col(limit), F.col(size)), F.lit(True))
    return joined.where(good).drop(sum_, size, key, limit)
