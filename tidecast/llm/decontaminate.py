"""Benchmark decontamination: rare n-gram seeds find passages, local alignment scores them.

1. The n-grams of the test items are counted over all training documents (document frequency).
2. Every n-gram of an item that stands in documents is a seed, unless it is common wording: in many documents and
   in many items. Of every STRIDE n-grams in a row the rarest that stands in documents is one in any case.
   So an edited copy is found by any n-gram that its edits left. N-grams are neighbours or leave a word out, in items and in
   documents alike: a gap meets a gap where a word was replaced, neighbours where one was inserted or deleted. So a copy
   with every third word replaced or deleted, or a word inserted after every second, is found too.
3. A seed joins the documents that hold it to the item. Passages whose words cannot reach the limit in any order
   are not aligned. Around each diagonal with seeds the item is aligned
   with the passage (Smith and Waterman, 1981: local, linear gaps), so edited and paraphrased copies score
   by how much of them is left. The score is that of the best alignment divided by that of a full copy. A long
   excerpt of a long item counts by its absolute score.

Test items are few and small beside the training text. They are taken in blocks of at most BLOCK_CHARS
characters; a block is all that is sent to the tasks, and each block passes over the documents. The
documents are never shuffled and no task holds more than one text, so a passage that a third of the
documents share costs no more than its alignments.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import keep_rows, plain, rows_of

#: Words of an n-gram, n-grams of which one is a seed, characters of test items per block.
SEED, STRIDE, BLOCK_CHARS = 3, 4, 2_000_000
#: Places of the words of an n-gram that leaves one out, counted from its first.
GAPPED = (0, 1, 3)
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of a full copy's score from which on a passage counts as a copy.
THRESHOLD = 0.4
#: A passage that scores as a verbatim run of so many words is a copy, whatever share of a long item it is.
RUN_WORDS = 50
#: Common n-grams stand in more than this share of the documents and in more than so many items of a block.
COMMON_SHARE, COMMON_ITEMS = 0.01, 50

_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: runs of letters and digits, where every character beyond ASCII counts as a letter."""
    return text.lower().encode("utf-8").translate(_FOLD).split()


def shapes(n: int) -> list[tuple[int, ...]]:
    """The places of the words of n-grams: neighbours, and for those of full size with a gap."""
    return [tuple(range(n)), *[GAPPED] * (n == SEED)]


def codes(ids: np.ndarray, shape: tuple[int, ...] = tuple(range(SEED))) -> np.ndarray:
    """A number per n-gram of word ids, by its first word's place; 0 where a word is unknown (id < 0). It is that of the
    n-gram's words: a gap does not change it."""
    size = ids.size - shape[-1]
    if size <= 0:
        return np.zeros(0, np.uint64)
    found, known = np.zeros(size, np.uint64), np.ones(size, bool)
    for k in shape:
        part = ids[k : k + size]
        known &= part >= 0
        found = found * _FACTOR + (part + 1).astype(np.uint64)
        found ^= found >> np.uint64(29)
    return np.where(known, found | np.uint64(1), np.uint64(0))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and first and last (exclusive) word of it in the passage. Ids below 0 match nothing.

    One vectorised step per word of the item: the gap inside a row is a running maximum. Of equal scores
    the first in the item, then in the passage, is taken. The start comes along with the score.
    """
    m = passage.size
    steps = np.arange(m + 1) * -GAP
    best, row, origin = (0, 0, 0), np.zeros(m + 1, np.int64), np.arange(m + 1)
    places = np.arange(m + 1)
    for word in item.tolist():
        pair = np.where(passage == word, MATCH, MISMATCH) if word >= 0 else np.full(m, MISMATCH)
        diagonal, upper = row[:-1] + pair, row[1:] + GAP
        here, start = np.zeros(m + 1, np.int64), places.copy()
        take = np.where(diagonal >= upper, diagonal, upper)
        positive = take > 0
        here[1:] = np.where(positive, take, 0)
        start[1:] = np.where(positive, np.where(diagonal >= upper, origin[:-1], origin[1:]), places[1:])
        lifted = here + steps
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, places, 0))
        here, start = top - steps, start[source]
        row, origin = here, start
        end = int(np.argmax(row))
        if row[end] > best[0]:
            best = int(row[end]), int(origin[end]), end
    return best


def bound(shared: np.ndarray) -> int:
    """What no alignment can exceed, from which words of one side the other side has: a word in the aligned run gives MATCH
    at most if it is shared, else a mismatch or a gap. The best run of such values."""
    sums = np.concatenate([[0], np.cumsum(np.where(shared, MATCH, max(MISMATCH, GAP)))])
    return int((sums - np.minimum.accumulate(sums)).max())


def among(words: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the words are in a sorted array that is not empty."""
    return ordered[np.minimum(np.searchsorted(ordered, words), ordered.size - 1)] == words


class Items:
    """The test items of one block as word ids."""

    def __init__(self, rows: list[tuple]):
        """rows: (item_id, text). Items without words cannot be found."""
        self.vocabulary: dict[bytes, int] = {}
        self.keys, self.words = [], []
        for key, text in rows:
            words = words_of(text or "")
            if words:
                self.keys.append(key)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
        #: An item shorter than an n-gram is its own seed, looked up by its words; the others by their n-grams.
        self.sizes = [min(SEED, w.size) for w in self.words]

    def grams(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Item, number of words and n-grams, shape by shape."""
        for k, (words, n) in enumerate(zip(self.words, self.sizes)):
            for shape in shapes(n):
                if words.size > shape[-1]:
                    yield k, n, codes(words, shape)

    def of(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))


def _at(found: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Places in ``found`` whose value is in the sorted array ``ordered``."""
    places = np.flatnonzero(found)
    if not places.size or not ordered.size:
        return places[:0]
    values = found[places]
    slots = np.minimum(np.searchsorted(ordered, values), ordered.size - 1)
    return places[ordered[slots] == values]


def _document_counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """In how many rows of ``docs`` each n-gram of the block stands, and under 0 the number of rows; a task counts its rows
    before the shuffle."""
    listed: dict[int, list] = {n: [] for n in sorted(set(items.sizes))}
    for _, n, grams in items.grams():
        listed[n].append(grams)
    wanted = {n: np.unique(np.concatenate(grams)) for n, grams in listed.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = {n: np.zeros(w.size, np.int64) for n, w in wanted.items()}, 0
        for batch in batches:
            rows += batch.num_rows
            for (text,) in rows_of(batch, "content"):
                ids = items.of(text)
                for n, ordered in wanted.items():
                    found = [codes(ids, shape) for shape in shapes(n)]
                    here = np.unique(np.concatenate([f[_at(f, ordered)] for f in found]))
                    counts[n][np.searchsorted(ordered, here)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([rows], pa.int64())], names=["gram", "n"])
        for n, ordered in wanted.items():
            some = np.flatnonzero(counts[n])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ordered[some].view(np.int64)), pa.array(counts[n][some])], names=["gram", "n"]
            )

    summed = docs.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in summed.toLocalIterator()}


def seeds(grams: np.ndarray, frequency: dict[int, int], stride: int = STRIDE) -> list[int]:
    """Places of the rarest n-gram of every ``stride`` in a row; of equally rare ones the first."""
    counts = np.array([frequency.get(g, 0) for g in grams.tolist()])
    if counts.size <= stride:
        return [int(np.argmin(counts))]
    windows = np.lib.stride_tricks.sliding_window_view(counts, stride)
    return np.unique(np.argmin(windows, axis=1) + np.arange(windows.shape[0])).tolist()


def all_seeds(grams: np.ndarray, frequency: dict[int, int], common: set[int]) -> list[int]:
    """Places of all n-grams that stand in documents; ``common`` ones only where they are the rarest of STRIDE in a row."""
    here = [frequency.get(g, 0) > 0 for g in grams.tolist()]
    found = np.array([h and g not in common for h, g in zip(here, grams.tolist())])
    # an n-gram that stands in no document is the last to be chosen
    ordered = {g: frequency.get(g, 0) or 1 << 62 for g in grams.tolist()}
    for place in seeds(grams, ordered):
        found[place] |= here[place]
    return np.flatnonzero(found).tolist()


def _passages(places: list[tuple[int, int]], size: int, length: int) -> list[tuple[int, int]]:
    """Stretches of the document to align: seeds (place in document, place in item) give diagonals; a stretch
    reaches half an item beyond both ends, and stretches that touch are one."""
    reach, spans = size // 2 + 1, []
    for start in sorted(d - i for d, i in places):
        low, high = max(0, start - reach), min(length, start + size + reach)
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    return [tuple(s) for s in spans]


class Matcher:
    """Finds the items of one block in a text."""

    def __init__(self, items: Items, frequency: dict[int, int], threshold: float, run_words: int = RUN_WORDS):
        self.items, self.threshold, self.run_words = items, threshold, run_words
        #: Per number of words: which items have the seed, and where.
        self.owners: dict[int, dict[int, list[tuple[int, int]]]] = {n: {} for n in set(items.sizes)}
        held: list[set] = [set() for _ in items.keys]
        for k, _, grams in items.grams():
            held[k].update(grams.tolist())
        owned = Counter(g for own in held for g in own)
        least = COMMON_SHARE * frequency.get(0, 0)
        common = {g for g, n in owned.items() if n > COMMON_ITEMS and frequency.get(g, 0) > least}
        for k, n, grams in items.grams():
            for place in all_seeds(grams, frequency, common):
                self.owners[n].setdefault(int(grams[place]), []).append((k, place))
        self.distinct = [np.unique(words) for words in items.words]
        self.ordered = {n: np.array(sorted(o), np.uint64) for n, o in self.owners.items()}

    def __call__(self, text: str) -> list[tuple]:
        """(item_id, score, first word, word after the last) per item found, its best passage."""
        ids, hits = self.items.of(text), {}
        for n, wanted in self.ordered.items():
            for found in (codes(ids, shape) for shape in shapes(n)):
                for place in _at(found, wanted).tolist():
                    for k, at in self.owners[n][int(found[place])]:
                        hits.setdefault(k, []).append((place, at))
        best: dict = {}
        for k, places in hits.items():
            item, key = self.items.words[k], self.items.keys[k]
            limit = min(self.threshold * MATCH * item.size, MATCH * self.run_words)
            for low, high in _passages(places, item.size, ids.size):
                passage = ids[low:high]
                shared = among(passage, self.distinct[k])
                if bound(shared) < limit - 1e-6 or bound(among(item, np.unique(passage[shared]))) < limit - 1e-6:
                    continue
                score, start, end = align(item, passage)
                share = score / (MATCH * item.size)
                if (share >= self.threshold or score >= MATCH * self.run_words) and share > best.get(key, (0.0,))[0]:
                    best[key] = share, low + start, low + end
        return [(key, *found) for key, found in best.items()]


def matchers(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
             threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS, run_words: int = RUN_WORDS) -> list[Matcher]:
    """A matcher for each block of items, seeds by the counts over all of ``docs``. All items of one id are in one block."""
    content = docs.select(plain(text).alias("content"))
    tests = benchmark.select(F.col(item_id).alias("item_id"), plain(item_text).alias("content"))
    total = tests.agg(F.sum(F.length("content"))).first()[0] or 0
    blocks, made = 1 + int(total) // block_chars, []
    for block in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        # the order of the items does not depend on the order of their rows
        items = Items(sorted(map(tuple, rows), key=lambda r: (r[0] is None, str(r[0]), r[1])))
        if items.keys:
            made.append(Matcher(items, _document_counts(content, items), threshold, run_words))
    return made


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 **options) -> DataFrame:
    """One row per document and item it holds a copy of: doc_id, item_id, score, first_word, end_word.

    ``score`` is 1 for a full copy and at least the threshold, or the share that a run of RUN_WORDS words has
    of a long item; the words are counted from 0 in the
    document, ``end_word`` is not part of the passage. Of several passages the best, then the first is
    given. Repeated rows of ``docs`` give repeated rows; items of one id are one item with several texts.
    NULL and empty texts hold and match nothing; without items or documents the result is empty.
    """
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    item_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
    chosen = docs.select(F.col(doc_id).alias("doc_id"), plain(text).alias("content"))
    schema = f"doc_id {kind}, item_id {item_kind}, score double, first_word bigint, end_word bigint"

    def found_by(matcher: Matcher) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *m) for i, (t,) in enumerate(rows_of(batch, "content")) for m in matcher(t)]
                places, *columns = list(zip(*rows)) or [()] * 5
                kinds = [item_type, pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(places, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                    names=["doc_id", "item_id", "score", "first_word", "end_word"],
                )

        return chosen.mapInArrow(run, schema)

    result = docs.sparkSession.createDataFrame([], schema)
    for matcher in matchers(docs, benchmark, text, item_id, **options):
        result = result.unionByName(found_by(matcher))
    return result


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no copy of a test item. Nothing is shuffled."""
    for matcher in matchers(docs, benchmark, text, **options):
        docs = keep_rows(docs, text, lambda content, find=matcher: not find(content))
    return docs
