"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear (logistic) models over the words of a text and
their beginnings. The model of a category also gets the probabilities of all categories before it. So that
it does not learn to trust probabilities that a model gives its own training rows, it is trained with
out-of-fold ones: of models that have not seen the row.

The features of a category are scaled by their log-odds in the training rows (Wang and Manning, 2012), so that rare
but telling words count and common ones do not drown them.

The fit takes a bounded sample of the labelled rows, SAMPLE at most, chosen by a hash of the id. Which
features are used, FEATURES at most, is decided by counts that Spark adds up over the sample. Scoring is a
map over whole texts, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import keep_rows, plain, rows_of
from tidecast.llm.decontaminate import words_of

#: Most labelled rows that are fitted, most features, and the least log-odds of a feature.
SAMPLE, FEATURES, LEAST_ODDS = 10_000, 3072, 0.7
#: Rows a feature must be in; lengths in bytes of the beginnings of words that are features.
LEAST_ROWS, BEGINNINGS = 4, (3, 4, 5, 6)
FOLDS, ROUNDS, RIDGE = 4, 200, 1e-4
#: Words whose features a worker keeps; it starts anew when full.
MEMORY = 1 << 18


def categories() -> dict[str, Column]:
    """The labelled categories in chain order: what is poor text helps to judge what is toxic."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def features_of(text: str) -> set[bytes]:
    """The words of a text and, with a trailing ``*``, their beginnings."""
    words = set(words_of(text))
    return words | {w[:n] + b"*" for n in BEGINNINGS for w in words if len(w) >= n}


class Sparse:
    """Rows of features with one value per feature, and dense further columns."""

    def __init__(self, rows: list[np.ndarray], width: int, dense: np.ndarray):
        self.width, self.dense, self.value = width, dense, np.ones(width)
        self.places = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [r.size for r in rows])
        self.size = len(rows)

    def times(self, weights: np.ndarray) -> np.ndarray:
        own = np.bincount(self.row, (self.value * weights[: self.width])[self.places], self.size)
        return own + self.dense @ weights[self.width : -1] + weights[-1]

    def back(self, residual: np.ndarray) -> np.ndarray:
        own = np.bincount(self.places, residual[self.row], self.width) * self.value
        return np.concatenate([own, self.dense.T @ residual, [residual.sum()]])

    def scaled(self, y: np.ndarray) -> Sparse:
        """With the log-odds of the features as their values."""
        made = self.part(np.ones(self.size, bool))
        positive, total = np.bincount(self.places, y[self.row], self.width), np.bincount(self.places, minlength=self.width)
        with_ = (positive + 0.5) / (y.sum() + 1)
        without = (total - positive + 0.5) / (self.size - y.sum() + 1)
        made.value = np.log(with_ / without)
        return made

    def part(self, chosen: np.ndarray) -> Sparse:
        made = object.__new__(Sparse)
        inside, number = chosen[self.row], np.cumsum(chosen) - 1
        made.width, made.dense, made.value, made.size = self.width, self.dense[chosen], self.value, int(chosen.sum())
        made.places, made.row = self.places[inside], number[self.row[inside]]
        return made


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: Sparse, y: np.ndarray, rounds: int = ROUNDS, ridge: float = RIDGE) -> np.ndarray:
    """Weights (features, dense columns, bias) of a ridge logistic regression, by accelerated gradient steps."""
    x, n, k = x.scaled(y), max(1, x.size), x.width + x.dense.shape[1] + 1
    probe = np.ones(k)
    for _ in range(12):  # the largest curvature, by power iteration
        probe = x.back(x.times(probe)) / np.linalg.norm(probe)
        if not np.linalg.norm(probe):
            return np.zeros(k)
    pace = 1 / (0.25 * 1.1 * np.linalg.norm(probe) / n + ridge)
    weights, ahead, momentum = np.zeros(k), np.zeros(k), 1.0
    for _ in range(rounds):
        gradient = x.back(sigmoid(x.times(ahead)) - y) / n
        gradient[:-1] += ridge * ahead[:-1]
        following = ahead - pace * gradient
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, weights, momentum = following + (momentum - 1) / grown * (following - weights), following, grown
    weights[: x.width] *= x.value
    return weights


def best_limit(found: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on a row is positive, by the F1 measure; the middle of the gap on the odds' scale. 0.5
    without positive rows."""
    if not y.sum():
        return 0.5
    order = np.argsort(-found, kind="stable")
    ranked, hits = found[order], np.cumsum(y[order])
    measure = 2 * hits / (np.arange(1, y.size + 1) + y.sum())
    measure[:-1][ranked[:-1] == ranked[1:]] = 0  # no limit between equal ones
    at = int(np.argmax(measure))
    low = ranked[at + 1] if at + 1 < ranked.size else 0.0
    odds = [np.log(max(p, 1e-9) / max(1 - p, 1e-9)) for p in (ranked[at], low)]
    return float(sigmoid(np.mean(odds)))


class Chain:
    """The fitted chain: vocabulary, and per category weights for features, earlier probabilities and bias."""

    def __init__(self, names: list[str], vocabulary: list[bytes], rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS):
        """rows: feature numbers per row; labels: one 0/1 column per category. Without rows all probabilities are 0."""
        self.names = names
        self.known = {f: i for i, f in enumerate(vocabulary)}
        self.weights, held_out = [], np.zeros((len(rows), 0))
        fold = np.arange(len(rows)) % folds
        for c in range(len(names)):
            x, y = Sparse(rows, len(vocabulary), held_out), labels[:, c].astype(float)
            self.weights.append(fit(x, y) if len(rows) else np.append(np.zeros(len(vocabulary) + c), -40.0))
            outside = np.zeros(len(rows))
            for k in range(folds):
                inside = fold != k
                if inside.any() and (~inside).any():
                    outside[~inside] = sigmoid(x.part(~inside).times(fit(x.part(inside), y[inside])))
            held_out = np.column_stack([held_out, outside])
        #: Out-of-fold probabilities of the fitted rows, and the limit for the last category that judges them best.
        self.held_out = held_out
        self.limit = best_limit(held_out[:, -1], labels[:, -1])
        self.features = np.array([w[: len(vocabulary)] for w in self.weights]).T
        self.seen: dict[bytes, tuple] = {}

    def _places(self, text: str) -> set[int]:
        """The numbers of a text's features. Words looked up before are kept, up to MEMORY of them."""
        words = set(words_of(text))
        missing = [w for w in words if w not in self.seen]
        if len(self.seen) + len(missing) > MEMORY:
            self.seen, missing = {}, list(words)
        for w in missing:
            own = (w, *[w[:n] + b"*" for n in BEGINNINGS if len(w) >= n])
            self.seen[w] = tuple(self.known[f] for f in own if f in self.known)
        return set().union(*map(self.seen.__getitem__, words))

    def __call__(self, text: str) -> list[float]:
        """The probabilities in chain order."""
        places = list(self._places(text))
        sums, found = self.features[places].sum(axis=0), []
        for c, weights in enumerate(self.weights):
            value = sums[c] + np.dot(weights[self.features.shape[0] : -1], found) + weights[-1]
            found.append(float(sigmoid(value)))
        return found


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE,
          wanted: dict[str, Column] | None = None, label_id: str = "doc_id") -> Chain:
    """Fits the chain to labelled rows. Rows without id or with a category unknown are left out; repeated label rows count once."""
    wanted = wanted or categories()
    names = list(wanted)
    marked = labels.select(F.col(label_id).alias("id"), *[(c.cast("double") > 0.5).alias(n) for n, c in wanted.items()])
    marked = marked.dropna().groupBy("id").agg(*[F.max(n).alias(n) for n in names])
    # bounded by ``sample``, so it may be broadcast
    chosen = F.broadcast(marked.orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(doc_id).alias("id"), plain(text).alias("content")).join(chosen, "id").select("content", *names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, Counter] = {}
        for batch in batches:
            for content, *marks in rows_of(batch, "content", *names):
                totals.setdefault(tuple(marks), Counter()).update(features_of(content))
        for marks, counted in totals.items():
            n = len(counted)
            columns = [pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([m] * n) for m in marks]], names=["feature", "n", *names])

    kinds = ", ".join(f"`{n}` boolean" for n in names)
    counted = rows.mapInArrow(count, f"feature binary, n bigint, {kinds}")
    sizes = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(n).cast("int")).alias(n) for n in names]).first()
    sums = counted.groupBy("feature").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(n), F.col("n")).otherwise(0)).alias(n) for n in names]
    ).where(F.col("n") >= LEAST_ROWS)
    vocabulary: set[bytes] = set()
    for n in names:
        with_, without = (F.col(n) + 0.5) / ((sizes[n] or 0) + 1), (F.col("n") - F.col(n) + 0.5) / (sizes["n"] - (sizes[n] or 0) + 1)
        weight = F.abs(with_ - without) * F.abs(F.log(with_ / without))
        best = sums.where(F.abs(F.log(with_ / without)) >= LEAST_ODDS).orderBy(weight.desc(), "feature").limit(FEATURES // len(names)).select("feature")
        vocabulary |= {bytes(r["feature"]) for r in best.collect()}
    ordered = sorted(vocabulary)
    numbers = {f: i for i, f in enumerate(ordered)}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[numbers[f] for f in features_of(t) if f in numbers] for (t,) in rows_of(batch, "content")]
            places = pa.array([sorted(f) for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([places, *batch.columns[1:]], names=["places", *names])

    small = rows.mapInArrow(encode, f"places array<int>, {kinds}").collect()
    small.sort(key=lambda r: (r["places"], [r[n] for n in names]))  # whatever the order of the tasks
    mixed = np.random.default_rng(0).permutation(len(small))
    small = [small[i] for i in mixed]
    marks = np.array([[r[n] for n in names] for r in small], float).reshape(-1, len(names))
    return Chain(names, ordered, [np.array(r["places"], np.int64) for r in small], marks)


def score(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, a probability ``p_<category>`` for each, and ``rejected``: whether the last
    category's reaches the threshold, by default the one that suits the held-out rows best. NULL and empty texts have
    no features and are judged by the bias."""
    limit = chain.limit if threshold is None else threshold
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([chain(t) for (t,) in rows_of(batch, "content")]).reshape(-1, len(chain.names))
            columns = [pa.array(found[:, c]) for c in range(len(chain.names))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(found[:, -1] >= limit)], names=["doc_id", *names, "rejected"]
            )

    names = [f"p_{n}" for n in chain.names]
    schema = f"doc_id {kind}, " + ", ".join(f"`{n}` double" for n in names) + ", rejected boolean"
    return docs.select(F.col(doc_id).alias("doc_id"), plain(text).alias("content")).mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose last category stays below the threshold."""
    chain = train(docs, labels, doc_id, text)
    limit = chain.limit if threshold is None else threshold
    return keep_rows(docs, text, lambda content: chain(content)[-1] < limit)
