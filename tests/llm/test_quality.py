from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import cases
from tidecast.llm import quality, queries
from tidecast.llm.quality import END, ORDER, START, SYMBOLS


def listed(text):
    own = [ord(c) if ord(c) < 128 else 128 + ord(c) % 128 for c in text or ""]
    return [START] * (ORDER - 1) + own + [END]


def grams(text):
    s = listed(text)
    return [tuple(s[i - ORDER + 1 : i + 1]) for i in range(ORDER - 1, len(s))]


class Plain:
    """The model from dictionaries, by the recursion of the formula."""

    def __init__(self, texts):
        self.n = {ORDER: Counter(g for t in texts for g in grams(t))}
        for length in range(ORDER - 1, 0, -1):
            self.n[length] = Counter(g[1:] for g in self.n[length + 1])
        self.d, self.of = {}, {}
        for length, counted in self.n.items():
            few = Counter(counted.values())
            n1, n2, n3, n4 = (few[k] for k in (1, 2, 3, 4))
            self.d[length] = [0.5, 1.0, 1.5]
            if n1 and n2 and n3:
                y = n1 / (n1 + 2 * n2)
                own = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
                self.d[length] = [d if 0 < d < k else k / 2 for k, d in enumerate(own, 1)]
            self.of[length] = defaultdict(dict)
            for g, n in counted.items():
                self.of[length][g[:-1]][g[-1]] = n

    def p(self, gram):
        if not gram:
            return 1 / SYMBOLS
        length, seen = len(gram), self.of[len(gram)].get(gram[:-1])
        if not seen:
            return self.p(gram[1:])
        off = lambda n: self.d[length][min(n, 3) - 1] if n else 0.0
        total, own = sum(seen.values()), seen.get(gram[-1], 0)
        return (own - off(own)) / total + sum(map(off, seen.values())) / total * self.p(gram[1:])

    def log_p(self, text):
        return sum(math.log(self.p(g)) for g in grams(text))


@pytest.fixture(scope="module")
def corpus(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs, spark.read.parquet(f"{folder}/labels.parquet")


def test_model_equals_the_formula(spark, corpus):
    docs, _ = corpus
    trained = [r["text"] for r in docs.where("doc_id < 40").collect()]
    plain = Plain(trained)
    texts = [r["text"][:1500] for r in docs.where("doc_id between 30 and 60").collect()] + ["", None, "ZZZ %%% \U0001f600"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    whole = quality.model(docs.where("doc_id < 40"))
    for shard_rows in (10**9, 5_000):  # one shard or several: the same sums
        found = quality.with_log_p(frame, whole, shard_rows=shard_rows).orderBy("doc_id").collect()
        for row, text in zip(found, texts):
            assert row["n_symbols"] == len(text or "") + 1
            assert row["log_p"] == pytest.approx(plain.log_p(text), rel=1e-9)
    some = [g for g in list(plain.n[ORDER])[:20]]
    for g in some:  # the probabilities after a context sum to one
        assert sum(plain.p((*g[:-1], s)) for s in range(SYMBOLS)) == pytest.approx(1.0)


def test_query_separates_junk(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op10_quality_perplexity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = found.join(labels, "doc_id").select("quality", "keep").collect()
    good, poor = [r["keep"] for r in rows if r["quality"] == 1], [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(poor) < 0.4
    assert found.count() == 1000
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    junk = {r["doc_id"]: r["keep"] for r in found.collect() if "%%%" in texts[r["doc_id"]] or "!! " in texts[r["doc_id"]]}
    assert np.mean(list(junk.values())) < 0.05


def test_limits_are_quantiles_of_trusted_text(spark, corpus):
    docs, labels = corpus
    scores, limits, _ = quality.judged(docs, labels, quantile=0.8)
    trusted = {r["trusted_id"] for r in quality.trusted_ids(labels).collect()}
    by = defaultdict(list)
    for r in scores.collect():
        if r["doc_id"] in trusted:
            by[r["lang"]].append(r["perplexity"])
    found = {r["lang"]: r["limit"] for r in limits.collect()}
    assert found == {g: sorted(v)[math.ceil(0.8 * len(v)) - 1] for g, v in by.items()}


def test_tricky_rows(spark):
    docs, labels = cases.tricky(spark), cases.labels(spark)
    scores, limits, _ = quality.judged(docs, labels)
    assert scores.count() == docs.count()
    # 3 and 4: 4 contradicts itself; NULL languages are one group
    assert {r["lang"] for r in limits.collect()} == {"en", "de", ""}
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} >= {1, 3, 4, 7, 6, 8}
    assert quality.keep_good(cases.empty(docs), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()
