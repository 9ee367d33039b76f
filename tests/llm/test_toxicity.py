from __future__ import annotations

import numpy as np

from tests.llm import cases
from tidecast.llm import queries, toxicity


def test_held_out_documents(spark):
    """Fitted on one half of the labels, judged on the other."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    judged = toxicity.score(docs, chain).join(labels.where("doc_id % 2 = 1"), "doc_id").select("toxic", "rejected").collect()
    hits = sum(r["toxic"] and r["rejected"] for r in judged)
    false = sum(r["rejected"] and not r["toxic"] for r in judged)
    missed = sum(r["toxic"] and not r["rejected"] for r in judged)
    assert hits / (hits + missed) > 0.8 and false / sum(not r["toxic"] for r in judged) < 0.01


def test_query(spark, folder):
    found = queries.op4_toxicity_chain(spark, folder)
    assert found.columns == ["doc_id", "p_low_quality", "p_toxic", "rejected"]
    first = cases.as_rows(found)
    assert len(first) == 200 and first == cases.as_rows(queries.op4_toxicity_chain(spark, folder))
    assert all(0 <= r[1] <= 1 and 0 <= r[2] <= 1 for r in first)


def test_chain_feeds_earlier_probabilities():
    """The second category is the first one with the sign of a feature turned; alone its model would not see the first."""
    rng = np.random.default_rng(0)
    first = rng.random(600) < 0.5
    second = first ^ (rng.random(600) < 0.05)
    rows = [np.array([0] if a else [1]) for a in first]
    chain = toxicity.Chain(["a", "b"], [b"yes", b"no"], rows, np.column_stack([first, second]))
    assert chain.weights[1].size == chain.weights[0].size + 1 and chain.weights[1][2] > 0
    assert chain.held_out.shape == (600, 2)
    assert ((chain.held_out[:, 1] >= 0.5) == second).mean() > 0.9
    yes, no = chain("yes"), chain("no")
    assert yes[0] > 0.9 > 0.1 > no[0] and yes[1] > 0.8 and no[1] < 0.2


def test_fit_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(5) < 0.4) for _ in range(300)]
    y = np.array([float(0 in r) if rng.random() > 0.2 else 1.0 for r in rows])
    x = toxicity.Sparse(rows, 5, np.zeros((300, 0)))
    weights = toxicity.fit(x, y, rounds=3000)
    scaled = x.scaled(y)
    own = weights.copy()
    own[:5] /= scaled.value
    gradient = scaled.back(toxicity.sigmoid(scaled.times(own)) - y) / 300
    gradient[:-1] += toxicity.RIDGE * own[:-1]
    assert np.abs(gradient).max() < 1e-5


def test_best_limit():
    found, y = np.array([0.9, 0.8, 0.3, 0.1]), np.array([1.0, 1.0, 0.0, 0.0])
    assert 0.3 < toxicity.best_limit(found, y) < 0.8
    assert toxicity.best_limit(found, np.zeros(4)) == 0.5
    assert toxicity.best_limit(np.full(3, 0.4), np.array([1.0, 0, 1])) < 0.4


def test_tricky_rows(spark):
    docs, labels = cases.tricky(spark), cases.labels(spark)
    chain = toxicity.train(docs, labels)
    assert toxicity.score(docs, chain).count() == docs.count()
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.schema == docs.schema
    # nothing toxic is known here
    assert kept.count() == docs.count()
    assert toxicity.remove_toxic(cases.empty(docs), labels).count() == 0
    assert toxicity.remove_toxic(docs, labels.limit(0)).count() == docs.count()
