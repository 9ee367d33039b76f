from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from tidecast.llm import mixing, queries


def words_of(text):
    return (text or "").encode().split()


def shared(sizes, weights, share, most):
    """Targets by rounds of sharing: what is above its limit is cut, the excess goes by weight to those below."""
    found = [share * sum(sizes) * w / sum(weights) for w in weights]
    while any(f > most * n + 1e-9 for f, n in zip(found, sizes)):
        excess = sum(max(f - most * n, 0) for f, n in zip(found, sizes))
        found = [min(f, most * n) for f, n in zip(found, sizes)]
        open_ = [i for i, (f, n) in enumerate(zip(found, sizes)) if f < most * n]
        for i in open_:
            found[i] += excess * weights[i] / sum(weights[k] for k in open_)
    return found


def test_targets():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.choice([0, 1, 5, 100, 10_000]) for _ in range(rng.randrange(1, 12))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        found = mixing.targets(sizes, weights)
        assert found == pytest.approx(shared(sizes, weights, 1.5, 2))
        assert sum(found) == pytest.approx(1.5 * sum(sizes)) and all(f <= 2 * n for f, n in zip(found, sizes))
    assert mixing.targets([], []) == [] and mixing.targets([10, 10], [0, 1]) == [0, 20]


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        orders = [mixing.permuted(np.arange(n), n, key) for key in (0, 1, 2**63)]
        assert all(sorted(o) == list(range(n)) for o in orders)
    assert not np.array_equal(orders[0], orders[1])
    assert abs(np.corrcoef(orders[0], np.arange(4097))[0, 1]) < 0.1
    # a place alone, far out in a range that is never held
    assert 0 <= int(mixing.permuted(np.array([10**15]), 10**15 + 7, 3)[0]) < 10**15 + 7


def check(plan, docs, most, block, slots):
    """The slots' blocks rebuilt from plain lists of words; returns the words taken per row."""
    sources = {r["number"]: r for r in plan.sources.collect()}
    rows = plan.rows.collect()
    streams = {}
    for number in sources:
        mine = sorted((r for r in rows if r["number"] == number), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["digest"], r["row"]))
        stream = []
        for r in mine:
            assert r["before"] == len(stream)
            stream += [r["row"]] * r["size"]
        streams[number] = stream
    found = plan.slots.collect()
    uses = Counter((r["number"], r["block"]) for r in found)
    for number, r in sources.items():
        blocks = -(-len(streams[number]) // block)
        times = [uses[number, b] for b in range(blocks)]
        assert sum(times) == r["quota"] and r["source_size"] == len(streams[number]) and r["blocks"] == blocks
        assert not times or max(times) - min(times) <= 1 and max(times) <= most
        assert not blocks or abs(r["quota"] * r["source_size"] / blocks - r["target"]) <= block / 2
    shards = Counter(r["shard"] for r in found)
    assert all(shards[s] == slots for s in range(len(shards) - 1))
    assert all({r["slot"] for r in found if r["shard"] == s} == set(range(n)) for s, n in shards.items())
    taken = Counter()
    for (number, b), n in uses.items():
        for row in streams[number][b * block : (b + 1) * block]:
            taken[row] += n
    spans = Counter()
    for r in plan.spans().collect():
        spans[r["row"]] += r["n_words"]
    assert spans == taken
    return taken


def test_plan_against_plain_lists(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = mixing.mix(docs, (5, 2, 1), block=16, slots=1000, with_text=True)
    check(plan, docs, 2, 16, 1000)
    words = {}
    for r in sorted(plan.rows.collect(), key=lambda r: (r["number"], r["before"], r["size"])):
        words.setdefault(r["number"], []).extend(words_of(r["text"]))
    for r in plan.texts().collect():
        assert r["text"].encode().split(b" ") == words[r["number"]][16 * r["block"] : 16 * r["block"] + 16]


def test_surplus_moves_to_who_lacks(spark):
    """Many shards with few slots: independent draws miss the quotas, the plan does not. A source that is a third of all rows."""
    docs = spark.createDataFrame(
        [(i, "w " * (i % 50), "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(600)], "doc_id int, text string, source string")
    plan = mixing.mix(docs, {"hot": 1, **{f"s{i}": 0.1 * i for i in range(11)}}, share=0.5, most=1, block=4, slots=7)
    check(plan, docs, 1, 4, 7)


def test_draws_are_multinomial(spark):
    quotas = np.array([6000, 3000, 1000])
    draws = mixing._draws(spark, quotas, 100, 5).toPandas().pivot_table(index="shard", columns="number", values="n", fill_value=0)
    shares = quotas / 10_000
    spread = draws.to_numpy().var(axis=0) / (100 * shares * (1 - shares))
    assert len(draws) == 100 and np.all(np.abs(draws.to_numpy().mean(axis=0) - 100 * shares) < 2)
    assert np.all(spread > 0.6) and np.all(spread < 1.6)


def test_query_reruns_agree(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = cases.as_rows(mixing.taken(docs))
    assert first == cases.as_rows(mixing.taken(docs.repartition(13, "text")))
    query = queries.op12_source_mixing(spark, folder)
    assert query.columns == ["doc_id", "size", "source_size", "target", "taken"] and cases.as_rows(query) == sorted((r[:1] + r[2:] for r in first), key=str)
    sums, target = Counter(), {}
    for _, source, size, _, wanted, taken in first:
        sums[source] += taken
        target[source] = wanted
        assert taken <= 2 * size
    assert all(abs(sums[s] - t) <= 1.5 * 64 for s, t in target.items())


def test_tricky_rows_and_empty_tables(spark):
    docs = cases.tricky(spark).selectExpr("doc_id", "text", "lang", "lang AS source", "slot", "shard", "word", "part")
    found = mixing.taken(docs).collect()
    assert sorted(r["size"] for r in found) == sorted(len(words_of(r["text"])) for r in docs.collect())
    assert all(r["taken"] <= 2 * r["size"] for r in found) and {r["source"] for r in found} == {"en", "de", "fr", "xx", None}
    check(mixing.mix(docs, (5, 2, 1)), docs, 2, 64, 1 << 16)
    assert mixing.taken(cases.empty(docs)).count() == 0
    assert {r["taken"] for r in mixing.taken(docs.where("text IS NULL")).collect()} == {0}
