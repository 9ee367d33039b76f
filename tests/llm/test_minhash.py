from __future__ import annotations

import itertools
import random

import numpy as np

import corpus_pipeline
from tests.llm import cases
from tidecast.llm import minhash, simhash


def word_sets(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_force(rows):
    """The ids that stay, by comparing all pairs exactly."""
    sets = [word_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if similarity(sets[i], sets[j]) >= 0.8:
            root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted(least.values())


def edited(rng, words, low, high):
    """A copy with single words replaced until its similarity is in the range."""
    copy = list(words)
    while True:
        copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**9)}"
        found = similarity(word_sets(" ".join(words)), word_sets(" ".join(copy)))
        if found < low:
            copy = list(words)
        elif found < high:
            return copy


def test_copies_between_0_8_and_1_go_in_the_stage(spark, folder):
    rng = random.Random(8)
    rows, planted = [], []
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(100, 400))]
        rows.append((10 * i, " ".join(words)))
        for k, (low, high) in enumerate([(0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.0)], 1):
            rows.append((10 * i + k, " ".join(edited(rng, words, low, high))))
        rows.append((10 * i + 5, " ".join(edited(rng, words, 0.55, 0.7))))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = sorted(r["doc_id"] for r in stage(spark, frame, folder).collect())
    assert kept == brute_force(rows) == sorted([10 * i for i in range(40)] + [10 * i + 5 for i in range(40)])


def test_crowded_bands_lose_no_link(spark, monkeypatch):
    """One large group of edited copies, chains through it included: by pivots, by blocks, by pairs of small blocks, by rows."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.6, 1.0))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = brute_force(rows)
    for crowded, closed, nodes in ((8, 0.5, 2048), (2, 0.0, 2048), (2, 1.1, 2048), (4, 1.1, 7), (10**9, 0.5, 2048)):
        monkeypatch.setattr(minhash, "CROWDED", crowded)
        monkeypatch.setattr(minhash, "CLOSED", closed)
        monkeypatch.setattr(minhash, "NODES", nodes)
        assert sorted(r["doc_id"] for r in minhash.keep_one(frame).collect()) == wanted


def test_common_part_below_the_limit_makes_no_pairs(spark, monkeypatch):
    """Texts that share 120 words and have 42 of their own are no copies; the pairs that become rows grow with the texts only."""
    rng, made = random.Random(10), []
    plain = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, sets: (made.append(pairs.count()), plain(pairs, sets))[1])
    common, total = " ".join(f"w{i}" for i in range(120)), []
    for n in (200, 400, 800):
        rows = [(i, common + " " + " ".join(f"own{rng.randrange(10**9)}" for _ in range(42))) for i in range(n)]
        frame = spark.createDataFrame(rows + [(n, rows[3][1] + " more")], "doc_id bigint, text string")
        made.clear()
        assert sorted(r["doc_id"] for r in minhash.keep_one(frame).collect()) == list(range(n))
        total.append(sum(made))
    assert total[2] <= 5 * total[0] and total[2] <= 4 * 800


def test_sets_of_candidates_only_are_written(spark, monkeypatch):
    """Texts that share nothing with another leave no set on disk; a set that is written is whole and stands once."""
    rng, written = random.Random(12), []
    plain = minhash.settle
    monkeypatch.setattr(minhash, "settle", lambda frame: (written.append(plain(frame)), written[-1])[1])
    monkeypatch.setattr(minhash, "discard", lambda *frames: None)
    rows = [(i, " ".join(f"own{rng.randrange(10**9)}" for _ in range(60))) for i in range(50)]
    rows += [(50, rows[0][1] + " more"), (51, rows[0][1] + " more"), (52, (rows[0][1] + " more").upper()), (53, None), (53, None), (None, rows[1][1])]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, *range(50), 53]
    sets = [f for f in written if "grams" in f.columns]
    assert len(sets) == 1
    texts = {rows[0][1], rows[50][1]}
    assert sorted(sorted(r["grams"]) for r in sets[0].collect()) == sorted(sorted(minhash.shingles(t.encode()).view(np.int64).tolist()) for t in texts)


def test_fingerprints_link_before_bands(spark, folder, monkeypatch):
    """Where bands share nothing, op1's fingerprints still find copies that differ little; the exact similarity decides."""
    rng, words = random.Random(13), [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(6)]
    rows = [(10 * i + k, t + f" more{k}" * (k > 0)) for i, t in enumerate(texts) for k in range(3)]
    chant = "one two three four five " * 100
    rows += [(100 + k, chant + " ".join(f"own{k}x{j}" for j in range(20))) for k in range(2)]
    prints = [simhash.simhash(t.encode(), 5) for _, t in rows]
    assert (prints[-1] ^ prints[-2]).bit_count() <= simhash.RADIUS and similarity(word_sets(rows[-1][1]), word_sets(rows[-2][1])) < 0.2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    made, plain = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, sets: (made.append(pairs.count()), plain(pairs, sets))[1])
    wanted = brute_force(rows)
    assert wanted == [0, 10, 20, 30, 40, 50, 100, 101]
    assert sorted(r["doc_id"] for r in stage(spark, frame, folder).collect()) == wanted
    assert made[0] >= 12 and made[2:] == [0]
    monkeypatch.setattr(minhash, "bands", lambda found: np.zeros(0, np.int64))
    assert sorted(r["doc_id"] for r in stage(spark, frame, folder).collect()) == wanted


def test_links_of_a_chain_of_fingerprints_are_all_compared(spark):
    """A link goes unseen only where its ends are in one class; one link a node would leave the third text alone."""
    sets = spark.createDataFrame([(1, list(range(0, 10))), (2, list(range(100, 200))), (3, list(range(101, 200)))], "node bigint, grams array<bigint>")
    links = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "u bigint, v bigint")
    assert [tuple(r) for r in minhash._first_classes(links, sets).collect()] == [(3, 2)]


def test_forest_is_exact():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**60, 60, dtype=np.int64)
    sets = [np.unique(np.where(rng.random(60) < 0.13, rng.integers(0, 2**60, 60), base)) for _ in range(80)] + [np.array([5]), np.array([5, 6])]
    nodes, labels = np.arange(82), np.arange(82) // 2
    root = {int(k): int(k) for k in labels}

    def find(k):
        return k if root[k] == k else find(root[k])

    for i, j in itertools.combinations(range(82), 2):
        if similarity(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8:
            root[find(int(labels[j]))] = find(int(labels[i]))
    wanted = [find(int(k)) for k in labels]
    edges = minhash.forest(nodes, labels, sets)
    assert all(similarity(set(sets[u].tolist()), set(sets[v].tolist())) >= 0.8 for u, v in edges)
    root = {int(k): int(k) for k in labels}
    for u, v in edges:
        root[find(int(labels[v]))] = find(int(labels[u]))
    mine = [find(int(k)) for k in labels]
    assert len(set(zip(wanted, mine))) == len(set(wanted)) == len(set(mine)) > 3


def test_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in minhash.keep_one(docs).collect()) == brute_force(rows)
    tricky = cases.tricky(spark)
    kept = minhash.keep_one(tricky)
    assert kept.columns == tricky.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 5, 7, 8]
    assert minhash.keep_one(cases.empty(tricky)).count() == 0
