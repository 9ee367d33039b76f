from __future__ import annotations

import itertools
import random

import numpy as np
import xxhash

from tests.llm import cases
from tidecast.llm import queries, simhash
from tidecast.llm.graph import components


def plain_print(text: str) -> int:
    """The contract word by word."""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_force(rows):
    """Component ids by comparing all pairs."""
    prints = [plain_print(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((k, f"{p:016x}", least.get(find(i))) for i, ((k, _), p) in enumerate(zip(rows, prints))), key=str)


def test_query_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert cases.as_rows(queries.op1_simhash_near_dedup(spark, folder)) == brute_force([tuple(r) for r in docs])


def test_tricky_rows(spark):
    docs = cases.tricky(spark)
    found = simhash.classes(docs).select("doc_id", queries.unsigned_hex("fp"), "component_id")
    assert cases.as_rows(found) == brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert simhash.classes(cases.empty(docs)).count() == 0


def test_keep_one(spark):
    docs = cases.tricky(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # 3 and 4 are copies; texts without words are one class; rows without id stay
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 5, 7, 8]
    assert simhash.keep_one(cases.empty(docs)).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(5)
    for bits in (list(range(64)), [b for b in range(64) if b % 2]):
        found = simhash.masks(4, bits)
        assert len(found) == 31
        for _ in range(2000):
            differing = sum(1 << b for b in rng.sample(bits, rng.randint(0, 4)))
            assert any(not m & differing for m in found)


def test_second_level_buckets_are_bounded():
    for m in simhash.masks(4, list(range(64))):
        free = [b for b in range(64) if not m >> b & 1]
        assert all(64 - (m | k).bit_count() <= 17 for k in simhash.masks(4, free))


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    centre = rng.getrandbits(63)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 9))) for _ in range(600)}
    prints |= {rng.getrandbits(63) for _ in range(200)}
    frame = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    monkeypatch.setattr(simhash, "BUCKET", 16)
    found = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    left, want = set(prints), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            here = todo.pop()
            group.append(here)
            near = {p for p in left if (p ^ here).bit_count() <= 4}
            left -= near
            todo += near
        want |= {p: min(group) for p in group if len(group) > 1}
    assert found == want


def test_forest_and_components(spark):
    members = np.array([0, 1, 3, 7, 255, 254, 0xFFFF << 40], np.int64)
    edges = simhash.forest(members, 2)
    assert len(edges) == 4
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
