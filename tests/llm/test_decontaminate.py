from __future__ import annotations

import random

import numpy as np

from tests.llm import cases
from tidecast.llm import decontaminate, queries
from tidecast.llm.decontaminate import GAP, MATCH, MISMATCH, align, words_of


def slow_score(item, passage):
    """Smith and Waterman's table cell by cell."""
    best, row = 0, [0] * (len(passage) + 1)
    for a in item:
        before, row = row, [0] * (len(passage) + 1)
        for j, b in enumerate(passage, 1):
            row[j] = max(0, before[j - 1] + (MATCH if a == b and a >= 0 else MISMATCH), before[j] + GAP, row[j - 1] + GAP)
            best = max(best, row[j])
    return best


def test_align_equals_the_table():
    rng = random.Random(2)
    for _ in range(300):
        item = np.array([rng.randint(0, 5) for _ in range(rng.randint(1, 15))])
        passage = np.array([rng.randint(-1, 5) for _ in range(rng.randint(1, 25))])
        score, start, end = align(item, passage)
        assert score == slow_score(item.tolist(), passage.tolist())
        # the stretch told gives the score by itself
        assert slow_score(item.tolist(), passage[start:end].tolist()) == score


def test_no_alignment_exceeds_its_bounds():
    rng = random.Random(5)
    for _ in range(300):
        item = np.array([rng.randint(0, 9) for _ in range(rng.randint(1, 12))])
        passage = np.array([rng.randint(-1, 14) for _ in range(rng.randint(1, 25))])
        score = slow_score(item.tolist(), passage.tolist())
        shared = decontaminate.among(passage, np.unique(item))
        assert shared.tolist() == [p in item for p in passage.tolist()]
        assert score <= decontaminate.bound(shared) and score <= decontaminate.bound(np.isin(item, passage))


def test_query_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    vocabulary = {}
    number = lambda text: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text or "")])
    tests = [(r["item_id"], number(r["text"])) for r in items]
    want = {}
    for key, text in docs:
        words = number(text)
        for item_id, item in tests:
            # a pair that shares few words cannot reach the limit
            if np.isin(item, words).mean() >= decontaminate.THRESHOLD:
                score = align(item, words)[0] / (MATCH * item.size)
                if score >= decontaminate.THRESHOLD:
                    want[key, item_id] = score
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in queries.op3_decontamination(spark, folder).collect()}
    assert found == want and want


def test_edited_copies_are_found_and_clean_text_is_not(spark):
    rng = random.Random(4)
    lexicon = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: [rng.choice(lexicon) for _ in range(n)]
    items = [text(40) for _ in range(30)]
    docs, wanted = [], set()
    for i in range(120):
        body = text(200)
        if i % 3 == 0:
            item = items[i % 30]
            edited = [w for w in (rng.choice(lexicon) if rng.random() < 0.2 else w for w in item) if rng.random() > 0.05]
            body[50:50] = edited
            wanted.add((i, i % 30))
        docs.append((i, " ".join(body).title()))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    tests = spark.createDataFrame([(i, " ".join(t) + ".") for i, t in enumerate(items)], "item_id bigint, text string")
    found = decontaminate.contaminated(frame, tests).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == wanted
    assert all(40 <= r["first_word"] <= 60 and 75 <= r["end_word"] <= 100 for r in found)
    # blocks of items give the same
    again = decontaminate.contaminated(frame, tests, block_chars=2000)
    assert cases.as_rows(again) == cases.as_rows(decontaminate.contaminated(frame, tests))
    kept = decontaminate.remove_contaminated(frame, tests)
    assert {r["doc_id"] for r in kept.collect()} == set(range(120)) - {d for d, _ in wanted}


def test_tricky_rows(spark):
    docs = cases.tricky(spark)
    items = spark.createDataFrame(
        [(1, "the lazy dog mit license"), (2, None), (3, ""), (3, "ein paar Wörter"), (None, "no id for this one"), (4, "sorry")],
        "item_id bigint, text string",
    )
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 1), (3, 3), (4, 3), (None, None), (None, 4)}
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.schema == docs.schema and kept.count() == docs.count() - 4
    assert decontaminate.contaminated(cases.empty(docs), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0
    assert decontaminate.remove_contaminated(docs, items.limit(0)).count() == docs.count()


def test_seeds_are_in_every_stretch():
    grams = np.arange(1, 30, dtype=np.uint64)
    places = decontaminate.seeds(grams, {int(g): 100 + int(g) % 5 for g in grams})
    assert max(np.diff([-1, *places, 29])) <= decontaminate.STRIDE
    assert decontaminate.seeds(grams[:2], {1: 5}) == [1]


def test_regular_edits_of_a_single_copy(spark):
    """Every 4th, 5th or 6th word replaced, each item in one document only; brute force tells what is above the limit."""
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    items = [text(rng.choice([20, 40, 60])) for _ in range(90)]
    docs = []
    for i, item in enumerate(items):
        step = 4 + i % 3
        copy = [f"x{rng.randrange(4000)}" if k % step == i % step else w for k, w in enumerate(item)]
        body = text(150)
        body[70:70] = copy
        docs.append((i, " ".join(body)))
    # full copies of some, so that what an edit destroyed stands in documents too
    docs += [(1000 + i, " ".join(text(30) + items[i] + text(30))) for i in range(0, 90, 4)]
    vocabulary, want = {}, {}
    number = lambda words: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words])
    for key, content in docs:
        words = number(content.split())
        for i, item in enumerate(items):
            score = align(number(item), words)[0] / (MATCH * len(item))
            if score >= decontaminate.THRESHOLD:
                want[key, i] = score
    assert set(want) == {(i, i) for i in range(90)} | {(1000 + i, i) for i in range(0, 90, 4)}
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    tests = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(frame, tests).collect()}
    assert found == want


def test_common_wording_keeps_a_seed():
    grams = np.arange(1, 30, dtype=np.uint64)
    assert decontaminate.all_seeds(grams, {5: 1, 6: 2}, set()) == [4, 5]
    places = decontaminate.all_seeds(grams, {g: 100 + g % 5 for g in range(2, 30)}, set(range(1, 30)))
    assert 0 not in places and len(places) < 12 and max(np.diff([0, *places, 29])) <= decontaminate.STRIDE


def test_excerpt_of_a_long_item(spark):
    rng = random.Random(7)
    text = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    item = text(400)
    excerpts = {1: item[100:250], 2: item[350:], 3: item[:45], 4: []}
    docs = [(k, " ".join(text(60) + part + text(60))) for k, part in excerpts.items()]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    tests = spark.createDataFrame([(9, " ".join(item))], "item_id bigint, text string")
    found = {r["doc_id"]: r for r in decontaminate.contaminated(frame, tests).collect()}
    # 45 words are neither a long run nor a large share
    assert set(found) == {1, 2}
    assert found[1]["score"] == 0.375 and (found[1]["first_word"], found[1]["end_word"]) == (60, 210)
    assert {r["doc_id"] for r in decontaminate.remove_contaminated(frame, tests).collect()} == {3, 4}


def test_every_edit_above_the_limit_leaves_a_seed(spark):
    """Words replaced, deleted and inserted at regular and at random places, in items of 15 to 100 words: whatever the
    alignment puts above the limit is found."""
    rng = random.Random(9)
    lexicon = [f"w{i}" for i in range(20_000)]
    fresh = iter(range(10**9))
    new = lambda: f"n{next(fresh)}"
    edits = {}
    for k in (3, 4, 5, 6):
        edits[f"replace {k}"] = lambda i, w, k=k: [new() if i % k == k - 1 else w]
        edits[f"delete {k}"] = lambda i, w, k=k: [] if i % k == k - 1 else [w]
    for k in (2, 3):
        edits[f"insert {k}"] = lambda i, w, k=k: [w, new()] if i % k == k - 1 else [w]
    for p in (0.2, 0.3, 0.4):
        edits[f"random {p}"] = lambda i, w, p=p: [new() if rng.random() < p else w]
    items, docs, cells = [], [], {}
    for size in (15, 40, 100):
        for name, edit in edits.items():
            for _ in range(12 if "random" in name else 2):
                item = rng.sample(lexicon, size)
                copy = [x for i, w in enumerate(item) for x in edit(i, w)]
                number = {w: i for i, w in enumerate(item)}
                place = lambda words: np.array([number.get(w, -1) for w in words])
                if align(place(item), place(copy))[0] >= decontaminate.THRESHOLD * MATCH * size:
                    cells[len(items)] = (size, name)
                docs.append((len(items), " ".join([*rng.sample(lexicon, 30), *copy, *rng.sample(lexicon, 30)])))
                items.append((len(items), " ".join(item)))
    assert {name for _, name in cells.values()} == set(edits)
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                       spark.createDataFrame(items, "item_id bigint, text string")).collect()
    own = {r["doc_id"] for r in found if r["doc_id"] == r["item_id"]}
    assert not {cells[k] for k in cells if k not in own}


def test_ties_give_the_first_passage(spark):
    words = [f"w{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join(["x"] * 30 + words + ["y"] * 40 + words))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 7, 1.0, 30, 50)]
