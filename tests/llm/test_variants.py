from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

from tests import oracle
from tests.llm import cases
from tidecast.llm import queries, variants


def near(a, b):
    """One edit, by trying all of them."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_groups(counts, factor=5):
    out, forms = [], {}
    around = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if near(a, b):
            around[a].append(b)
            around[b].append(a)
    for word in counts:
        best = min(around[word], key=lambda w: (-counts[w], w), default=None)
        forms[word] = best if best and counts[best] >= factor * counts[word] else None
    for word, n in counts.items():
        root = word
        while forms[root]:
            root = forms[root]
        form = forms[word]
        out.append((word, form, root, n, len(around[word]), counts[form] if form else None))
    return sorted(out, key=str)


def brute_counts(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            found[word if h % 199 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def test_groups_against_all_pairs(spark):
    """Words over few letters, so that ranges are full, equal letters stand in a row, and forms are chains and ties."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randrange(3, 9))) for _ in range(400)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "aaaaaaaa", "éaaaaa"}
    counts = {w: rng.choice([5, 5, 6, 25, 30, 125, 200, 1000, 6000]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = cases.as_rows(variants.groups(frame))
    assert found == brute_groups(counts)
    assert any(root != form for _, form, root, *_ in found if form)


def test_every_edit_is_found_once(spark):
    base = "balloon"
    letters = "abnzé"
    others = {base[:i] + c + base[i:] for i in range(8) for c in letters} | {base[:i] + base[i + 1 :] for i in range(7)}
    others |= {base[:i] + c + base[i + 1 :] for i in range(7) for c in letters}
    others.discard(base)
    frame = spark.createDataFrame([(base, 1)] + [(w, 2) for w in others], "word string, n bigint")
    row = variants.neighbours(frame).where(f"word = '{base}'").first()
    assert row["n_near"] == len(others) and row["near"] == min(others) and row["near_n"] == 2


def test_counts_and_slips(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r["word"]: r["n"] for r in variants.word_counts(docs, variants.with_slips).collect()} == brute_counts(rows)
    assert cases.as_rows(queries.op13_spelling_variants(spark, folder)) == brute_groups(brute_counts(rows))


def test_tricky_rows_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 3)
    docs = cases.tricky(spark)
    docs = docs.unionByName(docs).unionByName(docs)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r["word"]: r["n"] for r in variants.word_counts(docs, variants.with_slips).collect()} == brute_counts(rows)
    assert variants.groups(variants.word_counts(cases.empty(docs))).count() == 0
    mixed = spark.createDataFrame([("ÀÉ×÷ß ÀÉ×÷ßa " * 5 + "x" * 50_000,)], "text string").selectExpr("1 AS doc_id", "text")
    assert {r["word"] for r in variants.word_counts(mixed, least=1).collect()} == {"ÀÉ×÷ßa", "x" * 50_000}


def test_sql_twin(spark, folder):
    tables = oracle.connect(folder)
    assert oracle.compare(spark, tables, folder, "op13", queries.op13_spelling_variants, variants.ORACLE_SLIPS) is None
