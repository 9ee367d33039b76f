from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tidecast.llm import prefixes, queries
from tidecast.llm.prefixes import Prefixes, fingerprint, likeness, sketch_of


def slow_value(text: str) -> int:
    value = 0
    for base in prefixes.BASES:
        value = value << 31 | sum((ord(c) + 1) * pow(base, j, prefixes.PRIME) for j, c in enumerate(text)) % prefixes.PRIME
    return value


def expected(rows):
    """Next documents and edited texts by sorting on the driver."""
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], (r[1] or "").encode()))
    out = []
    for i, (key, text) in enumerate(known):
        text, following = text or "", known[(i + 1) % len(known)][1] or ""
        out.append((key, text, following))
    out += [(None, t or "", "") for k, t in rows if k is None]
    found = []
    for key, text, following in out:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        one, two, three = (fingerprint(t) for t in (text, edited, following))
        common = next((i for i, (a, b) in enumerate(zip(text, edited)) if a != b), min(len(text), len(edited)))
        found.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), one[0], two[0], likeness(one[1], two[1]),
                      likeness(one[1], three[1]), common))
    return sorted(found, key=str)


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert cases.as_rows(queries.op2_document_fingerprints(spark, folder)) == expected(rows)


def test_tricky_rows(spark):
    docs = cases.tricky(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert cases.as_rows(prefixes.with_edited(docs)) == expected(rows)
    assert prefixes.with_edited(cases.empty(docs)).count() == 0
    alone = docs.where("doc_id = 1")
    assert cases.as_rows(prefixes.with_edited(alone)) == expected([tuple(r) for r in alone.select("doc_id", "text").collect()])
    assert prefixes.fingerprints(docs).count() == docs.count()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abé\U0001f600", max_size=60), st.text(alphabet="abé\U0001f600", max_size=60), st.data())
def test_spans_and_extensions(one, other, data):
    mine, its = Prefixes(one), Prefixes(other)
    assert mine.span(0, len(one)) == slow_value(one)
    i, j = data.draw(st.integers(0, len(one))), data.draw(st.integers(0, len(other)))
    n = 0
    while i + n < len(one) and j + n < len(other) and one[i + n] == other[j + n]:
        n += 1
    assert mine.extension(i, its, j) == n


def test_fingerprint_forms(monkeypatch):
    text = cases.LONG[:5000]
    whole = fingerprint(text)
    assert whole[0].split("-")[1] == f"{slow_value(text):016x}"
    assert (sketch_of(whole[0]) == whole[1]).all()
    monkeypatch.setattr(prefixes, "BLOCK", 64)  # a text is the same in blocks
    assert fingerprint(text)[0] == whole[0]
    assert prefixes.common_prefix(text, text[:777] + "#" + text[778:]) == 777
    assert fingerprint("")[0] == "0-" + "0" * 16 + "-" + "0" * 512
    assert fingerprint("ab")[0] != fingerprint("ba")[0]


def test_likeness_follows_what_is_shared():
    import random

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    other = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    own = fingerprint(text)[1]
    near = [likeness(own, fingerprint(text[: 4000 - k] + other[:k])[1]) for k in (0, 200, 2000, 4000)]
    assert near[0] == 1.0 and near[1] > 0.7 and 0.15 < near[2] < 0.6 and near[3] < 0.1
