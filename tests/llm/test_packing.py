from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm import cases
from tidecast.llm import packing, queries


def ids_of(texts):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    return [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in texts]


def check_pieces(pieces, docs, window):
    """Every id of every document in one piece, sequences gapless, at most the tier sizes of one window short per task."""
    want = {}
    for (key, _), ids in zip(docs, ids_of([t for _, t in docs])):
        want.setdefault(key, []).append(ids)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == want.keys()
    for key, copies in want.items():
        assert sum(p["length"] for p in by_doc[key]) == sum(c.size for c in copies)
        if len(copies) == 1:
            at = 0
            for p in sorted(by_doc[key], key=lambda p: p["start"]):
                part = copies[0][p["start"] : p["start"] + p["length"]]
                assert p["start"] == at and p["doc_tokens"] == copies[0].size and p["ids_crc32"] == zlib.crc32(part.tobytes())
                at += p["length"]
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == members[0]["window"] <= window and at & (at - 1) == 0


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    pieces = queries.op8_hierarchical_packing(spark, folder).collect()
    check_pieces(pieces, docs, 1024)
    per_step = {}
    for p in pieces:
        per_step.setdefault((p["window"], p["step"]), set()).add(p["sequence_id"])
    for (window, step), members in per_step.items():
        full = packing.STEP_TOKENS // window
        assert len(members) == full or (len(members) < full and (window, step + 1) not in per_step)


def test_tricky_rows(spark):
    docs = cases.tricky(spark)
    pieces = packing.pack(docs, queries.tokenizer_path(), window=64, ids=True).collect()
    check_pieces(pieces, docs.select("doc_id", "text").collect(), 64)
    assert all(len(p["ids"]) == p["length"] and zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)
    assert packing.pack(cases.empty(docs), queries.tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, queries.tokenizer_path(), window=1000)


def test_encoder_gives_the_ids_of_tokenizers(spark, folder):
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    texts += ["", " ", "a  b", " a b ", "a\n b c", "x <|endoftext|> y", "it's we'll 'd  ", "　a \xa0b", "1 2 3\t4", "a\x1cb", "\r\n", "a\n\nb"]
    encode = packing.encoder(queries.tokenizer_path())
    assert encode.quick is not None
    for text, ids in zip(texts, ids_of(texts)):
        assert encode(text).tolist() == ids.tolist()


def test_pool_stays_bounded_and_fills_gaps(monkeypatch):
    pool = packing.Pool(16)
    for i, n in enumerate([9, 5, 3, 3, 7, 12, 4]):
        pool.add(i, np.zeros(n), 0, n)
    sizes = []
    while pool.tokens >= 16:
        sizes.append([p[3] for p in pool.fill(16)])
    assert sizes == [[12, 4], [9, 7]] and pool.tokens == 11
    assert packing._tier_sizes(11, 16) == [8, 2, 1]
