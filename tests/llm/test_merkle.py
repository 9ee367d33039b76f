from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests import oracle
from tests.llm import cases
from tidecast.llm import merkle, queries
from tidecast.session import settle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def row_hash(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_force(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified, all from plain hashes of whole runs."""
    trees = {}
    for row in rows:
        trees.setdefault(b"" if row["lang"] is None else b"=" + row["lang"].encode(), []).append(row)
    langs, built = sorted(trees), {}
    for lang in langs:
        members = sorted(trees[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, row_hash(r, r["text"])))
        built[lang] = members, up([row_hash(r, r["text"]) for r in members])
    top = up([built[lang][1][-1][0] for lang in langs])
    out = []
    for number, lang in enumerate(langs):
        members, levels = built[lang]
        for place, row in enumerate(members):
            digest, proof = levels[0][place], ""
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and row["text"] is not None:
                digest = row_hash(row, row["text"].encode().lower().decode())
            here, at = place, levels
            for height, level in [*enumerate(levels[:-1]), *enumerate(top[:-1])]:
                if height == 0 and level is top[0]:
                    here = number
                run, own = level[here // 8 * 8 :][:8], here % 8
                proof += "".join(run[:own] + run[own + 1 :])
                digest = sha("".join([*run[:own], digest, *run[own + 1 :]]))
                here //= 8
            out.append((row["doc_id"], levels[0][place], levels[-1][0], top[-1][0], sha(proof), digest, digest == top[-1][0]))
    return sorted(out, key=str)


def test_compression_is_sha_256():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 8):
        digests = [rng.bytes(32) for _ in range(n)]
        nodes, states = merkle.grow(merkle.to_words(b"".join(digests)), 1)
        text = "".join(d.hex() for d in digests)
        assert merkle.hexed(nodes[1]).decode() == sha(text)
        # the state retained before the last slot, resumed with another digest
        state = merkle.compress(states[0][n - 1], merkle.message(merkle.to_words(b"\7" * 32)))
        assert merkle.hexed(merkle._closed(state, np.array([n]))).decode() == sha(text[: 64 * (n - 1)] + "07" * 32)
    assert [merkle.depth(n) for n in (1, 2, 8, 9, 64, 65)] == [0, 1, 1, 2, 2, 3]


@pytest.mark.parametrize("block", [(8, 1), (4096, 4)])
def test_against_plain_hashes(spark, monkeypatch, block):
    """Trees of 1, 8, 9, 513 and more leaves, in one and in many tiers; 20 trees, so that the top has levels too."""
    monkeypatch.setattr(merkle, "BLOCK", block[0])
    monkeypatch.setattr(merkle, "LEVELS", block[1])
    rng = random.Random(3)
    sizes = {None: 8, "": 1, "en": 700, "de": 513, "é": 9, "zz": 64, **{f"l{i}": 1 + i % 3 for i in range(14)}}
    rows = [
        (rng.randrange(-50, 5000), rng.choice(["Some Text", "ÄÖ Ünder", None, "", "plain"]), lang, rng.choice(["src0", None, ""]), rng.choice([None, 4]))
        for lang, n in sizes.items() for _ in range(n)
    ]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert cases.as_rows(merkle.with_tampered(docs)) == brute_force(docs.collect())


def test_tricky_rows_and_empty_tables(spark):
    docs = cases.tricky(spark)
    assert cases.as_rows(merkle.with_tampered(docs)) == brute_force(docs.collect())
    assert merkle.with_tampered(cases.empty(docs)).count() == 0
    alone = docs.where("doc_id = 1")
    assert cases.as_rows(merkle.with_tampered(alone)) == brute_force(alone.collect())


def test_manifest_is_kept_and_catches_changes(spark):
    """The general interface: ids of text, one tree; a replaced, a swapped and a lost leaf change the root."""
    def manifest(names):
        rows = [("", f"{i:04d}", i, bytearray(hashlib.sha256(n.encode()).digest()), (f"{i:04d}", None)) for i, n in enumerate(names)]
        frame = spark.createDataFrame(rows, "tree string, id string, ties bigint, digest binary, item struct<id:string,other:binary>")
        return merkle.build(settle(frame), "id")

    names = [f"file {i}" for i in range(100)]
    whole = manifest(names)
    root = whole.root().first()["digest"].hex()
    assert root == up([sha(n) for n in names])[-1][0]
    assert {r["folded_root"] for r in merkle.proofs(whole, "other").collect()} == {root}
    for changed in (["other", *names[1:]], [names[1], names[0], *names[2:]], names[:-1]):
        assert manifest(changed).root().first()["digest"].hex() != root
    whole.discard()


def test_sql_twin(spark, folder):
    tables = oracle.connect(folder)
    assert oracle.compare(spark, tables, folder, "op11", queries.op11_merkle_manifest, merkle.ORACLE_TAMPERED) is None
