"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits. Two fingerprints are linked when at most ``radius`` bits differ. Candidates
come from a covering family of bit masks (Pagh, 2016): every bit gets a non-zero vector of
``radius + 1`` bits, and every such vector v gives one mask, made of the bits whose vector has an odd
product with v. The vectors of up to ``radius`` differing bits span too little to exclude every v, so at
least one mask holds none of the differing bits: a pair within the radius always shares a bucket of
some table. No link is lost, at any size of the data.

Buckets that many fingerprints share are cut again by a second covering family over the bits that the
first mask leaves free. A bucket of the second level leaves at most 17 bits free, so that it holds at
most 2**17 distinct fingerprints (1 MB): its size is bounded by construction. Inside a bucket a spanning
forest of the links is found, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import fresh, rows_of, utf8
from tidecast.llm.graph import components
from tidecast.session import discard, settle

SHINGLE = 4
RADIUS = 4
#: A bucket with more fingerprints is cut by the second family. Decides only where work is done.
BUCKET = 2048
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def simhash(raw: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text in UTF-8, as a signed number; 0 for a text without words."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    spans = list(zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()))
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(spans), BLOCK):
        hashes = np.array([digest(joined[s:e], 42) for s, e in spans[at : at + BLOCK]], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp) for every row of ``docs``, repeated rows included.

    Text is lower-cased in A-Z only and cut into words at ASCII white space; a text of fewer words than
    a shingle has one shingle, the whole; a NULL, empty or blank text has the fingerprint 0.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(raw, shingle) for (raw,) in rows_of(batch, "raw")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("raw"))
    return chosen.mapInArrow(run, f"doc_id {kind}, fp bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def masks(radius: int, bits: list[int]) -> list[int]:
    """Covering masks over the given bit positions, 2**(radius+1) - 1 of them."""
    vectors = (1 << (radius + 1)) - 1
    owner = {b: 1 + i % vectors for i, b in enumerate(bits)}
    return [sum(1 << b for b, w in owner.items() if (v & w).bit_count() & 1) for v in range(1, vectors + 1)]


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect just what all links among the members would; a member found is not looked at again."""
    edges, left = [], members
    while left.size > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and left.size:
            here = frontier.pop()
            near = np.bitwise_count(left ^ here) <= radius
            found = left[near]
            if found.size:
                edges += [(int(f), int(here)) for f in found]
                frontier.extend(found)
                left = left[~near]
    return edges


def _forests(groups: DataFrame, radius: int) -> DataFrame:
    """Spanning links inside each bucket of a table with an array of members in every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: list[tuple[int, int]] = []
            column = batch.column(0)
            for i in range(batch.num_rows):
                pairs += forest(column[i].values.to_numpy(zero_copy_only=False), radius)
            ends = np.array(pairs, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

    return groups.select("members").mapInArrow(run, "u bigint, v bigint")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) among the distinct values of ``prints.fp``, enough to connect all that are within the radius.

    Pairs in a bucket of two are checked by their smallest and largest member, without collecting;
    larger buckets are collected up to BUCKET members, still larger ones cut by the second family first.
    """
    first = masks(radius, list(range(64)))
    second = []
    for m in first:
        second.append([m | k for k in masks(radius, [b for b in range(64) if not m >> b & 1])])
    inner = len(second[0])

    keyed = prints.select("fp").distinct().select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in first])).alias("t", "key")
    )
    sizes = settle(
        keyed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        .where("n > 1")
    )
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    pairs = sizes.where("n = 2").where(near).select("u", "v")

    crowded = keyed.join(sizes.where("n > 2").select("t", "key", "n"), ["t", "key"])
    small = crowded.where(F.col("n") <= BUCKET).groupBy("t", "key").agg(F.collect_list("fp").alias("members"))
    table = F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in second])
    cut = (
        crowded.where(F.col("n") > BUCKET)
        .select("fp", "t", F.posexplode(F.element_at(table, F.col("t") + 1)).alias("s", "mask"))
        .select("fp", (F.col("t") * inner + F.col("s")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    )
    shared = cut.groupBy("t", "key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return pairs.unionByName(_forests(small, radius)).unionByName(_forests(shared, radius))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, root (fingerprint that names the class), component_id, n_fingerprints.

    ``component_id`` is the smallest doc_id of the class; rows without doc_id take part and get the
    class's id, NULL only if nobody in the class has one. Copies share a fingerprint and are linked
    through it, never pair by pair. An empty table gives an empty result.
    """
    prints = settle(fingerprints(docs, doc_id, text, shingle))
    firsts = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(firsts, radius))
    named = firsts.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = settle(named)
    discard(firsts)
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_fingerprints"))
    return prints.join(named.select("fp", "root").join(ids, "root"), "fp").select(
        "doc_id", "fp", "root", "component_id", "n_fingerprints"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one document of each class: that with the smallest doc_id.

    All columns stay as they are. Rows that share one doc_id are the same document and one of them is
    kept. Rows without doc_id cannot stand for a class and stay.
    """
    name = fresh("kept_id", docs)
    kept = classes(docs, doc_id, text, shingle, radius).where("component_id = doc_id").select(
        F.col("component_id").alias(name)
    ).distinct()
    chosen = docs.join(settle(kept), docs[doc_id] == F.col(name), "left_semi").dropDuplicates([doc_id])
    return chosen.unionByName(docs.where(F.col(doc_id).isNull()))
