"""Near-duplicates by word shingles: every pair whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from two methods. First SimHash with covering masks (``simhash.links``): fingerprints of the same
shingles with at most ``simhash.RADIUS`` differing bits. That reaches all copies that are nearly equal, but few at 0.8.
So texts of other classes meet again by bands: BANDS bands of ROWS MinHash values each. A pair at similarity 0.8 shares none
with a chance of 5 in a million, at 0.85 of 6 in 10**9. Every link that is used is confirmed by the exact similarity of the
two sets, whichever method finds it.

A class is a connected component of the links. Copies with one set of shingles are one node from the start. The pairs of a
small band are rows, unless fingerprints joined their classes before. In a crowded band nodes are first compared with one pivot a round, at most one pair per node; a band
whose nodes are all in one class is closed and never looked at again. So a large group of copies costs a few
pairs per member. Where pivots close little, the members of a band meet in blocks of bounded size inside a map, which counts
their common shingles all at once and returns links only, at most one per member. No pair is left out that could join two classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm import simhash
from tidecast.llm.common import fresh, plain, rows_of, utf8
from tidecast.llm.graph import components
from tidecast.session import discard, settle

SHINGLE, BANDS, ROWS = 5, 40, 6
#: A band with more nodes is crowded. Decides only where work is done, as do the next two.
CROWDED = 8
#: Another round of pivots follows if one closed at least this share of the open rows.
CLOSED = 0.5
#: Nodes and shingles of a block, and shingles whose counts are taken at once.
NODES, SHINGLES, COLUMNS = 2048, 1 << 21, 2048
#: Shingles whose values are taken at once, and rows of an output batch.
BLOCK, BATCH = 512, 1000

_rng = np.random.default_rng(20)
_TIMES = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLUS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words has one, the whole; without words none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k, digest = min(size, len(words)), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + k]), 43) for i in range(len(words) - k + 1)], np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """A number per band; the number of the band is part of it. None for an empty set."""
    if not found.size:
        return np.zeros(0, np.int64)
    low, least = (found >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, low.size, BLOCK):
        np.minimum(least, (low[at : at + BLOCK, None] * _TIMES + _PLUS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _FACTOR
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = (keys ^ column) * _FACTOR
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def prints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, digest, node, fp, keys) for every row: hash of the text, of its set of shingles, fingerprint, bands."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                sets, fps = [], []
                for (raw,) in rows_of(batch, "raw"):
                    sets.append(shingles(raw))
                    fps.append(simhash.simhash(raw, SHINGLE))
                columns = [*batch.columns[:2], _nodes(sets), pa.array(fps, pa.int64()), _lists([bands(s) for s in sets])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "node", "fp", "keys"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(plain(text)).alias("digest"), utf8(text).alias("raw"))
    return chosen.mapInArrow(run, f"doc_id {kind}, digest bigint, node bigint, fp bigint, keys array<bigint>")


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(a.size for a in arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def sets_of(nodes: DataFrame, found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (node, grams) with the whole sets of the given nodes, built again from one text of each.

    A text is smaller than its set, and most texts have no candidate: so the sets of all texts are neither written nor
    shuffled. Copies of a text are folded in the tasks that read them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                sets = [shingles(raw) for (raw,) in rows_of(whole.slice(at, BATCH), "raw")]
                yield pa.RecordBatch.from_arrays([_nodes(sets), _lists(sets)], names=["node", "grams"])

    one = found.groupBy("node").agg(F.min("digest").alias("digest")).join(nodes, "node", "left_semi").select("digest")
    texts = docs.select(F.xxhash64(plain(text)).alias("digest"), utf8(text).alias("raw")).groupBy("digest").agg(F.first("raw").alias("raw"))
    return texts.join(one, "digest").select("raw").mapInArrow(run, "node bigint, grams array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) with a similarity of 0.8 or more: 9 times the shared shingles against 4 times all."""
    first, second = (sets.select(F.col("node").alias(k), F.col("grams").alias(f"of_{k}")) for k in "uv")
    n_u, n_v = F.size("of_u"), F.size("of_v")
    both = pairs.join(first, "u").join(second, "v").where((5 * n_u >= 4 * n_v) & (5 * n_v >= 4 * n_u))
    return both.where(9 * F.size(F.array_intersect("of_u", "of_v")) >= 4 * (n_u + n_v)).select("u", "v")


def forest(nodes: np.ndarray, labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the labels just as all links among the sets would; a set found is not looked at again."""
    n = np.array([s.size for s in sets])
    _, column, copies = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n.size), n)[copies[column] > 1]
    column = np.cumsum(copies > 1)[column[copies[column] > 1]] - 1
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n.size, n.size), np.float32)
    for first in range(0, column[-1] + 1 if column.size else 0, COLUMNS):
        low, high = np.searchsorted(column, [first, first + COLUMNS])
        has = np.zeros((n.size, COLUMNS), np.float32)
        has[owner[low:high], column[low:high] - first] = 1
        common += has @ has.T
    edges, left = [], np.ones(n.size, bool)
    for start in range(n.size):
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            here = todo.pop()
            same = left & (labels == labels[here])
            left &= ~same
            near = left & (9 * common[here] >= 4 * (n + n[here]))
            left &= ~near
            edges += [(int(nodes[here]), int(nodes[k])) for k in np.flatnonzero(near)]
            todo += np.flatnonzero(same | near).tolist()
    return edges


def _in_blocks(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) across the labels of each band of ``open_`` (key, node, label), by blocks of bounded size, two at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column(0)[i].values
                nodes, labels = (members.field(k).to_numpy(zero_copy_only=False) for k in ("node", "label"))
                grams = members.field("grams")
                ends = np.array(forest(nodes, labels, [g.values.to_numpy(zero_copy_only=False) for g in grams]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

    whole = open_.join(sets.select(F.col("node").alias("its_node"), "grams"), F.col("node") == F.col("its_node"))
    volume = open_.join(sets.select(F.col("node").alias("its_node"), F.size("grams").alias("size")), F.col("node") == F.col("its_node")).groupBy(
        F.col("key").alias("its_key")).agg(F.greatest(F.ceil(F.count("*") / NODES), F.ceil(F.sum("size") / SHINGLES)).alias("blocks"))
    dealt = whole.join(settle(volume), F.col("key") == F.col("its_key")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    paired = dealt.withColumn("other", other)
    ends = [f("block", "other").alias(n) for f, n in ((F.least, "low"), (F.greatest, "high"))]
    met = paired.groupBy("key", *ends).agg(F.collect_list(F.struct("node", "label", "grams")).alias("members"))
    return met.select("members").mapInArrow(run, "u bigint, v bigint")


def by_fingerprint(found: DataFrame) -> DataFrame:
    """Rows (u, v), u > v: nodes with one fingerprint or with linked ones, enough to connect all that are within the radius."""
    prints_ = settle(found.select("fp", "node").distinct())
    firsts = settle(prints_.groupBy("fp").agg(F.min("node").alias("first")))
    near = simhash.links(firsts.select("fp"))
    one, other = (firsts.select(F.col("fp").alias(k), F.col("first").alias(f"of_{k}")) for k in "uv")
    across = near.join(one, "u").join(other, "v").select("of_u", "of_v")
    within = prints_.join(firsts, "fp").select("node", "first")
    ends = across.unionByName(within.toDF("of_u", "of_v")).where("of_u != of_v")
    found_links = settle(ends.select(F.greatest("of_u", "of_v").alias("u"), F.least("of_u", "of_v").alias("v")).distinct())
    discard(prints_, firsts)
    return found_links


def _by_label(rows: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """The rows with the class of their node, the node itself if it has no link yet."""
    its = labels.select(F.col("node").alias("its_node"), "root")
    return rows.join(its, F.col(node) == F.col("its_node"), "left").withColumn(label, F.coalesce("root", node)).drop("its_node", "root")


def _first_classes(links: DataFrame, sets: DataFrame) -> DataFrame:
    """The confirmed ones among the links, by which all that would be confirmed are in one class.

    Every node tries one link first; the other links are compared only where their ends are not in one class by then.
    """
    edges = settle(_confirmed(links.groupBy("u").agg(F.min("v").alias("v")), sets))
    labels = components(edges)
    apart = _by_label(_by_label(links, labels, "u", "label_u"), labels, "v", "label_v").where("label_u != label_v")
    return _added(edges, _confirmed(apart.select("u", "v"), sets))


def classes(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (node, root) for the nodes that have a link, by their exact components; ``found`` are the ``prints`` of ``docs``."""
    keyed = found.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u != v").select("key")
    members = settle(keyed.join(shared, "key").distinct())
    links = by_fingerprint(found)
    ends = [links.select(F.col(k).alias("node")) for k in "uv"]
    sets = settle(sets_of(members.select("node").unionByName(ends[0]).unionByName(ends[1]).distinct(), found, docs, text))
    edges = _first_classes(links, sets)
    labelled = settle(_by_label(members, components(edges)))
    mixed = labelled.groupBy(F.col("key").alias("its_key")).agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    mixed = settle(mixed.where("a != b").select("its_key", "n"))
    crowded = F.col("key") == F.col("its_key")
    one, other = (
        labelled.join(mixed.where(F.col("n") <= CROWDED), crowded, "left_semi").select("key", F.col("node").alias(k), F.col("label").alias(f"label_{k}"))
        for k in "uv"
    )
    pairs = one.join(other, "key").where("u < v AND label_u != label_v").select("u", "v").distinct()
    open_ = settle(labelled.join(mixed.where(F.col("n") > CROWDED), crowded, "left_semi"))
    edges = _added(edges, _confirmed(pairs, sets))
    discard(members, links, labelled, mixed)
    rows, salt = open_.count(), 0
    while rows:
        order = F.struct(F.xxhash64("node", F.lit(salt)).alias("at"), "node", "label")
        pivots = open_.groupBy(F.col("key").alias("its_key")).agg(F.min(order).alias("pivot"))
        far = open_.join(pivots, crowded & (F.col("label") != F.col("pivot.label")))
        met = far.groupBy(F.col("node").alias("u")).agg(F.min("pivot.node").alias("v"))
        edges = _added(edges, _confirmed(met, sets))
        named = settle(_by_label(open_.select("key", "node"), components(edges)))
        mixed = named.groupBy(F.col("key").alias("its_key")).agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b")
        before, rows = rows, 0
        left = settle(named.join(mixed, crowded, "left_semi"))
        discard(open_, named)
        open_, rows, salt = left, left.count(), salt + 1
        if rows > (1 - CLOSED) * before:
            edges = _added(edges, _in_blocks(open_, sets))
            break
    discard(sets, open_)
    return components(edges)


def _added(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables of links as one written table."""
    both = settle(edges.unionByName(more))
    discard(edges)
    return both


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each class: that with the smallest doc_id, of equal ones by the text's hash.

    All columns stay as they are. Rows with the same doc_id and text are one document. Rows without doc_id take
    part in the links, cannot stand for a class, and stay. Texts without words are copies of each other.
    """
    found = settle(prints(docs, doc_id, text))
    roots = classes(found, docs, text)
    named = found.select("doc_id", "digest", "node").where("doc_id IS NOT NULL").join(roots, "node", "left")
    first = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("doc_id", "digest")).alias("kept"))
    key, mark = fresh("kept_id", docs), fresh("kept_digest", docs)
    kept = settle(first.select(F.col("kept.doc_id").alias(key), F.col("kept.digest").alias(mark)))
    discard(found)
    own = docs.withColumn(fresh("own_digest", docs), F.xxhash64(plain(text)))
    digest = own.columns[-1]
    chosen = own.join(kept, (own[doc_id] == kept[key]) & (own[digest] == kept[mark]), "left_semi").dropDuplicates([doc_id, digest])
    return chosen.drop(digest).unionByName(docs.where(F.col(doc_id).isNull()))
