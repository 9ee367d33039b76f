"""Merkle manifest of a dataset with retained SHA-256 midstates.

A tree hashes its leaves in runs of FAN nodes, level by level, until one node is left. A node is the SHA-256 of the
hexadecimal digests of its children. Such a digest is 64 characters, just one block of SHA-256, so the state of the hash
before each child slot is eight words: a parent retains a copy for every slot. Folding a leaf resumes the state before
its slot with the (perhaps replaced) digest and the siblings on its right only; what stands to the left is in the state.

Spark builds a tree in tiers. A tier cuts a tree's nodes into blocks of FAN**LEVELS consecutive ones, and one row holds a
block with its levels and states, so a hot tree is many rows. The tier above has a node per block. The roots of all
trees are the leaves of one more tree. Folding goes the other way: each block gets the path above it, the
states and siblings on the way to the root, once for all its leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.running import running
from tidecast.session import discard, settle

FAN, LEVELS = 8, 4
BLOCK = FAN**LEVELS
#: Rows of an output batch of paths.
BATCH = 512


def _primes(n: int) -> list[int]:
    found: list[int] = []
    number = 2
    while len(found) < n:
        if all(number % p for p in found):
            found.append(number)
        number += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= x else (low, middle - 1)
    return low


#: The constants of FIPS 180-4: first fractional bits of the square and cube roots of the first primes.
INITIAL = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUNDS = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _primes(64)]
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One block of SHA-256 for many messages: states (8, n) and message words (16, n) give states (8, n)."""
    w = list(words)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        if t >= 16:
            x, y = w[(t - 15) & 15], w[(t - 2) & 15]
            w[t & 15] = (
                w[t & 15] + w[(t - 7) & 15] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3)))
                + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10)))
            )
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + w[t & 15] + ROUNDS[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def to_words(digests: bytes) -> np.ndarray:
    """Digests one after the other as words (8, n)."""
    return np.ascontiguousarray(np.frombuffer(digests, ">u4").reshape(-1, 8).T).astype(np.uint32)


def to_bytes(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.T).astype(">u4").tobytes()


def hexed(words: np.ndarray) -> bytes:
    """The hexadecimal digests of words (8, n) one after the other."""
    return _HEX[np.frombuffer(to_bytes(words), np.uint8)].tobytes()


def message(words: np.ndarray) -> np.ndarray:
    """The message blocks (16, n) that the hexadecimal digests are."""
    return np.ascontiguousarray(np.frombuffer(hexed(words), ">u4").reshape(-1, 16).T).astype(np.uint32)


def _closed(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of messages of so many whole blocks: the padding is a block of its own."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0], last[15] = 0x80000000, blocks * 512
    return compress(state, last)


def _fan(n: int) -> np.ndarray:
    """The number of children of each parent of n nodes."""
    counts = np.full(-(-n // FAN), FAN)
    counts[-1] = n - FAN * (counts.size - 1)
    return counts


def depth(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def grow(leaves: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Nodes (8, n) of every level from the leaves on, and of every level of parents the states (slot, 8, n)."""
    nodes, states = [leaves], []
    for _ in range(levels):
        text, n = message(nodes[-1]), nodes[-1].shape[1]
        counts = _fan(n)
        state = np.repeat(INITIAL[:, None], counts.size, axis=1)
        retained = np.zeros((FAN, 8, counts.size), np.uint32)
        for slot in range(FAN):
            has = -(-(n - slot) // FAN) if n > slot else 0
            retained[slot, :, :has] = state[:, :has]
            if has:
                state[:, :has] = compress(state[:, :has], text[:, slot::FAN])
        states.append(retained)
        nodes.append(_closed(state, counts))
    return nodes, states


def fold(digests: np.ndarray, nodes: list[np.ndarray], states: list[np.ndarray], above: list[tuple[bytes, int, bytes]]) -> np.ndarray:
    """The roots that follow if each leaf of a block, it alone, had the given digest: words (8, n)."""
    for level, retained in enumerate(states):
        place = np.arange(digests.shape[1]) // FAN**level
        parent, slot, n = place // FAN, place % FAN, nodes[level].shape[1]
        counts, text = np.minimum(FAN, n - FAN * parent), message(nodes[level])
        state = compress(np.ascontiguousarray(retained[slot, :, parent].T), message(digests))
        for step in range(1, FAN):
            right = np.flatnonzero(slot + step < counts)
            if right.size:
                state[:, right] = compress(state[:, right], text[:, place[right] + step])
        digests = _closed(state, counts)
    for before, left, siblings in above:
        others = message(to_words(siblings))
        state = compress(np.repeat(to_words(before), digests.shape[1], axis=1), message(digests))
        for k in range(left, others.shape[1]):
            state = compress(state, np.broadcast_to(others[:, k : k + 1], (16, state.shape[1])))
        digests = _closed(state, np.full(state.shape[1], others.shape[1] + 1))
    return digests


def siblings_above(nodes: list[np.ndarray], above: list[tuple[bytes, int, bytes]]) -> list[bytes]:
    """For every leaf of a block the hexadecimal digests of all siblings on its way, from its level to the root."""
    found = [b"".join(hexed(to_words(siblings)) for _, _, siblings in above)]
    for level in reversed(nodes[:-1]):
        text, n = hexed(level), level.shape[1]
        found = [
            text[i // FAN * FAN * 64 : i * 64] + text[(i + 1) * 64 : min(i // FAN * FAN + FAN, n) * 64] + found[i // FAN] for i in range(n)
        ]
    return found


def _unpacked(n: int, levels: int, nodes: bytes, states: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    sizes = [n]
    for _ in range(levels):
        sizes.append(-(-sizes[-1] // FAN))
    ends = np.cumsum([0, *sizes]) * 32
    of_nodes = [to_words(nodes[a:b]) for a, b in zip(ends, ends[1:])]
    ends = np.cumsum([0, *sizes[1:]]) * 32 * FAN
    of_states = [to_words(states[a:b]).reshape(8, FAN, -1).transpose(1, 0, 2) for a, b in zip(ends, ends[1:])]
    return of_nodes, of_states


PATH = "path array<struct<state:binary,left:int,siblings:binary>>"
_BLOCKS = "tree string, block bigint, n int, levels int, later bigint, digest binary, nodes binary, states binary"


def _tier(nodes: DataFrame) -> DataFrame:
    """The blocks of ``nodes`` (tree, place, size: nodes of the tree on this tier, digest, item); ``later``: the size above."""
    item = nodes.schema["item"].dataType.simpleString()
    block = F.floor(F.col("place") / BLOCK).alias("block")
    one = F.struct("place", "digest", "item")
    gathered = nodes.groupBy("tree", block, "size").agg(F.array_sort(F.collect_list(one)).alias("ones"))
    rows = gathered.select("tree", "block", "size", F.col("ones.digest").alias("digests"), F.col("ones.item").alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, number, size, digests = (batch.column(k)[i] for k in range(4))
                leaves = to_words(b"".join(digests.as_py()))
                levels = min(LEVELS, depth(size.as_py()))
                grown, states = grow(leaves, levels)
                packed = b"".join(to_bytes(s.transpose(1, 0, 2).reshape(8, -1)) for s in states)
                row = [tree.as_py(), number.as_py(), leaves.shape[1], levels, -(-size.as_py() // FAN**levels),
                       to_bytes(grown[-1]), b"".join(map(to_bytes, grown)), packed]
                arrays = [pa.array([v], t) for v, t in zip(row, _TYPES)]
                yield pa.RecordBatch.from_arrays([*arrays, batch.column(4).slice(i, 1)], names=[*_NAMES, "items"])

    return settle(rows.mapInArrow(run, f"{_BLOCKS}, items array<{item}>"))


_NAMES = [c.split()[0] for c in _BLOCKS.split(", ")]
_TYPES = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in _BLOCKS.split(", ")]


def _tiers(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """All tiers of the trees; ``largest``: leaves of the largest of them."""
    tiers = [_tier(nodes)]
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        nodes = tiers[-1].where("later > 1").select(
            "tree", F.col("block").alias("place"), F.col("later").alias("size"), "digest", F.lit(None).cast("string").alias("item")
        )
        tiers.append(_tier(nodes))
    return tiers


def _roots(tiers: list[DataFrame]) -> DataFrame:
    found = [t.where("later = 1").select("tree", "digest") for t in tiers]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


@dataclass
class Manifest:
    """The written tiers of all trees, and those of the tree over their roots."""

    tiers: list[DataFrame]
    top: list[DataFrame]

    def subroots(self) -> DataFrame:
        """Rows (tree, digest)."""
        return _roots(self.tiers)

    def root(self) -> DataFrame:
        """One row with the digest of everything; none for an empty table."""
        return _roots(self.top).select("digest")

    def discard(self) -> None:
        discard(*self.tiers, *self.top)


def build(leaves: DataFrame, order: str) -> Manifest:
    """The manifest of a written table ``tree`` (string, never NULL), ``digest`` (32 bytes), ``item`` and ``order``.

    ``order`` puts the leaves of a tree in a row, then the digest does; ``ties`` has to tell equal rows apart. Whatever is in
    ``item`` is kept with the leaf. The trees are in the order of their names.
    """
    placed, sizes, used = running(leaves.withColumn("one", F.lit(1)), "tree", [order, "digest", "ties"], "one")
    largest = sizes.agg(F.max("n_rows")).first()[0] or 0
    sized = placed.join(sizes.select("tree", F.col("n_rows").alias("size")), "tree")
    tiers = _tiers(sized.select("tree", "place", "size", "digest", "item"), largest)
    discard(sizes, *used)
    trees = settle(_roots(tiers).select(F.lit("").alias("whole"), F.col("tree").alias("item"), "digest", F.lit(1).alias("one")))
    placed, totals, used = running(trees, "whole", ["item"], "one")
    n = totals.agg(F.max("n_rows")).first()[0] or 0
    top = _tiers(placed.select(F.col("whole").alias("tree"), "place", F.lit(n).cast("bigint").alias("size"), "digest", "item"), n)
    discard(trees, totals, *used)
    return Manifest(tiers, top)


def _steps(batch: pa.RecordBatch, i: int) -> list[tuple[bytes, int, bytes]]:
    path = batch.column(batch.schema.get_field_index("path"))[i].as_py()
    return [(s["state"], s["left"], s["siblings"]) for s in path]


def _block(batch: pa.RecordBatch, i: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return _unpacked(*(batch.column(batch.schema.get_field_index(n))[i].as_py() for n in ("n", "levels", "nodes", "states")))


def _with_path(tier: DataFrame, paths: DataFrame) -> DataFrame:
    return tier.join(paths.select("tree", "block", "subroot", "root", "path"), ["tree", "block"]).select(*tier.columns, "subroot", "root", "path")


def _children(tier: DataFrame, paths: DataFrame) -> DataFrame:
    """For every node of the tier's blocks its path: rows (tree, block, item, subroot, root, digest, path)."""
    item = tier.schema["items"].dataType.elementType.simpleString()
    schema = f"tree string, block bigint, item {item}, subroot binary, root binary, digest binary, {PATH}"
    steps = pa.list_(pa.struct([("state", pa.binary()), ("left", pa.int32()), ("siblings", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree, number, subroot, root = (batch.column(batch.schema.get_field_index(n))[i].as_py() for n in ("tree", "block", "subroot", "root"))
                items = batch.column(batch.schema.get_field_index("items"))[i].values
                nodes, states = _block(batch, i)
                above, n = _steps(batch, i), nodes[0].shape[1]
                flat = [to_bytes(level) for level in nodes]
                for at in range(0, n, BATCH):
                    members = range(at, min(at + BATCH, n))
                    paths = []
                    for member in members:
                        own, here = [], member
                        for level, retained in enumerate(states):
                            first = here // FAN * FAN
                            run_of = flat[level][first * 32 : (first + FAN) * 32]
                            left = here - first
                            state = to_bytes(retained[left, :, here // FAN : here // FAN + 1])
                            own.append((state, left, run_of[: left * 32] + run_of[left * 32 + 32 :]))
                            here //= FAN
                        paths.append([dict(zip(("state", "left", "siblings"), s)) for s in own + above])
                    k = len(paths)
                    digests = [flat[0][m * 32 : m * 32 + 32] for m in members]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tree] * k, pa.string()), pa.array([number * BLOCK + m for m in members], pa.int64()), items.slice(at, k),
                         pa.array([subroot] * k, pa.binary()), pa.array([root] * k, pa.binary()), pa.array(digests, pa.binary()), pa.array(paths, steps)],
                        names=["tree", "block", "item", "subroot", "root", "digest", "path"])

    return _with_path(tier, paths).mapInArrow(run, schema)


def _paths(manifest: Manifest) -> list[DataFrame]:
    """For every tier of the trees the path above each block: rows (tree, block, subroot, root, path)."""
    nothing = F.array().cast(PATH.removeprefix("path "))
    above = manifest.top[-1].select("tree", "block", F.col("digest").alias("subroot"), F.col("digest").alias("root"), nothing.alias("path"))
    for tier in reversed(manifest.top):
        above = settle(_children(tier, above))
    ends = above.select(F.col("item").alias("its_tree"), F.col("digest").alias("subroot"), "root", "path")
    found: list[DataFrame] = []
    for tier in reversed(manifest.tiers):
        last = tier.where("later = 1").select("tree", "block")
        here = last.join(ends, last.tree == ends.its_tree).select("tree", "block", "subroot", "root", "path")
        if found:
            here = here.unionByName(_children(after, found[-1]).select("tree", "block", "subroot", "root", "path"))
        found.append(settle(here))
        after = tier
    return found[::-1]


def proofs(manifest: Manifest, replaced: str) -> DataFrame:
    """For every leaf ``item``, its digest, subroot and root, the SHA-256 of its siblings' digests on the way to the root,
    and the root that follows from the digest in the item's field ``replaced`` (NULL: the leaf's own) and the retained
    states: rows (item, leaf, subroot, root, proof_sha256, folded_root), digests in hexadecimal.
    """
    tier = manifest.tiers[0]
    item = tier.schema["items"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column(batch.schema.get_field_index("items"))[i].values
                nodes, states = _block(batch, i)
                above = _steps(batch, i)
                subroot, root = (batch.column(batch.schema.get_field_index(n))[i].as_py().hex() for n in ("subroot", "root"))
                own = to_bytes(nodes[0])
                given = items.field(replaced).to_pylist()
                taken = b"".join(own[32 * k : 32 * k + 32] if d is None else d for k, d in enumerate(given))
                folded = hexed(fold(to_words(taken), nodes, states, above)).decode()
                text, n = hexed(nodes[0]).decode(), len(given)
                proof = [hashlib.sha256(p).hexdigest() for p in siblings_above(nodes, above)]
                yield pa.RecordBatch.from_arrays(
                    [items, pa.array([text[64 * k : 64 * k + 64] for k in range(n)]), pa.array([subroot] * n), pa.array([root] * n),
                     pa.array(proof), pa.array([folded[64 * k : 64 * k + 64] for k in range(n)])],
                    names=["item", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    schema = f"item {item}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return _with_path(tier, _paths(manifest)[0]).mapInArrow(run, schema)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as the leaf's hash takes it: its bytes counted, or a dash for NULL."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: list[Column]) -> Column:
    """The SHA-256 of a row's values, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def with_tampered(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` with a tree per lang, and what folding says if a third of the texts lose their capitals A-Z.

    A row per row of ``docs``, repeated rows included: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    Rows of one doc_id are in the order of their leaves. Rows without doc_id come first in their tree and are not tampered
    with; rows without lang are a tree of their own, before all others, other than that of the empty lang. NULL and empty
    text are different leaves. Of the columns only doc_id, source, lang, n_chars and text count. Empty table: no rows.
    """
    columns = ["doc_id", "source", "lang", "n_chars"]
    lowered = F.translate("text", UPPER, LOWER)
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    altered = F.when(chosen, leaf([*map(F.col, columns), lowered]))
    leaves = settle(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"),
        F.col("doc_id"),
        F.monotonically_increasing_id().alias("ties"),
        leaf([*map(F.col, columns), F.col("text")]).alias("digest"),
        F.struct("doc_id", altered.alias("altered")).alias("item"),
    ))
    found = proofs(build(leaves, "doc_id"), "altered")
    discard(leaves)
    return found.select("item.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of a short text: its bytes one by one, each shifted out bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, [unicode(c)::BIGINT FOR c IN string_split({text}, '')]), lambda c, b:
  list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _field(value: str) -> str:
    text = f"{value}::VARCHAR"
    return f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"


_KEY = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
ORACLE_TAMPERED = f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_KEY} || {_field('text')}) AS leaf,
    CASE WHEN {_CRC.format(text='doc_id::VARCHAR')} % 3 = 0 THEN sha256({_KEY} || {_field(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS altered
  FROM documents
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM raw
), levels AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, [sha256(array_to_string(nodes[i + 1:i + {FAN}], '')) FOR i IN range(0, len(nodes), {FAN})]
  FROM levels WHERE len(nodes) > 1
), subroots AS (
  SELECT tree, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS number FROM levels WHERE len(nodes) = 1
), tops AS (
  SELECT 0 AS level, list(subroot ORDER BY number) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, [sha256(array_to_string(nodes[i + 1:i + {FAN}], '')) FOR i IN range(0, len(nodes), {FAN})] FROM tops WHERE len(nodes) > 1
), steps AS (
  SELECT l.tree, l.place AS leaf_place, v.level, l.place // ({FAN} ** v.level)::BIGINT AS place, v.nodes
  FROM leaves l JOIN levels v USING (tree) WHERE len(v.nodes) > 1
  UNION ALL
  SELECT l.tree, l.place, s.height + t.level, s.number // ({FAN} ** t.level)::BIGINT, t.nodes
  FROM leaves l JOIN subroots s USING (tree), tops t WHERE len(t.nodes) > 1
), sides AS MATERIALIZED (
  SELECT tree, leaf_place, level, array_to_string(nodes[place - place % {FAN} + 1:place], '') AS before,
    array_to_string(nodes[place + 2:place - place % {FAN} + {FAN}], '') AS after FROM steps
), heights AS (SELECT tree, leaf_place, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM sides GROUP BY ALL
), folded AS (
  SELECT tree, place, 0 AS level, coalesce(altered, leaf) AS digest FROM leaves
  UNION ALL
  SELECT f.tree, f.place, f.level + 1, sha256(before || digest || after)
  FROM folded f JOIN sides s ON s.tree = f.tree AND s.leaf_place = f.place AND s.level = f.level
), ends AS (SELECT tree, place, max_by(digest, level) AS folded_root FROM folded GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots USING (tree) JOIN ends e USING (tree, place) LEFT JOIN heights h ON h.tree = l.tree AND h.leaf_place = l.place,
  (SELECT nodes[1] AS root FROM tops WHERE len(nodes) = 1)
"""
