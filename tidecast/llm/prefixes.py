"""Document fingerprints from prefix polynomial hashes.

For the characters c_0, c_1, ... of a text the prefix array is S[i] = sum of c_j * B**j for j < i, modulo the
prime 2**31 - 1, for two bases at once. The value of the span from i to j is (S[j] - S[i]) * B**-i: it depends on
the span's characters only, so one subtraction tells whether any two spans, of any two texts, are equal
(up to a chance of about 2**-62), and binary search finds how far two texts agree from given places on.

A fingerprint is the value of the whole text and a sketch: all spans of WIDTH characters, hashed from the
prefix array, fall into SLOTS slots, and each slot keeps the least of its values. The likeness of two
fingerprints is the share of equal slots, an estimate of the share of common spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import plain, rows_of

PRIME = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
WIDTH = 8
SLOTS = 64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Characters of a text whose prefix arrays are held at once; a span value does not depend on where a block starts.
BLOCK = 1 << 16


def _mod(x: np.ndarray) -> np.ndarray:
    """Modulo 2**31 - 1 of numbers below 2**62, by shifts; the result may also be the prime itself."""
    x = (x & PRIME) + (x >> 31)
    return (x & PRIME) + (x >> 31)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _mod(x)
    return np.where(x == PRIME, 0, x)


class Powers:
    """B**j and B**-j modulo the prime for j up to the longest text seen."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, PRIME - 2, PRIME)
        self.up = self.down = np.ones(1, np.int64)

    def grow(self, n: int) -> None:
        while self.up.size <= n:
            k = self.up.size
            self.up = np.concatenate([self.up, _reduced(self.up * pow(self.base, k, PRIME))])
            self.down = np.concatenate([self.down, _reduced(self.down * pow(self.inverse, k, PRIME))])


_POWERS = tuple(map(Powers, BASES))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Prefixes:
    """The two prefix arrays of a text."""

    def __init__(self, text: str):
        points = code_points(text) + 1
        self.length, self.sums = points.size, []
        for powers in _POWERS:
            powers.grow(self.length)
            terms = _mod(points * powers.up[: self.length])
            sums = np.zeros(self.length + 1, np.int64)
            # at most 2**32 terms below 2**31: the running sum stays below 2**63
            np.cumsum(terms, out=sums[1:])
            self.sums.append(_reduced(sums))

    def span(self, start: int, end: int) -> int:
        """The value of the characters from ``start`` to before ``end``, 62 bits."""
        value = 0
        for sums, powers in zip(self.sums, _POWERS):
            part = (int(sums[end]) - int(sums[start])) * int(powers.down[start]) % PRIME
            value = value << 31 | part
        return value

    def windows(self, width: int) -> np.ndarray:
        """The values of all spans of this width, 62 bits; of the whole text if it is shorter."""
        if self.length < width:
            return np.array([self.span(0, self.length)] if self.length else [], np.int64)
        value = np.zeros(self.length - width + 1, np.int64)
        for sums, powers in zip(self.sums, _POWERS):
            part = _reduced((sums[width:] - sums[:-width] + PRIME) * powers.down[: value.size])
            value = value << 31 | part
        return value

    def extension(self, start: int, other: Prefixes, other_start: int) -> int:
        """How many characters agree from these places on, by binary search over span values."""
        low, high = 0, min(self.length - start, other.length - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, start + middle) == other.span(other_start, other_start + middle):
                low = middle
            else:
                high = middle - 1
        return low


def common_prefix(one: str, other: str) -> int:
    """Characters that two texts share from the start, block by block, by binary search in the block that differs."""
    for at in range(0, min(len(one), len(other)), BLOCK):
        mine, its = Prefixes(one[at : at + BLOCK]), Prefixes(other[at : at + BLOCK])
        same = mine.extension(0, its, 0)
        if same < min(mine.length, its.length) or same < BLOCK:
            return at + same
    return min(len(one), len(other))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly (the finaliser of MurmurHash3, public domain)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _densified(least: np.ndarray) -> np.ndarray:
    """Per slot 32 bits of the least hash in it; an empty slot takes that of the next filled one, mixed with the
    distance. Without any filled slot all are zero."""
    slots = least.size
    filled = np.flatnonzero(least != _EMPTY)
    if not filled.size:
        return np.zeros(slots, np.uint32)
    places = np.arange(slots)
    following = filled[np.searchsorted(filled, places) % filled.size]
    distance = ((following - places) % slots).astype(np.uint64)
    taken = np.where(distance == 0, least[following], _mixed(least[following] + distance * np.uint64(0x9E3779B97F4A7C15)))
    return (taken & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def fingerprint(text: str) -> tuple[str, np.ndarray]:
    """The fingerprint as text (length, value of the whole text, slots, all hexadecimal), and its sketch."""
    least, whole = np.full(SLOTS, _EMPTY, np.uint64), [0] * len(BASES)
    for at in range(0, len(text), BLOCK):
        block = Prefixes(text[at : at + BLOCK + WIDTH - 1])
        own = min(BLOCK, len(text) - at)
        for k, base in enumerate(BASES):
            whole[k] = (whole[k] + int(block.sums[k][own]) * pow(base, at, PRIME)) % PRIME
        if at == 0 or block.length >= WIDTH:
            hashes = _mixed(block.windows(WIDTH))
            np.minimum.at(least, (hashes & np.uint64(SLOTS - 1)).astype(np.intp), hashes >> np.uint64(6))
    found = _densified(least)
    return f"{len(text):x}-{whole[0] << 31 | whole[1]:016x}-{found.astype('>u4').tobytes().hex()}", found


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    return float(np.mean(one == other))


def sketch_of(text: str) -> np.ndarray:
    """The sketch back from the text form of a fingerprint."""
    return np.frombuffer(bytes.fromhex(text.rsplit("-", 1)[1]), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, fingerprint. NULL is the empty text; its fingerprint is all zeros."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(len(t), fingerprint(t)[0]) for (t,) in rows_of(batch, "content")]
            sizes, prints = zip(*texts) if texts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.string())],
                names=["doc_id", "n_chars", "fingerprint"],
            )

    chosen = docs.select(F.col(doc_id).alias("doc_id"), plain(text).alias("content"))
    return chosen.mapInArrow(run, f"doc_id {kind}, n_chars bigint, fingerprint string")


def _streams(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (part, tail, doc_id, content), dealt out and sorted so that the next document is the next row.

    The ids are cut into parts at quantiles, several parts per shuffle partition. The first document of a
    part is also sent to the part before it, where it is the ``tail``, the last row; that of the first part
    goes to the last one. So texts are shuffled once, and a task holds two of them. What reaches the
    driver are the cuts and one id per part.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), plain(text).alias("content"))
    shares = [i / (4 * tasks) for i in range(1, 4 * tasks)]
    cuts = np.array(sorted(set(chosen.approxQuantile("doc_id", shares, 0.25 / (4 * tasks)))))

    def part_of(ids: pa.Array) -> np.ndarray:
        """The number of cuts above an id; -1 for NULL."""
        known = ids.fill_null(0).to_numpy()
        return np.where(ids.is_valid().to_numpy(zero_copy_only=False), cuts.size - np.searchsorted(cuts, known, "right"), -1)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part_of(batch.column(0)), pa.int32()), batch.column(0)], names=["part", "doc_id"])

    numbered = chosen.select("doc_id").mapInArrow(number, "part int, doc_id bigint")
    heads = {r["part"]: r["head"] for r in numbered.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(p for p in heads if p >= 0)
    before = {p: order[i - 1] for i, p in enumerate(order)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "tail", "doc_id", "content"]
        for batch in batches:
            parts = part_of(batch.column(0))
            kept = [pa.array(parts, pa.int32()), pa.array(np.zeros(parts.size, bool)), *batch.columns]
            yield pa.RecordBatch.from_arrays(kept, names=names)
            ids = batch.column(0).to_pylist()
            first = [i for i, p in enumerate(parts.tolist()) if p >= 0 and ids[i] == heads[p]]
            if first:
                also = batch.take(pa.array(first))
                ends = [pa.array([before[int(parts[i])] for i in first], pa.int32()), pa.array([True] * len(first))]
                yield pa.RecordBatch.from_arrays([*ends, *also.columns], names=names)

    dealt = chosen.mapInArrow(deal, "part int, tail boolean, doc_id bigint, content string")
    return dealt.repartition(tasks, "part").sortWithinPartitions("part", "tail", F.desc("doc_id"), "content")


def with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document against an edited text and the next document.

    One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, common_prefix (characters that the text and its edited text share from the start, by binary search).
    In the edited text the last floor(n_chars / 2) characters are replaced by the first as many of the
    next document, all of it if it is shorter. Documents follow each other by descending doc_id, those of
    one id by text; after the last comes the first. Rows without doc_id stand outside: the empty text is
    their next. NULL is the empty text; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = None, []

        def compare(row: tuple, next_text: str, next_sketch: np.ndarray) -> None:
            _, key, content, (print_, own) = row
            half = len(content) // 2
            edited = content[: len(content) - half] + next_text[:half]
            edited_print, edited_sketch = fingerprint(edited)
            digest = hashlib.sha256(edited.encode("utf-8")).hexdigest()
            found.append((key, len(content), digest, print_, edited_print, likeness(own, edited_sketch), likeness(own, next_sketch),
                          common_prefix(content, edited)))

        def result() -> pa.RecordBatch:
            columns = list(zip(*found))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        for batch in batches:
            for part, tail, key, content in rows_of(batch, "part", "tail", "doc_id", "content"):
                if part < 0:
                    compare((part, key, content, fingerprint(content)), "", _densified(np.full(SLOTS, _EMPTY)))
                    continue
                if tail and (held is None or held[0] != part):
                    continue  # another row of the id whose first row was taken
                print_ = fingerprint(content)
                if held is not None and held[0] == part:
                    compare(held, content, print_[1])
                held = None if tail else (part, key, content, print_)
            if found:
                yield result()
        if found:
            yield result()

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, common_prefix bigint"
    )
    return _streams(docs, doc_id, text).mapInArrow(run, schema)
