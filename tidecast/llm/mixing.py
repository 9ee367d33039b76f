"""Mixing of sources to target weights.

The words of every source, its documents in a row, are cut into blocks of ``block`` words. The mixture is a number of
output shards with ``slots`` slots each; a slot holds one block. Every shard draws from a multinomial distribution how
many of its slots each source gets. The slots of a source are numbered through all shards, and slot j holds the
block that a pseudorandom permutation of the source's block numbers has at place j; beyond the last block the next round
starts with a permutation of its own. So no block comes a third time before all came twice, and nothing is shuffled
to mix: slots and blocks are joined by the block's number.

Independent draws miss a total by chance. The slots that a source drew beyond its quota go to the sources that drew too
few, in order of their numbers; then every source has its quota exactly, and a source that may come twice at most does.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import plain, rows_of
from tidecast.llm.running import running
from tidecast.session import discard, settle

BLOCK, SLOTS = 64, 1 << 16
#: Of the mixture in all sources' words; uses of a word at most.
SHARE, MOST = 1.5, 2
#: Sources that a plan may have: it holds a line of figures for each.
SOURCES = 100_000
#: Slots numbered at once; shards that a task numbers.
BATCH, TASK_SHARDS = 1 << 14, 4
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words wanted of each source: by weight, but at most ``most`` times its size, the excess by weight to the others."""
    left, found = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if weights[i] > 0]
    while free:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > most * sizes[i]]
        for i in full or free:
            found[i] = float(most * sizes[i]) if full else weights[i] * unit
        if not full:
            break
        left -= sum(found[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return found


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A hash of 64-bit numbers (the finaliser of MurmurHash3, public domain)."""
    x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def permuted(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0 to n - 1 has its ``places``: four Feistel rounds on the next even number of
    bits, again and again until the number is below n. Nothing of size n is held."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out, todo = places.astype(np.uint64), np.arange(places.size)
    while todo.size:
        left, right = out[todo] >> half, out[todo] & mask
        for turn in range(4):
            left, right = right, left ^ (_mixed(right, key * 8 + turn) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _key(seed: int, *parts: int) -> int:
    """A key for a purpose: the same on every machine."""
    value = np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64)
    for part in parts:
        value = _mixed(value, part * 0x9E3779B97F4A7C15 + 1)
    return int(value[0])


@dataclass
class Mix:
    """``sources``: source, number, size, target, quota, blocks; ``rows``: the documents placed in their source's words;
    ``slots``: shard, slot, number (of the source), turn, block."""

    sources: DataFrame
    rows: DataFrame
    slots: DataFrame
    block: int
    used: list[DataFrame] = field(default_factory=list)

    def pieces(self) -> DataFrame:
        """The parts of documents that the blocks hold: number, block, row, doc_id, first_word, n_words, at (in the block)."""
        size, before = F.col("size"), F.col("before")
        spread = self.rows.where(size > 0).withColumn(
            "block", F.explode(F.sequence(F.floor(before / self.block), F.floor((before + size - 1) / self.block)))
        )
        start = F.greatest(before, F.col("block") * self.block)
        end = F.least(before + size, (F.col("block") + 1) * self.block)
        return spread.select(
            "number", "block", "row", "doc_id", (start - before).alias("first_word"), (end - start).alias("n_words"),
            (start - F.col("block") * self.block).alias("at"),
        )

    def spans(self) -> DataFrame:
        """The mixture: shard, slot, number, block, row, doc_id, first_word, n_words, at."""
        return self.slots.join(self.pieces(), ["number", "block"]).select(
            "shard", "slot", "number", "block", "row", "doc_id", "first_word", "n_words", "at"
        )

    def texts(self) -> DataFrame:
        """The mixture as texts: shard, slot, number, block, text (its words, a space between). For ``mix(..., with_text=True)``."""
        blocks = _block_texts(self.rows, self.block)
        return self.slots.join(blocks, ["number", "block"]).select("shard", "slot", "number", "block", "text")

    def discard(self) -> None:
        discard(self.sources, self.slots, *self.used)


def _block_texts(rows: DataFrame, block: int) -> DataFrame:
    """Rows (number, block, text): each task cuts its documents, and a block's parts are put together, ``block`` words at most."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, before, text in rows_of(batch, "number", "before", "text"):
                words, parts = text.encode().split(), []
                at = 0
                while at < len(words):
                    inside = (before + at) % block
                    parts.append(((before + at) // block, inside, b" ".join(words[at : at + block - inside]).decode()))
                    at += block - inside
                columns = list(zip(*parts)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(parts), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))],
                    names=["number", "block", "at", "part"])

    parts = rows.where("size > 0").select("number", "before", "text").mapInArrow(cut, "number int, block bigint, at bigint, part string")
    put = parts.groupBy("number", "block").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
    return put.select("number", "block", F.array_join("parts.part", " ").alias("text"))


def _draws(spark, quotas: np.ndarray, slots: int, seed: int) -> DataFrame:
    """Per shard and source how many slots were drawn, and the slots of the shard before them: shard, number, group, n, at."""
    total = int(quotas.sum())
    shards = -(-total // slots)
    shares = quotas / max(total, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (shard,) in rows_of(batch, "id"):
                n = min(slots, total - shard * slots)
                drawn = np.random.Generator(np.random.Philox(key=_key(seed, 1, shard))).multinomial(n, shares)
                numbers = np.flatnonzero(drawn)
                at = np.cumsum(drawn) - drawn
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(numbers.size, shard)), pa.array(numbers.astype(np.int32)), pa.array([f"{k:08d}" for k in numbers], pa.string()),
                     pa.array(drawn[numbers]), pa.array(at[numbers])], names=["shard", "number", "group", "n", "at"])

    return spark.range(shards).mapInArrow(run, "shard bigint, number int, group string, n bigint, at bigint")


def _numbered(draws: DataFrame, drawn: np.ndarray, quotas: np.ndarray, blocks: np.ndarray, slots: int, seed: int) -> DataFrame:
    """Every slot with its source, after the surplus went to the sources that lack, and its block."""
    total = int(quotas.sum())
    surplus, lack = np.maximum(drawn - quotas, 0), np.maximum(quotas - drawn, 0)
    given, ends = np.cumsum(surplus) - surplus, np.cumsum(lack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, n, at, first in rows_of(batch, "shard", "number", "n", "at", "before"):
                size = min(slots, total - shard * slots)
                for low in range(0, n, BATCH):
                    own = np.arange(low, min(low + BATCH, n))
                    places, owners = first + own, np.full(own.size, number)
                    over = np.flatnonzero(places >= quotas[number])
                    if over.size:
                        moved = given[number] + places[over] - quotas[number]
                        owners[over] = np.searchsorted(ends, moved, side="right")
                        places[over] = drawn[owners[over]] + moved - (ends - lack)[owners[over]]
                    turns, found = np.zeros(own.size, np.int64), np.zeros(own.size, np.int64)
                    for owner in np.unique(owners):
                        mine = np.flatnonzero(owners == owner)
                        turns[mine] = places[mine] // blocks[owner]
                        for turn in np.unique(turns[mine]):
                            these = mine[turns[mine] == turn]
                            found[these] = permuted(places[these] % blocks[owner], int(blocks[owner]), _key(seed, 2, int(owner), int(turn)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(own.size, shard)), pa.array(permuted(at + own, size, _key(seed, 3, shard))),
                         pa.array(owners.astype(np.int32)), pa.array(turns.astype(np.int32)), pa.array(found)],
                        names=["shard", "slot", "number", "turn", "block"])

    # the draws are a small table and a task's work follows the slots, so the tasks follow the shards
    tasks = max(1, -(-total // (slots * TASK_SHARDS)))
    return draws.repartition(tasks, "shard").mapInArrow(run, "shard bigint, slot bigint, number int, turn int, block bigint")


def mix(docs: DataFrame, weights: Sequence[float] | Mapping[str | None, float], share: float = SHARE, most: int = MOST, block: int = BLOCK,
        slots: int = SLOTS, seed: int = 0, source: str = "source", doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> Mix:
    """The plan of a mixture of ``docs``, of ``share`` times all words, no word more than ``most`` times.

    ``weights``: a weight per source name, or a list that repeats over the sources in order of code points, NULL last. A
    word is a run without ASCII white space; NULL is the empty text. A source's documents are in the order of their id,
    then of their text's hash; equal rows are rows of their own. Rows without id come first, rows without source are a
    source of their own, texts without words are never taken. Sources not in ``weights`` are not taken. The plan is
    the same on every run, whatever the partitions. Above SOURCES sources it is refused.
    """
    spark = docs.sparkSession
    chosen = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("key"),
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        *([plain(text).alias("text")] if with_text else []),
    )
    counted = settle(chosen)
    placed, sums, used = running(counted, "key", ["doc_id", "digest", "row"], "size")
    discard(counted)
    lines = [(r["key"], r["total"]) for r in sums.limit(SOURCES + 1).collect()]
    if len(lines) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    lines.sort(key=lambda line: (line[0] == "", line[0]))
    names, sizes = [k[1:] if k else None for k, _ in lines], [n for _, n in lines]
    given = [weights.get(n, 0) for n in names] if isinstance(weights, Mapping) else [weights[i % len(weights)] for i in range(len(names))]
    wanted = targets(sizes, given, share, most)
    blocks = np.array([-(-n // block) for n in sizes], np.int64)
    # in blocks as long as the source's are on average, as its last one is shorter
    quotas = np.minimum(np.array([round(t * b / n) if n else 0 for t, b, n in zip(wanted, blocks.tolist(), sizes)], np.int64), most * blocks)
    schema = T.StructType([T.StructField(n, t()) for n, t in (
        ("key", T.StringType), ("source", T.StringType), ("number", T.IntegerType), ("source_size", T.LongType), ("target", T.DoubleType),
        ("quota", T.LongType), ("blocks", T.LongType))])
    table = [(k, n, i, s, t, int(q), int(b)) for i, ((k, s), n, t, q, b) in enumerate(zip(lines, names, wanted, quotas, blocks))]
    sources = settle(spark.createDataFrame(table, schema))
    draws = settle(_draws(spark, quotas, slots, seed))
    numbered, totals, more = running(draws, "group", ["shard"], "n")
    drawn = np.zeros(len(names), np.int64)
    for r in totals.collect():
        drawn[int(r["group"])] = r["total"]
    found = settle(_numbered(numbered, drawn, quotas, blocks, slots, seed))
    discard(sums, draws, totals, *more)
    rows = placed.join(sources.select("key", "number"), "key")
    return Mix(sources, rows, found, block, used)


def taken(docs: DataFrame, weights: Sequence[float] | Mapping[str | None, float] = (5, 2, 1), **how) -> DataFrame:
    """Per row of ``docs`` how many of its words the mixture takes: doc_id, source, size, source_size, target, taken."""
    plan = mix(docs, weights, **how)
    sums = plan.spans().groupBy(F.col("row").alias("its_row")).agg(F.sum("n_words").alias("sum"))
    found = plan.rows.join(sums, F.col("row") == F.col("its_row"), "left").drop("key")
    return found.join(plan.sources, "number").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("sum", F.lit(0)).cast("bigint").alias("taken")
    )
