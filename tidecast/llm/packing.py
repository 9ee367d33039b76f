"""Packing of token sequences into windows of several context sizes.

The tiers are the powers of two up to the longest window. A document gives as many full long windows as
it has tokens for; its rest is routed to the tier of its size. Every task packs its own rows: a long
window starts with the longest rest and its gap is filled with the longest rests of the shorter tiers
that fit; only when none fits is a short one cut. What is left when a task's rows run out, fewer tokens
than one long window, is cut at the tier sizes into windows of shorter tiers. So no window needs padding,
rests stay whole where they can, and a task holds only rests, a bounded pool of them. There is no shuffle.

Windows of one tier are then dealt into step groups of equal token count. That needs only the number of
windows per task and tier.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import plain, rows_of
from tidecast.session import settle

WINDOW = 1024
#: The id that ends every document.
END_ID = 0
#: Tokens that a step group holds.
STEP_TOKENS = 1 << 16
#: Rests in the pool of a task are packed as soon as they hold this many windows, down to half of it.
POOL_WINDOWS = 4096
#: Task numbers are the upper bits of a sequence id.
TASK_BITS = 40

#: The word pattern of byte-level vocabularies, for texts in which no two white-space characters are neighbours.
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: White space other than blank and line feed.
_RARE_SPACE = (*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))


def _byte_of() -> dict[str, int]:
    """Which byte a character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts by one byte-level tokenizers file.

    Where the file's merges are numbered in their order, tiktoken gives the same ids several times
    faster from the same vocabulary. It takes the texts in which its simpler word pattern finds the same
    words; all other texts go to tokenizers itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.quick = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocabulary, special = model["model"]["vocab"], {x["content"]: x["id"] for x in model["added_tokens"]}
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["model"]["merges"]]
        numbers = [vocabulary[m] for m in merged]
        splitter = model["pre_tokenizer"] or {}
        if (
            numbers == sorted(numbers) and splitter.get("type") == "ByteLevel" and splitter.get("use_regex")
            and not splitter.get("add_prefix_space") and not model["normalizer"] and not model["post_processor"]
        ):
            import tiktoken

            byte = _byte_of()
            ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}
            self.quick = tiktoken.Encoding("file", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.slow = ("  ", " \n", "\n ", "\n\n", *_RARE_SPACE, *special)

    def __call__(self, text: str) -> np.ndarray:
        """The ids as little-endian unsigned 32-bit numbers, END_ID last."""
        if not self.quick or any(x in text for x in self.slow):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            found = self.quick.encode_ordinary(text)
        found.append(END_ID)
        return np.array(found, "<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per file and worker process."""
    return Encoder(path)


class Pool:
    """Rests of documents by length; hands out windows, the same for the same rests in the same order.

    A rest is (doc, ids, start, length): what stands for the document, its ids and the span of them.
    """

    def __init__(self, window: int):
        self.window, self.tokens, self.lengths = window, 0, 0
        self.by_length: dict[int, list] = {}

    def add(self, doc: tuple, ids: np.ndarray, start: int, length: int) -> None:
        self.by_length.setdefault(length, []).append((doc, ids, start))
        self.lengths |= 1 << length
        self.tokens += length

    def _take(self, length: int) -> tuple:
        rests = self.by_length[length]
        doc, ids, start = rests.pop()
        if not rests:
            self.lengths &= ~(1 << length)
        self.tokens -= length
        return doc, ids, start, length

    def fill(self, size: int) -> list[tuple]:
        """Pieces (doc, ids, start, length) of exactly ``size`` tokens; the pool must hold as many."""
        pieces, gap = [], size
        while gap:
            fitting = self.lengths & ((1 << gap + 1) - 1)
            if fitting:
                piece = self._take(fitting.bit_length() - 1)
            else:
                doc, ids, start, length = self._take((self.lengths & -self.lengths).bit_length() - 1)
                self.add(doc, ids, start + gap, length - gap)
                piece = doc, ids, start, gap
            pieces.append(piece)
            gap -= piece[3]
        return pieces


def _tier_sizes(tokens: int, window: int) -> list[int]:
    """Fewer tokens than a window, as tier sizes from the largest down."""
    return [1 << k for k in reversed(range(window.bit_length())) if tokens >> k & 1]


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
         ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, rank.

    ``tokenizer`` is the path of a tokenizers file that every executor can open. Every row of ``docs`` is
    a document, repeated rows too; NULL or empty text has one token, the end. ``window`` is a power of
    two and the column of that name is the length of the piece's sequence, a tier size; ``rank`` numbers the
    sequences of a task and tier from 0. With ``ids`` the
    token ids come along as an array. An empty table gives no piece.
    """
    if window & (window - 1) or window < 1:
        raise ValueError("the window has to be a power of two")
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "rank"]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:])
    if ids:
        names, schema = [*names, "ids"], schema + ", ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pool = encoder(tokenizer), Pool(window)
        sequence = TaskContext.get().partitionId() << TASK_BITS
        key_type, rows, ranks = pa.null(), [], Counter()

        def put(pieces: list[tuple], size: int) -> None:
            nonlocal sequence
            offset = 0
            for (key, total, before), found, start, length in pieces:
                part = found[start : start + length]
                row = (key, before + start, length, zlib.crc32(part.tobytes()), total, sequence, offset, size, ranks[size])
                rows.append((*row, part.astype(np.int64)) if ids else row)
                offset += length
            sequence += 1
            ranks[size] += 1

        def result() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            kinds = [key_type, *[pa.int64()] * 8, *[pa.list_(pa.int64())] * ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        for batch in batches:
            key_type = batch.column(0).type
            for key, content in rows_of(batch, "doc_id", "content"):
                found = encode(content)
                total = found.size
                whole = total - total % window
                for start in range(0, whole, window):
                    put([((key, total, 0), found, start, window)], window)
                if total > whole:  # copied, so that the pool does not hold on to the ids of whole documents
                    pool.add((key, total, whole), found[whole:].copy(), 0, total - whole)
                if pool.tokens >= POOL_WINDOWS * window:
                    while pool.tokens >= POOL_WINDOWS // 2 * window:
                        put(pool.fill(window), window)
                if len(rows) >= 20_000:
                    yield result()
        while pool.tokens >= window:
            put(pool.fill(window), window)
        for size in _tier_sizes(pool.tokens, window):
            put(pool.fill(size), size)
        if rows:
            yield result()

    return docs.select(F.col(doc_id).alias("doc_id"), plain(text).alias("content")).mapInArrow(run, schema)


def step_groups(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The pieces with ``step``: step groups of one tier and the same number of tokens, ``step_tokens``.

    The windows of a tier are numbered through, task after task, and cut into groups of
    ``step_tokens // window`` (at least one); only the last group of a tier is smaller. ``pieces`` is
    what ``pack`` returns. The running counts per task and tier come from a table of at most
    tasks x tiers rows.
    """
    pieces = settle(pieces.withColumn("task", F.shiftright("sequence_id", TASK_BITS)))
    sizes = pieces.groupBy("window", "task").agg((F.max("rank") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("window").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("window", "task", F.coalesce(before, F.lit(0)).alias("before"))
    per_step = F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("window")))
    step = F.floor((F.col("rank") + F.col("before")) / per_step)
    return pieces.join(sizes, ["window", "task"]).withColumn("step", step).drop("before", "task", "rank")
