"""Placement of documents on shards by a permutation-filled lookup table (Eisenbud et al., 2016).

Every shard has its own order of preference over the slots of a table of prime size: it starts at
``offset`` and goes on by ``skip``. The shards take turns, in the order of their numbers, and each claims
its first slot that is still free, until the table is full. A document's key is hashed to a slot; the
shard in the slot gets the document. All shards hold equally many slots, within one, and a change of the
shard list moves few documents besides those of the changed shard.

The table has ``slots`` entries whatever the data, so it is a constant of the plan, and placing is one
array access on the JVM. A hot source does not matter, as only the document's own key is hashed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import fresh

SHARDS = 32
#: A prime, over a hundred slots for every shard.
SLOTS = 4099


def _number(text: str) -> int:
    """60 bits of an MD5, a number that every engine can form."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """For every slot the place in ``names`` of its shard. ``slots`` has to be a prime not below their number."""
    if len(set(names)) != len(names) or not 0 < len(names) <= slots:
        raise ValueError("shard names have to differ, and there must be a slot for each")
    if slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots has to be an odd prime")
    offset = [_number(f"{n}/offset") % slots for n in names]
    skip = [_number(f"{n}/skip") % (slots - 1) + 1 for n in names]
    table, tried, free = [-1] * slots, [0] * len(names), slots
    while free:
        for shard in range(len(names)):
            while table[slot := (offset[shard] + tried[shard] * skip[shard]) % slots] >= 0:
                tried[shard] += 1
            table[slot] = shard
            free -= 1
            if not free:
                break
    return table


def shard_names(shards: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(shards)]


def slot_of(key: str, slots: int = SLOTS) -> Column:
    """The slot of a key column of any simple type; NULL is hashed as the empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % slots


def place(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with ``slot`` and ``shard``.

    The same key always gets the same shard, in repeated rows and at any size of the table. Rows without
    a key share one slot. Columns of ``docs`` that are called slot or shard are replaced.
    """
    table = F.array(*[F.lit(s) for s in lookup_table(shard_names(shards), slots)])
    name = fresh("slot_found", docs)
    found = docs.withColumn(name, slot_of(key, slots)).withColumn("shard", F.element_at(table, (F.col(name) + 1).cast("int")))
    return found.drop("slot").withColumnRenamed(name, "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id",
                 tasks_per_shard: int = 1) -> None:
    """Writes one folder per shard. Several tasks share a shard when it is large; they split it by slot."""
    placed = place(docs, shards, slots, key)
    part = F.col("slot") % tasks_per_shard
    placed.repartition(shards * tasks_per_shard, "shard", part).drop("slot").write.partitionBy("shard").parquet(path)


ORACLE_PLACE = f"""
WITH RECURSIVE names AS (
  SELECT i AS shard, 'shard-' || lpad(i::VARCHAR, 5, '0') AS name FROM range({SHARDS}) r(i)
), prefs AS (
  SELECT shard,
    ('0x' || substr(md5(name || '/offset'), 1, 15))::BIGINT % {SLOTS} AS first_slot,
    ('0x' || substr(md5(name || '/skip'), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS skip
  FROM names
), orders AS (
  SELECT shard, list((first_slot + j * skip) % {SLOTS} ORDER BY j) AS wish FROM prefs, range({SLOTS}) r(j) GROUP BY shard
), fill AS (
  SELECT 0 AS turn, list_transform(range({SLOTS}), lambda x: -1) AS owner, NULL::BIGINT AS slot
  UNION ALL
  SELECT turn + 1, list_concat(list_concat(owner[1:slot_now], [shard]), owner[slot_now + 2:]), slot_now
  FROM (
    SELECT f.turn, f.owner, o.shard, list_filter(o.wish, lambda s: f.owner[s + 1] < 0)[1] AS slot_now
    FROM fill f JOIN orders o ON o.shard = f.turn % {SHARDS} WHERE f.turn < {SLOTS}
  )
), claims AS (
  SELECT slot, CAST((turn - 1) % {SHARDS} AS INTEGER) AS shard FROM fill WHERE turn > 0
), hashed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents
)
SELECT doc_id, slot, shard FROM hashed JOIN claims USING (slot)
"""
