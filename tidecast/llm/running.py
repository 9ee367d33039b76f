"""Places and running sums inside groups of any size, without a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.session import discard, settle


def running(rows: DataFrame, group: str, order: list[str], size: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``rows`` with ``place`` (rows before it in its group) and ``before`` (their sizes); a table
    ``group, n_rows, total``; and the tables that the first one reads, to be discarded after use.

    ``rows`` has to be a written table in which ``group``, a string, and ``size`` are never NULL and ``order`` leaves no
    ties: only then a lost executor gets the same places again. Ranges of (group, order) are dealt to the tasks,
    so a hot group is many ranges; each task counts on its own and one row per range and group is summed up.
    """
    added = [T.StructField(n, T.LongType()) for n in ("part", "place", "before")]
    schema = T.StructType([*rows.schema.fields, *added])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, place, before = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(group))
            sizes = batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.ones(n, bool)
            new[0] = keys[0].as_py() != last
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            own = np.arange(n)
            first = np.maximum.accumulate(np.where(new, own, -1))
            sums = np.cumsum(sizes) - sizes
            places = np.where(first < 0, own + place, own - first)
            befores = np.where(first < 0, sums + before, sums - sums[first])
            last, place, before = keys[n - 1].as_py(), int(places[-1]) + 1, int(befores[-1] + sizes[-1])
            extra = [pa.array(np.full(n, part)), pa.array(places), pa.array(befores)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    counted = settle(dealt.mapInArrow(number, schema))
    ends = settle(counted.groupBy(group, "part").agg(F.count("*").alias("n_rows"), F.sum(size).alias("total")))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(
        F.col(group).alias("its_group"), F.col("part").alias("its_part"),
        F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("size_before"),
    )
    same = (F.col(group) == F.col("its_group")) & (F.col("part") == F.col("its_part"))
    offsets = settle(offsets)
    placed = counted.join(offsets, same).select(
        *rows.columns, (F.col("place") + F.col("rows_before")).alias("place"), (F.col("before") + F.col("size_before")).alias("before")
    )
    sums = settle(ends.groupBy(group).agg(F.sum("n_rows").alias("n_rows"), F.sum("total").alias("total")))
    discard(ends)
    return placed, sums, [counted, offsets]
