"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def utf8(column: str) -> Column:
    """A text column as UTF-8 bytes, NULL as the empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def plain(column: str) -> Column:
    """A text column with NULL as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def unsigned_hex(column: str) -> Column:
    """A BIGINT as 16 lowercase hexadecimal digits, negative numbers as their two's complement."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of a batch one by one, so that only one text at a time is a Python object."""
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(a[i].as_py() for a in arrays)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, text: str, wanted: Callable[[str], bool]) -> DataFrame:
    """The rows whose text is wanted, all columns as they are; NULL is judged as the empty text. A map without a shuffle."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            mask = [wanted(texts[i].as_py() or "") for i in range(batch.num_rows)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
