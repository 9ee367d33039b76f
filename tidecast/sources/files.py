"""File scans and sinks: CSV with a header, and parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidecast.sources.schemas import STAR


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(STAR[name]).parquet(f"{folder}/{name}.parquet")


#: Column that holds a line which does not fit the schema, as it stands in the file.
BAD_LINE = "bad_line"


def _csv(spark: SparkSession, schema: T.StructType, mode: str) -> DataFrameReader:
    """A reader that compares every file's header with the schema, and every line with all of its columns.

    By default columns are taken by position whatever the header says, and a line is only parsed as far as
    a query needs it, so that it could be bad for one query and good for another.
    """
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
    return reader.option("columnPruning", False).option("mode", mode)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The rows of one or more files. A header of other names, order or number and a line that does not fit are errors."""
    return _csv(spark, schema, "FAILFAST").csv(path)


def scan_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the schema, and the lines that do not: ``file, bad_line``.

    No line is lost: each is in one of the two. A line does not fit if a value cannot be read as its type or if it has more or
    fewer values than columns. A header of other names, order or number is an error, as then no line can be trusted.
    """
    both = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])
    rows = _csv(spark, both, "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE).csv(path)
    # Spark refuses plans that read nothing but the bad lines, so both filters look at the other columns as well.
    seen = F.pmod(F.xxhash64(*schema.names), F.lit(2)) < 2
    good, bad = (F.when(found, seen) for found in (F.col(BAD_LINE).isNull(), F.col(BAD_LINE).isNotNull()))
    return rows.filter(good).drop(BAD_LINE), rows.filter(bad).select(F.col("_metadata.file_path").alias("file"), BAD_LINE)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """CSV sink with a header and no index.

    With ``partition_by`` the rows of one value are brought together first, so a value gives one
    file and not one per task. Meant for daily results, whose rows per value the calendar bounds.
    """
    if partition_by:
        df = df.repartition(*partition_by)
    writer = df.write.mode("overwrite").option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
    return path


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A few literal rows as a local relation, so that Spark knows its size when it plans joins."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=schema)
