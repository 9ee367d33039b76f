"""Explicit schemas: nothing is inferred when a file is read."""

from __future__ import annotations

from pyspark.sql import types as T

def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# The columns read from the star-schema tables. A given schema saves the footer scan per table.
STAR = {
    "lineitem": _fields(l_orderkey=T.LongType(), l_shipdate=T.TimestampNTZType()),
    "orders": _fields(o_orderkey=T.LongType(), o_custkey=T.LongType(), o_orderdate=T.TimestampNTZType()),
    "customer": _fields(c_custkey=T.LongType(), c_nationkey=T.IntegerType(), c_mktsegment=T.StringType()),
    "nation": _fields(n_nationkey=T.IntegerType(), n_name=T.StringType(), n_regionkey=T.IntegerType()),
    "region": _fields(r_regionkey=T.IntegerType(), r_name=T.StringType()),
}

DAILY_LOCATION = T.StructType(
    [
        T.StructField("sys_created_date", T.DateType()),
        T.StructField("level1", T.StringType()),
        T.StructField("level2", T.StringType()),
        T.StructField("organization_flag", T.StringType()),
        T.StructField("unique_tickets", T.LongType()),
    ]
)

SEGMENT_RESULT = T.StructType(
    [
        T.StructField("ds", T.DateType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("yhat", T.DoubleType()),
        T.StructField("accuracy_by_day", T.DoubleType()),
        T.StructField("segment", T.StringType()),
    ]
)

MONTH_RESULT = T.StructType(
    [
        T.StructField("year_month", T.DateType()),
        T.StructField("unique_tickets", T.DoubleType()),
        T.StructField("predictions", T.DoubleType()),
        T.StructField("percent_error", T.DoubleType()),
        T.StructField("abs_percent_error", T.DoubleType()),
    ]
)

OVERRIDES = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("ds", T.DateType()),
        T.StructField("y_new", T.DoubleType()),
    ]
)
