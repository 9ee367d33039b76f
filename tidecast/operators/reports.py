"""Group, pivot and top-k reports over the request and day exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import WEEKDAYS, month_start, weekday_name


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a group key take no part in a grouped report."""
    return df.dropna(subset=list(keys))


def total(measure: str) -> Column:
    """Sum that is 0 and not NULL when a group holds no value."""
    return F.coalesce(F.sum(measure), F.lit(0))


def sum_by(df: DataFrame, keys: Sequence[str], measure: str, name: str) -> DataFrame:
    return with_keys(df, keys).groupBy(*keys).agg(total(measure).alias(name))


def rows_by(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Number of rows per group, whatever the rows hold."""
    return with_keys(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top_rows(df: DataFrame, measure: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(measure), F.asc(tie)).limit(n)


def top_per_group(df: DataFrame, group: Sequence[str], measure: str, tie: str, n: int) -> DataFrame:
    """The ``n`` largest rows per group, ties in A-Z order, with their rank.

    Spark keeps ``n`` candidates per group and map task before the shuffle (group limit).
    """
    by_size = Window.partitionBy(*group).orderBy(F.desc(measure), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(by_size)).filter(F.col("rank") <= n)


def requests_by_month(requests: DataFrame) -> DataFrame:
    keyed = requests.withColumn("month_year", month_start(F.col("sys_created_date")))
    return sum_by(keyed, ["month_year"], "unique_requests", "unique_requests")


def weekday_average_by_month(requests: DataFrame) -> DataFrame:
    """Mean of the export's rows per month, one column per weekday from Monday to Sunday."""
    ds = F.col("sys_created_date")
    keyed = requests.select(
        month_start(ds).alias("month_year"), weekday_name(ds).alias("weekday"), "unique_requests"
    )
    return keyed.groupBy("month_year").pivot("weekday", list(WEEKDAYS)).agg(F.avg("unique_requests"))


def pivot_sum(df: DataFrame, index: Sequence[str], columns: str, values: Sequence, measure: str) -> DataFrame:
    """Wide report with a given column list: the list fixes the order and saves a distinct job."""
    return with_keys(df, [*index, columns]).groupBy(*index).pivot(columns, list(values)).agg(F.sum(measure))


def top_countries_per_day(days: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` busiest countries per region and weekday."""
    volume = sum_by(days, ["level1", "day_name", "level2"], "unique_tickets", "unique_tickets")
    return top_per_group(volume, ["level1", "day_name"], "unique_tickets", "level2", n)


def axis_bound(days: DataFrame) -> DataFrame:
    """Shared axis limit of a region's weekday panels: its largest bar plus a tenth."""
    volume = sum_by(days, ["level1", "day_name", "level2"], "unique_tickets", "unique_tickets")
    return volume.groupBy("level1").agg((F.max("unique_tickets") * F.lit(1.1)).alias("upper"))


def stacked_offsets(top: DataFrame) -> DataFrame:
    """Where each country's bar starts in the stacked weekday chart of its region.

    Every country that reaches the top list on some day has a bar on every day of the region, of
    height 0 where it is not in that day's list. The grid is a join of two dimension lists.
    """
    days = top.select("level1", "day_name").distinct()
    countries = top.select("level1", "level2").distinct()
    height = top.select("level1", "day_name", "level2", "unique_tickets")
    bars = days.join(countries, "level1").join(height, ["level1", "day_name", "level2"], "left").na.fill(
        0, ["unique_tickets"]
    )
    below = (
        Window.partitionBy("level1", "day_name").orderBy("level2").rowsBetween(Window.unboundedPreceding, -1)
    )
    return bars.withColumn("bottom", F.coalesce(F.sum("unique_tickets").over(below), F.lit(0)))
