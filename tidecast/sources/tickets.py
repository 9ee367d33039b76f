"""Ticket events and the daily volumes derived from them.

A ticket counts once, on the day of its first event. Everything after the first-touch step is a
daily table: its size is bounded by days x locations x organisations and does not grow with the
number of tickets.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import iso_weekday, weekday_name
from tidecast.session import settle
from tidecast.sources.files import read_table
from tidecast.sources.registry import STAR_DATES, Dates

LOCATION = ("level1", "level2", "organization_flag")


def _ship_events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("sr_number"), F.col("l_shipdate").alias("created_at")
    )


def _between(c: Column, dates: Dates) -> Column:
    """Half-open bounds on the raw timestamp, so that they reach the parquet reader."""
    since, until = (dt.datetime.combine(d, dt.time()) for d in (dates.since, dates.until))
    return (c >= F.lit(since).cast("timestamp_ntz")) & (c < F.lit(until).cast("timestamp_ntz"))


def _order_customers(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("sr_number"), F.col("o_custkey").alias("custkey")
    )


def _customer_places(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with its location and organisation."""
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation")
    region = read_table(spark, folder, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("custkey"),
        F.col("r_name").alias("level1"),
        F.col("n_name").alias("level2"),
        F.col("c_mktsegment").alias("organization_flag"),
    )


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    """Raw ticket events: ticket number, day, location, organisation."""
    return (
        _ship_events(spark, folder)
        .join(_order_customers(spark, folder), "sr_number")
        .join(_customer_places(spark, folder), "custkey")
        .select("sr_number", F.to_date("created_at").alias("sys_created_date"), *LOCATION)
    )


#: A packed first touch is days since 1970 times this, plus the rank of the location.
_RANKS = 1 << 40


def first_touch(events: DataFrame, dates: Dates) -> DataFrame:
    """Earliest event of every ticket; ties go to the first location in A-Z order.

    The few distinct locations are ranked A-Z (NULL first) in a small written table. Day and rank make
    one BIGINT per event, and its minimum per ticket is a hash aggregate that combines on the map side:
    neither a DISTINCT nor a sort of raw events, and no strings in the shuffle. The names are joined
    back on the reduced rows. The location join is an inner join on the whole location, NULLs equal;
    Spark broadcasts the table by its known size.
    """
    in_range = (F.col("sys_created_date") >= F.lit(dates.since)) & (F.col("sys_created_date") < F.lit(dates.until))
    kept = events.filter(in_range)
    ranked = Window.orderBy(*[F.asc_nulls_first(c) for c in LOCATION])
    places = settle(kept.select(*LOCATION).distinct().withColumn("place", F.row_number().over(ranked).cast("bigint")))
    same = reduce(and_, [F.col(f"e.{c}").eqNullSafe(F.col(f"p.{c}")) for c in LOCATION])
    packed = kept.alias("e").join(places.alias("p"), same).select(
        "sr_number", (F.unix_date("sys_created_date").cast("bigint") * F.lit(_RANKS) + F.col("place")).alias("packed")
    )
    first = packed.groupBy("sr_number").agg(F.min("packed").alias("packed"))
    opened = first.select(
        "sr_number",
        F.date_from_unix_date(F.floor(F.col("packed") / F.lit(_RANKS)).cast("int")).alias("sys_created_date"),
        F.pmod("packed", F.lit(_RANKS)).alias("place"),
    )
    return opened.join(places, "place").select("sr_number", "sys_created_date", *LOCATION)


def first_touch_star(spark: SparkSession, folder: str, dates: Dates = STAR_DATES) -> DataFrame:
    """First touch when the location hangs on the ticket and not on the event.

    The fact table is reduced to one row per ticket before it meets any dimension. The minimum of a
    date is a fixed-width hash aggregate with map-side combine, and its output is already
    partitioned by the key of the join with the orders. Only customer and day travel to the join
    with the customers; location names are attached last. Spark broadcasts the customers while
    their size allows and otherwise splits a hot customer with its adaptive skew join.
    """
    first = (
        _ship_events(spark, folder)
        .filter(_between(F.col("created_at"), dates))
        .groupBy("sr_number")
        .agg(F.min("created_at").alias("created_at"))
    )
    return (
        first.join(_order_customers(spark, folder), "sr_number")
        .join(_customer_places(spark, folder), "custkey")
        .select("sr_number", F.to_date("created_at").alias("sys_created_date"), *LOCATION)
    )


def count_by_day(touched: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return touched.groupBy("sys_created_date", *keys).agg(F.count(F.lit(1)).alias("unique_tickets"))


def daily_location(spark: SparkSession, folder: str, dates: Dates = STAR_DATES) -> DataFrame:
    """Tickets per day x region x country x organisation."""
    return count_by_day(first_touch_star(spark, folder, dates), LOCATION)


def request_location(spark: SparkSession, folder: str, dates: Dates = STAR_DATES) -> DataFrame:
    """Service requests per day x region x country x organisation: every order counts on its day.

    Same columns as ``daily_location``. Orders are counted per customer and day before they meet the dimensions.
    """
    orders = read_table(spark, folder, "orders").filter(_between(F.col("o_orderdate"), dates))
    counted = orders.groupBy(F.col("o_custkey").alias("custkey"), F.to_date("o_orderdate").alias("sys_created_date")).agg(
        F.count(F.lit(1)).alias("n")
    )
    placed = counted.join(_customer_places(spark, folder), "custkey")
    return placed.groupBy("sys_created_date", *LOCATION).agg(F.sum("n").alias("unique_tickets"))


def daily_org(spark: SparkSession, folder: str, dates: Dates = STAR_DATES) -> DataFrame:
    """Tickets per day x organisation with the date parts of the warehouse report."""
    ds = F.col("sys_created_date")
    return count_by_day(first_touch_star(spark, folder, dates), ("organization_flag",)).select(
        "sys_created_date",
        F.year(ds).alias("created_year"),
        F.month(ds).alias("created_month"),
        F.weekofyear(ds).alias("created_week"),
        iso_weekday(ds).alias("created_day_number"),
        "organization_flag",
        "unique_tickets",
    )


def request_export(daily: DataFrame) -> DataFrame:
    return daily.select(
        "sys_created_date", "level1", "level2", F.col("unique_tickets").alias("unique_requests")
    )


def day_export(daily: DataFrame) -> DataFrame:
    """Tickets per weekday name x year x month x location."""
    ds = F.col("sys_created_date")
    return daily.groupBy(
        weekday_name(ds).alias("day_name"),
        F.year(ds).alias("created_year"),
        F.month(ds).alias("created_month"),
        "level1",
        "level2",
    ).agg(F.sum("unique_tickets").alias("unique_tickets"))
