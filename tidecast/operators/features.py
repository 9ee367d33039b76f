"""Regressors of the two forecast models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import harmonics, year_fraction
from tidecast.functions.holidays import holiday_calendar, holiday_columns, holidays_by_day

# Model orders and horizons.
ANNUAL_ORDER = 10
WEEKLY_ORDER = 3
WEEK = 7
MEAN_YEAR = 365.25
OLS_STEPS = 365
FUTURE_DAYS = 180
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8

FOURIER_NAMES = [f"{f}_{k}" for k in range(1, ANNUAL_ORDER + 1) for f in ("sin", "cos")]
DESIGN_NAMES = ["const", "trend", *[f"s_{i}" for i in range(2, WEEK + 1)], *FOURIER_NAMES]


def fourier_columns(ds: Column) -> list[Column]:
    """Annual calendar harmonics: the position is the elapsed share of the calendar year."""
    return [c.alias(n) for c, n in zip(harmonics(year_fraction(ds), ANNUAL_ORDER), FOURIER_NAMES)]


def design_columns(position: Column, ds: Column) -> list[Column]:
    """Constant, linear trend, six dummies of the row position modulo 7, annual harmonics."""
    day = F.pmod(position - 1, F.lit(WEEK))
    dummies = [(day == i - 1).cast("int").cast("double") for i in range(2, WEEK + 1)]
    columns = [F.lit(1.0), position.cast("double"), *dummies, *fourier_columns(ds)]
    return [c.alias(n) for c, n in zip(columns, DESIGN_NAMES)]


def with_position(series: DataFrame, key: str) -> DataFrame:
    return series.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("ds")))


def next_positions(series: DataFrame, key: str, steps: int = OLS_STEPS) -> DataFrame:
    """The days after the last one, with the row position carried on."""
    last = series.groupBy(key).agg(F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n"))
    ahead = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return ahead.select(
        key,
        F.date_add("last_ds", F.col("step")).alias("ds"),
        (F.col("n") + F.col("step")).cast("int").alias("position"),
    )


def seasonal_columns(ds: Column) -> list[Column]:
    """Weekly then yearly harmonics of the epoch day, which keep their phase over gaps."""
    day = F.unix_date(ds)
    return harmonics(day / F.lit(WEEK), WEEKLY_ORDER) + harmonics(day / F.lit(MEAN_YEAR), ANNUAL_ORDER)


N_WEEKLY = 2 * WEEKLY_ORDER
N_YEARLY = 2 * ANNUAL_ORDER


def calendar_years(days: DataFrame) -> tuple[int, int]:
    """First and last year of the days, future ones included: what a holiday calendar has to cover."""
    reach = days.agg(F.year(F.min("ds")).alias("first"), F.year(F.max("ds")).alias("last")).first()
    return (reach["first"], reach["last"]) if reach["first"] is not None else (2000, 2000)


def with_season(days: DataFrame, country: Column, years: tuple[int, int]) -> DataFrame:
    """Adds ``season``: weekly and yearly harmonics, then one 0/1 place per holiday of the country.

    The calendar holds rules x years rows, so Spark broadcasts it by its known size.
    """
    calendar = holidays_by_day(holiday_calendar(days.sparkSession, *years))
    flagged = days.withColumn("country", country).join(calendar, ["country", "ds"], "left")
    season = F.concat(F.array(*seasonal_columns(F.col("ds"))), holiday_columns(F.col("names"), F.col("country")))
    return flagged.withColumn("season", season).drop("names")


def cumulative_rows(days: DataFrame) -> DataFrame:
    """Observations of a segment up to and including each date."""
    upto = Window.partitionBy("segment").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("cum_n", F.sum(F.size("ys")).over(upto))


def training_spans(days: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """First and last training day and number of observations for every segment and cutoff."""
    reached = days.join(cutoffs.select("segment", "cutoff"), "segment").filter(F.col("ds") <= F.col("cutoff"))
    return reached.groupBy("segment", "cutoff").agg(
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), F.sum(F.size("ys")).alias("n_rows")
    )


def changepoint_dates(days: DataFrame, spans: DataFrame) -> DataFrame:
    """Candidate dates of a trend change: evenly spaced observations in the first part of the history.

    Every observation is addressed by its row number, so the lookup is an equality join. A segment
    with several observations per date may name a date twice; it is kept once.
    """
    start = F.col("cum_n") - F.size("ys")
    rows = cumulative_rows(days).select(
        "segment", "ds", F.explode(F.sequence(start, F.col("cum_n") - 1)).alias("row")
    )
    reach = spans.withColumn("head", F.floor(F.col("n_rows") * F.lit(CHANGEPOINT_RANGE)))
    count = F.least(F.lit(CHANGEPOINTS), F.col("head") - 1)
    wanted = (
        reach.withColumn("count", count)
        .filter(F.col("count") >= 1)
        .withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("count"))))
        .withColumn("row", F.rint(F.col("i") * (F.col("head") - 1) / F.col("count")).cast("bigint"))
    )
    return wanted.join(rows, ["segment", "row"]).select("segment", "cutoff", "ds").distinct()


def future_frame(days: DataFrame, steps: int = FUTURE_DAYS) -> DataFrame:
    """History dates of every segment, then the days after the last one."""
    last = days.groupBy("segment").agg(F.max("ds").alias("last_ds"))
    ahead = F.explode(F.sequence(F.date_add("last_ds", 1), F.date_add("last_ds", steps)))
    future = last.select("segment", ahead.alias("ds"), F.lit(True).alias("future"))
    return days.select("segment", "ds", F.lit(False).alias("future")).unionByName(future)
