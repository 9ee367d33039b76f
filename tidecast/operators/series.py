"""Daily series per segment or organisation, and their exploration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.dates import sunday_week, week_end, weekday_name
from tidecast.operators.reports import total
from tidecast.sources.registry import SEGMENTS, STAR_LABELS, Labels, Segment, membership

ROLLING_ROWS = 30  # fixed value: window length of the moving statistics


def segment_rows(daily: DataFrame, labels: Labels = STAR_LABELS, segments: tuple[Segment, ...] = SEGMENTS) -> DataFrame:
    """Daily rows with the segment they belong to, repeated where segments overlap.

    The registry is a handful of predicates, so membership is an expression on the row and needs
    neither a join nor a shuffle.
    """
    names = F.array_compact(F.array(*[F.when(membership(s, labels), F.lit(s.name)) for s in segments]))
    return daily.withColumn("segment", F.explode(names)).withColumnsRenamed(
        {"sys_created_date": "ds", "unique_tickets": "y"}
    )


def roll_up(rows: DataFrame, key: str = "segment") -> DataFrame:
    """One row per series and date."""
    return rows.groupBy(key, "ds").agg(total("y").cast("double").alias("y"))


def segment_series(daily: DataFrame, labels: Labels = STAR_LABELS, segments: tuple[Segment, ...] = SEGMENTS) -> DataFrame:
    return roll_up(segment_rows(daily, labels, segments))


def org_series(daily: DataFrame) -> DataFrame:
    """One series per organisation."""
    renamed = daily.withColumnsRenamed(
        {"sys_created_date": "ds", "unique_tickets": "y", "organization_flag": "series"}
    )
    return roll_up(renamed, "series")


def series_days(rows: DataFrame, segments: tuple[Segment, ...] = SEGMENTS) -> DataFrame:
    """Model input: one row per segment and date with that date's observations in ``ys``.

    Segments with one row per date hold their total; the others keep one observation per location
    and organisation, so ``ys`` is as long as the location list allows and no longer.
    """
    daily_total = F.col("segment").isin([s.name for s in segments if s.by_ds])
    values = F.collect_list(F.col("y").cast("double"))
    return (
        rows.groupBy("segment", "ds")
        .agg(total("y").cast("double").alias("y"), F.array_sort(values).alias("ys"))
        .select("segment", "ds", F.when(daily_total, F.array("y")).otherwise(F.col("ys")).alias("ys"))
    )


def _resample(series: DataFrame, bin_end: Column, last_before: Column, next_bins, name: str, key: str) -> DataFrame:
    """Sum per calendar bin; bins without a row between two others get 0.

    The gap after each bin is filled from its successor, so the spine costs no join.
    """
    sums = series.groupBy(key, bin_end.alias("bin")).agg(total("y").alias("y"))
    ahead = F.lead("bin").over(Window.partitionBy(key).orderBy("bin"))
    spans = sums.withColumn("last", F.coalesce(last_before(ahead), F.col("bin")))
    return spans.select(key, "bin", "y", F.explode(next_bins).alias(name)).select(
        key, name, F.when(F.col(name) == F.col("bin"), F.col("y")).otherwise(F.lit(0.0)).alias("y")
    )


def weekly(series: DataFrame, key: str = "segment") -> DataFrame:
    """Sums of weeks that end on Sunday."""
    bins = F.expr("sequence(bin, last, interval 7 days)")
    return _resample(series, week_end(F.col("ds")), lambda b: F.date_sub(b, 7), bins, "week_end", key)


def monthly(series: DataFrame, key: str = "segment") -> DataFrame:
    """Sums of months, labelled with their last day."""
    starts = F.sequence(F.trunc("bin", "MM"), F.trunc("last", "MM"), F.expr("interval 1 month"))
    bins = F.transform(starts, F.last_day)
    return _resample(
        series, F.last_day("ds"), lambda b: F.last_day(F.add_months(b, -1)), bins, "month_end", key
    )


def rolling(series: DataFrame, key: str = "segment", rows: int = ROLLING_ROWS) -> DataFrame:
    """Centered moving mean and sample deviation over rows; NULL until the window is full."""
    around = Window.partitionBy(key).orderBy("ds").rowsBetween(-(rows // 2), rows - rows // 2 - 1)
    full = F.count("y").over(around) == rows
    return series.select(
        key,
        "ds",
        "y",
        F.when(full, F.avg("y").over(around)).alias("moving_mean"),
        F.when(full, F.stddev_samp("y").over(around)).alias("moving_std"),
    )


def with_weekday(series: DataFrame) -> DataFrame:
    return series.withColumn("day_name", weekday_name(F.col("ds")))


def rows_at(series: DataFrame, start: int, stop: int, key: str = "segment") -> DataFrame:
    """Rows ``start`` to ``stop - 1`` of every series in date order, counted from 0."""
    position = F.row_number().over(Window.partitionBy(key).orderBy("ds")) - F.lit(1)
    return series.withColumn("position", position).filter(F.col("position").between(start, stop - 1))


def peak_day(series: DataFrame, key: str) -> DataFrame:
    """Largest value of a series and the first date that reaches it."""
    best = F.max(F.struct("y", (-F.unix_date("ds")).alias("early"))).alias("best")
    return series.groupBy(key).agg(best).select(
        key, F.col("best.y").alias("peak"), F.date_from_unix_date(-F.col("best.early")).alias("peak_ds")
    )


def apply_overrides(series: DataFrame, overrides: DataFrame, key: str = "series") -> DataFrame:
    """Replaces single days; a corrected day the series does not hold is added to it."""
    return series.join(overrides, [key, "ds"], "full").select(
        key, "ds", F.coalesce("y_new", "y").alias("y"), F.col("y_new").isNotNull().alias("overridden")
    )


def distinct_countries(rows: DataFrame) -> DataFrame:
    return rows.select("segment", "level2").distinct()


def seasonal_means(series: DataFrame, period: Column, position: Column, key: str = "segment") -> DataFrame:
    """Data of a seasonal plot: mean value per period (one line) and position (its x axis)."""
    return series.groupBy(key, period.alias("period"), position.alias("position")).agg(F.avg("y").alias("mean_y"))


def by_week_and_day(series: DataFrame, key: str = "segment") -> DataFrame:
    return seasonal_means(series, sunday_week(F.col("ds")), F.weekday("ds"), key)


def by_year_and_day(series: DataFrame, key: str = "segment") -> DataFrame:
    return seasonal_means(series, F.year("ds"), F.dayofyear("ds"), key)


def last_points(means: DataFrame, key: str = "segment") -> DataFrame:
    """Where the label of every line goes: its value at the last position."""
    return means.groupBy(key, "period").agg(
        F.max("position").alias("position"), F.max_by("mean_y", "position").alias("mean_y")
    )


def period_counts(series: DataFrame, key: str = "segment") -> DataFrame:
    """Number of lines of the two seasonal plots."""
    return series.groupBy(key).agg(
        F.count_distinct(sunday_week(F.col("ds"))).alias("n_weeks"), F.count_distinct(F.year("ds")).alias("n_years")
    )
