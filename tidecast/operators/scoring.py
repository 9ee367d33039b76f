"""Segment results against actuals, and their reconciliation with the total."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.dates import month_start
from tidecast.functions.numbers import day_accuracy, not_below_zero, relative_error
from tidecast.operators.features import future_frame


def trend_line_forecast(series: DataFrame) -> DataFrame:
    """``segment, ds, yhat`` on the straight line through the history, for history and future days."""
    x = F.unix_date("ds").cast("double")
    line = series.groupBy("segment").agg(
        F.regr_slope("y", x).alias("slope"), F.regr_intercept("y", x).alias("intercept")
    )
    yhat = F.col("intercept") + F.col("slope") * x
    return future_frame(series).join(line, "segment").select("segment", "ds", yhat.alias("yhat"))


def actual_vs_forecast(series: DataFrame, forecast: DataFrame, scored_to: dt.date) -> DataFrame:
    """History with its forecast, which is never negative. Days without history drop out."""
    known = forecast.filter(F.col("ds") <= F.lit(scored_to)).select("segment", "ds", "yhat")
    return series.join(known, ["segment", "ds"], "left").withColumn("yhat", not_below_zero(F.col("yhat")))


def accuracy_by_day(compared: DataFrame) -> DataFrame:
    """The exported result: days whose accuracy is defined."""
    accuracy = day_accuracy(F.col("y"), F.col("yhat"))
    return compared.withColumn("accuracy_by_day", accuracy).dropna(subset=["accuracy_by_day"])


def mean_accuracy(results: DataFrame) -> DataFrame:
    return results.groupBy("segment").agg(F.avg("accuracy_by_day").alias("accuracy"))


def column_means(results: DataFrame) -> DataFrame:
    """Mean of every column of a result; the date's mean is a (fractional) epoch day."""
    return results.groupBy("segment").agg(
        F.avg(F.unix_date("ds")).alias("ds"),
        F.avg("y").alias("y"),
        F.avg("yhat").alias("yhat"),
        F.avg("accuracy_by_day").alias("accuracy_by_day"),
    )


def worst_day(results: DataFrame) -> DataFrame:
    """Day of the smallest accuracy per segment, the first one on ties."""
    worst = F.min(F.struct("accuracy_by_day", "ds", "y", "yhat")).alias("worst")
    return results.groupBy("segment").agg(worst).select("segment", "worst.*")


def total_actuals(daily: DataFrame) -> DataFrame:
    """Tickets per day over all locations, those outside every segment included."""
    return daily.groupBy(F.col("sys_created_date").alias("ds")).agg(
        F.sum("unique_tickets").cast("double").alias("unique_tickets")
    )


def segments_wide(totals: DataFrame, results: DataFrame, segments: Sequence[str]) -> DataFrame:
    """One row per day of the total and one forecast column per segment: one join instead of nine."""
    wide = results.groupBy("ds").pivot("segment", list(segments)).agg(F.first("yhat"))
    named = wide.select("ds", *[F.col(s).alias(f"yhat_{s}") for s in segments])
    return totals.join(named, "ds", "left")


def bottom_up(results: DataFrame) -> DataFrame:
    """Sum of the segment forecasts per day; a segment without a row counts as 0."""
    return results.groupBy("ds").agg(F.sum("yhat").alias("predictions"))


def _with_errors(df: DataFrame) -> DataFrame:
    error = relative_error(F.col("unique_tickets"), F.col("predictions"))
    return df.withColumn("percent_error", error).withColumn("abs_percent_error", F.abs("percent_error"))


def reconcile_daily(totals: DataFrame, results: DataFrame) -> DataFrame:
    joined = totals.join(bottom_up(results), "ds", "left").na.fill(0.0, ["predictions"])
    return _with_errors(joined)


def reconcile_monthly(daily: DataFrame) -> DataFrame:
    months = daily.groupBy(month_start(F.col("ds")).alias("year_month")).agg(
        F.sum("unique_tickets").alias("unique_tickets"), F.sum("predictions").alias("predictions")
    )
    return _with_errors(months)


def mape(reconciled: DataFrame) -> DataFrame:
    """Mean absolute percentage error, and how many rows have none because the total is 0."""
    missing = F.col("abs_percent_error").isNull().cast("int")
    return reconciled.agg(
        F.avg("abs_percent_error").alias("mape"), F.count(F.lit(1)).alias("n_rows"), F.sum(missing).alias("n_skipped")
    )
