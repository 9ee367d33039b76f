"""Segment scores, exports and reconciliation, each with its DuckDB twin.

The plain names score the straight-line reference forecast, which SQL can repeat; the ``model_``
names score the decomposable model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.numbers import rounded
from tidecast.operators import scoring
from tidecast.operators import series as ops
from tidecast.plans import model_sql, sql
from tidecast.plans.forecasting import DIGITS, whole_forecast
from tidecast.session import new_output_dir, settle
from tidecast.sources import published
from tidecast.sources import tickets as src
from tidecast.sources.files import read_csv, write_csv
from tidecast.sources.registry import SEGMENTS, STAR_DATES, STAR_LABELS, Dates, Labels, exported_names
from tidecast.sources.schemas import MONTH_RESULT, SEGMENT_RESULT

EXPORTED = tuple(s for s in SEGMENTS if s.exported)
NAMES = exported_names()


def _round(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[rounded(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


def _settled_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The daily table feeds segments and total alike; it is computed once."""
    return settle(src.daily_location(spark, folder))


def _compared(daily: DataFrame, labels: Labels = STAR_LABELS, dates: Dates = STAR_DATES) -> DataFrame:
    series = ops.segment_series(daily, labels, EXPORTED)
    return scoring.actual_vs_forecast(series, scoring.trend_line_forecast(series), dates.scored_to)


def _results(daily: DataFrame) -> DataFrame:
    return scoring.accuracy_by_day(_compared(daily))


def model_results(spark: SparkSession, daily: DataFrame, labels: Labels = STAR_LABELS, dates: Dates = STAR_DATES) -> DataFrame:
    """The model's result rows for a daily table with the given spelling and dates."""
    rows = ops.segment_rows(daily, labels, EXPORTED)
    days = settle(ops.series_days(rows))
    found = whole_forecast(spark, days).select("segment", "ds", "yhat")
    compared = scoring.actual_vs_forecast(ops.roll_up(rows), found, dates.scored_to)
    return scoring.accuracy_by_day(compared)


def model_reconciliation(spark: SparkSession, daily: DataFrame, labels: Labels = STAR_LABELS, dates: Dates = STAR_DATES) -> DataFrame:
    """The model's forecasts added up over the segments against the total of a daily table, per day."""
    return scoring.reconcile_daily(scoring.total_actuals(daily), model_results(spark, daily, labels, dates))


def actual_vs_forecast(spark: SparkSession, folder: str) -> DataFrame:
    return _round(_compared(_settled_daily(spark, folder)), "yhat")


def accuracy_by_day(spark: SparkSession, folder: str) -> DataFrame:
    return _round(_results(_settled_daily(spark, folder)), "yhat", "accuracy_by_day")


def mean_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _round(scoring.mean_accuracy(_results(_settled_daily(spark, folder))), "accuracy")


def column_means(spark: SparkSession, folder: str) -> DataFrame:
    means = scoring.column_means(_results(_settled_daily(spark, folder)))
    return _round(means, "ds", "y", "yhat", "accuracy_by_day")


def worst_day(spark: SparkSession, folder: str) -> DataFrame:
    results = _round(_results(_settled_daily(spark, folder)), "yhat", "accuracy_by_day")
    return scoring.worst_day(results)


def export_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The results written as CSV, one folder per segment, and read back with their schema."""
    results = accuracy_by_day(spark, folder)
    path = write_csv(results, new_output_dir(spark, "segments"), ["segment"])
    return read_csv(spark, path, SEGMENT_RESULT)


def scan_segments(spark: SparkSession, folder: str) -> DataFrame:
    """All segment files in one scan: rows and reach of each."""
    return export_segments(spark, folder).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds")
    )


def segments_wide(spark: SparkSession, folder: str) -> DataFrame:
    daily = _settled_daily(spark, folder)
    wide = scoring.segments_wide(scoring.total_actuals(daily), _results(daily), NAMES)
    return _round(wide, *[f"yhat_{s}" for s in NAMES])


def bottom_up_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _round(scoring.bottom_up(_results(_settled_daily(spark, folder))), "predictions")


ERRORS = ("predictions", "percent_error", "abs_percent_error")


def _line_daily(spark: SparkSession, folder: str) -> DataFrame:
    daily = _settled_daily(spark, folder)
    return scoring.reconcile_daily(scoring.total_actuals(daily), _results(daily))


def reconcile_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _round(_line_daily(spark, folder), *ERRORS)


def mape_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _round(scoring.mape(_line_daily(spark, folder)), "mape")


def reconcile_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return _round(scoring.reconcile_monthly(_line_daily(spark, folder)), *ERRORS)


def mape_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return _round(scoring.mape(scoring.reconcile_monthly(_line_daily(spark, folder))), "mape")


def export_month(spark: SparkSession, folder: str) -> DataFrame:
    path = write_csv(reconcile_monthly(spark, folder), new_output_dir(spark, "months"))
    return read_csv(spark, path, MONTH_RESULT)


def model_accuracy_by_day(spark: SparkSession, folder: str) -> DataFrame:
    results = model_results(spark, _settled_daily(spark, folder))
    return _round(results, "yhat", "accuracy_by_day", digits=DIGITS)


def model_mean_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return _round(scoring.mean_accuracy(model_results(spark, _settled_daily(spark, folder))), "accuracy", digits=DIGITS)


def model_export_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The model's results written as CSV, one folder per segment, and read back with their schema."""
    results = model_accuracy_by_day(spark, folder)
    path = write_csv(results, new_output_dir(spark, "segments"), ["segment"])
    return read_csv(spark, path, SEGMENT_RESULT)


def model_column_means(spark: SparkSession, folder: str) -> DataFrame:
    means = scoring.column_means(model_results(spark, _settled_daily(spark, folder)))
    return _round(means, "ds", "y", "yhat", "accuracy_by_day", digits=DIGITS)


def model_worst_day(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.worst_day(model_accuracy_by_day(spark, folder))


def _model_daily(spark: SparkSession, folder: str) -> DataFrame:
    return model_reconciliation(spark, _settled_daily(spark, folder))


def model_reconcile_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _round(_model_daily(spark, folder), *ERRORS, digits=DIGITS)


def model_reconcile_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return _round(scoring.reconcile_monthly(_model_daily(spark, folder)), *ERRORS, digits=DIGITS)


def model_mape_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _round(scoring.mape(_model_daily(spark, folder)), "mape", digits=DIGITS)


def model_mape_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return _round(scoring.mape(scoring.reconcile_monthly(_model_daily(spark, folder))), "mape", digits=DIGITS)


def model_export_month(spark: SparkSession, folder: str) -> DataFrame:
    path = write_csv(model_reconcile_monthly(spark, folder), new_output_dir(spark, "months"))
    return read_csv(spark, path, MONTH_RESULT)


def publish_segments(results: DataFrame, root: str) -> int:
    """Publishes segment results as the next version of a results folder, replacing the segments that they hold."""
    return published.write(results.select(*SEGMENT_RESULT.names), root, "segment", replace=True)


def reconcile_published(spark: SparkSession, daily: DataFrame, root: str, version: int | None = None) -> DataFrame:
    """The total of a daily table against the published results of its segments, per day."""
    results = published.read(spark, root, SEGMENT_RESULT, "segment", version)
    return scoring.reconcile_daily(scoring.total_actuals(daily), results)


def _published_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Segment results published in two versions, the second of the model for all segments, and reconciled from the files."""
    daily, root = _settled_daily(spark, folder), new_output_dir(spark, "published")
    publish_segments(_results(daily), root)
    publish_segments(model_results(spark, daily), root)
    return reconcile_published(spark, daily, root)


def published_reconcile_daily(spark: SparkSession, folder: str) -> DataFrame:
    return _round(_published_daily(spark, folder), *ERRORS, digits=DIGITS)


def published_mape_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return _round(scoring.mape(scoring.reconcile_monthly(_published_daily(spark, folder))), "mape", digits=DIGITS)


QUERIES = {
    f.__name__: f
    for f in (
        actual_vs_forecast,
        accuracy_by_day,
        mean_accuracy,
        column_means,
        worst_day,
        export_segments,
        scan_segments,
        segments_wide,
        bottom_up_daily,
        reconcile_daily,
        mape_daily,
        reconcile_monthly,
        mape_monthly,
        export_month,
        model_accuracy_by_day,
        model_mean_accuracy,
        model_reconcile_daily,
        model_reconcile_monthly,
        model_export_segments,
        model_column_means,
        model_worst_day,
        model_mape_daily,
        model_mape_monthly,
        model_export_month,
        published_reconcile_daily,
        published_mape_monthly,
    )
}

LINE_FORECAST = (
    sql.SEGMENTS
    + f""",
line AS (SELECT segment, regr_slope(y, CAST(ds - DATE '1970-01-01' AS DOUBLE)) AS a,
           regr_intercept(y, CAST(ds - DATE '1970-01-01' AS DOUBLE)) AS b
         FROM series WHERE segment IN {sql.EXPORTED} GROUP BY segment),
forecast AS (SELECT segment, ds, b + a * CAST(ds - DATE '1970-01-01' AS DOUBLE) AS yhat FROM series JOIN line USING (segment))"""
)
RESULTS = """,
compared AS (SELECT s.segment, s.ds, s.y, CASE WHEN f.yhat < 0 THEN 0.0 ELSE f.yhat END AS yhat
             FROM (SELECT * FROM series WHERE segment IN {exported}) s LEFT JOIN forecast f
             ON f.segment = s.segment AND f.ds = s.ds AND f.ds <= DATE '2001-05-31'),
results AS (SELECT *, 1 - abs(y / nullif(yhat, 0)) AS accuracy_by_day FROM compared
            WHERE y / nullif(yhat, 0) IS NOT NULL),
totals AS (SELECT sys_created_date AS ds, CAST(sum(unique_tickets) AS DOUBLE) AS unique_tickets FROM daily GROUP BY 1),
summed AS (SELECT ds, sum(yhat) AS predictions FROM results GROUP BY ds),
by_day AS (SELECT *, (unique_tickets - predictions) / nullif(unique_tickets, 0) AS percent_error FROM (
             SELECT ds, unique_tickets, coalesce(predictions, 0.0) AS predictions FROM totals LEFT JOIN summed USING (ds))),
by_month AS (SELECT *, (unique_tickets - predictions) / nullif(unique_tickets, 0) AS percent_error FROM (
             SELECT CAST(date_trunc('month', ds) AS DATE) AS year_month, sum(unique_tickets) AS unique_tickets,
               sum(predictions) AS predictions FROM by_day GROUP BY 1))""".format(exported=sql.EXPORTED)
_LINE = LINE_FORECAST + RESULTS
_MODEL = model_sql.whole() + ",\nforecast AS (SELECT segment, ds, yhat FROM predicted)" + RESULTS


def _result_rows(digits: int = 6) -> str:
    return f"""SELECT segment, ds, y, {sql.rnd('yhat', digits)} AS yhat,
      {sql.rnd('accuracy_by_day', digits)} AS accuracy_by_day FROM results"""


RESULT_ROWS = _result_rows()


def _mape(table: str, digits: int = 6) -> str:
    return f"""SELECT {sql.rnd('avg(abs(percent_error))', digits)} AS mape, CAST(count(*) AS BIGINT) AS n_rows,
      CAST(count(*) FILTER (percent_error IS NULL) AS BIGINT) AS n_skipped FROM {table}"""


def error_rows(key: str, table: str, digits: int = 6) -> str:
    return f"""SELECT {key}, unique_tickets, {sql.rnd('predictions', digits)} AS predictions,
      {sql.rnd('percent_error', digits)} AS percent_error,
      {sql.rnd('abs(percent_error)', digits)} AS abs_percent_error FROM {table}"""


ORACLE = {
    "actual_vs_forecast": sql.query(_LINE, f"SELECT segment, ds, y, {sql.rnd('yhat')} AS yhat FROM compared"),
    "accuracy_by_day": sql.query(_LINE, RESULT_ROWS),
    "mean_accuracy": sql.query(
        _LINE, f"SELECT segment, {sql.rnd('avg(accuracy_by_day)')} AS accuracy FROM results GROUP BY segment"
    ),
    "column_means": sql.query(
        _LINE,
        f"""SELECT segment, {sql.rnd("avg(CAST(ds - DATE '1970-01-01' AS DOUBLE))")} AS ds, {sql.rnd('avg(y)')} AS y,
              {sql.rnd('avg(yhat)')} AS yhat, {sql.rnd('avg(accuracy_by_day)')} AS accuracy_by_day
            FROM results GROUP BY segment""",
    ),
    "worst_day": sql.query(
        _LINE,
        f"SELECT * FROM ({RESULT_ROWS}) QUALIFY row_number() OVER (PARTITION BY segment ORDER BY accuracy_by_day, ds) = 1",
    ),
    "export_segments": sql.query(_LINE, RESULT_ROWS),
    "scan_segments": sql.query(
        _LINE,
        """SELECT segment, CAST(count(*) AS BIGINT) AS n_rows, min(ds) AS first_ds, max(ds) AS last_ds
           FROM results GROUP BY segment""",
    ),
    "segments_wide": sql.query(
        _LINE,
        "SELECT ds, unique_tickets, "
        + ", ".join(f"{sql.rnd(f'''max(yhat) FILTER (segment = '{s}')''')} AS yhat_{s}" for s in NAMES)
        + " FROM totals LEFT JOIN results USING (ds) GROUP BY ds, unique_tickets",
    ),
    "bottom_up_daily": sql.query(_LINE, f"SELECT ds, {sql.rnd('predictions')} AS predictions FROM summed"),
    "reconcile_daily": sql.query(_LINE, error_rows("ds", "by_day")),
    "mape_daily": sql.query(_LINE, _mape("by_day")),
    "reconcile_monthly": sql.query(_LINE, error_rows("year_month", "by_month")),
    "mape_monthly": sql.query(_LINE, _mape("by_month")),
    "export_month": sql.query(_LINE, error_rows("year_month", "by_month")),
    "model_accuracy_by_day": sql.query(_MODEL, _result_rows(DIGITS), recursive=True),
    "model_mean_accuracy": sql.query(
        _MODEL,
        f"SELECT segment, {sql.rnd('avg(accuracy_by_day)', DIGITS)} AS accuracy FROM results GROUP BY segment",
        recursive=True,
    ),
    "model_reconcile_daily": sql.query(_MODEL, error_rows("ds", "by_day", DIGITS), recursive=True),
    "model_reconcile_monthly": sql.query(_MODEL, error_rows("year_month", "by_month", DIGITS), recursive=True),
    "model_export_segments": sql.query(_MODEL, _result_rows(DIGITS), recursive=True),
    "model_column_means": sql.query(
        _MODEL,
        f"""SELECT segment, {sql.rnd("avg(CAST(ds - DATE '1970-01-01' AS DOUBLE))", DIGITS)} AS ds, {sql.rnd('avg(y)', DIGITS)} AS y,
              {sql.rnd('avg(yhat)', DIGITS)} AS yhat, {sql.rnd('avg(accuracy_by_day)', DIGITS)} AS accuracy_by_day
            FROM results GROUP BY segment""",
        recursive=True,
    ),
    "model_worst_day": sql.query(
        _MODEL,
        f"SELECT * FROM ({_result_rows(DIGITS)}) QUALIFY row_number() OVER (PARTITION BY segment ORDER BY accuracy_by_day, ds) = 1",
        recursive=True,
    ),
    "model_mape_daily": sql.query(_MODEL, _mape("by_day", DIGITS), recursive=True),
    "model_mape_monthly": sql.query(_MODEL, _mape("by_month", DIGITS), recursive=True),
    "published_reconcile_daily": sql.query(_MODEL, error_rows("ds", "by_day", DIGITS), recursive=True),
    "published_mape_monthly": sql.query(_MODEL, _mape("by_month", DIGITS), recursive=True),
    "model_export_month": sql.query(_MODEL, error_rows("year_month", "by_month", DIGITS), recursive=True),
}
