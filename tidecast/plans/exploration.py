"""Segment filters, daily series and their exploration, each with its DuckDB twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.numbers import rounded
from tidecast.operators import series as ops
from tidecast.plans import sql
from tidecast.sources import tickets as src
from tidecast.sources.files import literal_table
from tidecast.sources.registry import STAR_LABELS, STAR_OVERRIDES
from tidecast.sources.schemas import OVERRIDES

# Fixed value: the day looked up in the outlier review, on the test data's calendar.
REVIEW_DAY = dt.date(2000, 9, 12)
SLICE = (100, 125)  # fixed value: rows shown of each series


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return src.daily_location(spark, folder)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return ops.segment_series(_daily(spark, folder))


def _orgs(spark: SparkSession, folder: str) -> DataFrame:
    return ops.org_series(_daily(spark, folder))


def to_series(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _daily(spark, folder)
        .withColumnsRenamed({"sys_created_date": "ds", "unique_tickets": "y"})
        .select("ds", "y")
    )


def filter_org(spark: SparkSession, folder: str) -> DataFrame:
    return _daily(spark, folder).filter(F.col("organization_flag") == STAR_LABELS.org_a)


def filter_region(spark: SparkSession, folder: str) -> DataFrame:
    return _daily(spark, folder).filter(F.col("level1") == STAR_LABELS.apac)


def filter_country(spark: SparkSession, folder: str) -> DataFrame:
    return _daily(spark, folder).filter(F.col("level2") == STAR_LABELS.united_kingdom)


def filter_region_except(spark: SparkSession, folder: str) -> DataFrame:
    other = ~F.col("level2").eqNullSafe(F.lit(STAR_LABELS.china))
    return _daily(spark, folder).filter((F.col("level1") == STAR_LABELS.apac) & other)


def filter_region_org(spark: SparkSession, folder: str) -> DataFrame:
    return _daily(spark, folder).filter(
        (F.col("level1") == STAR_LABELS.emea) & (F.col("organization_flag") == STAR_LABELS.org_a)
    )


def distinct_countries(spark: SparkSession, folder: str) -> DataFrame:
    return ops.distinct_countries(ops.segment_rows(_daily(spark, folder)))


def segment_series(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder)


def daily_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Total volume per date over all locations."""
    rows = _daily(spark, folder).withColumnsRenamed({"sys_created_date": "ds", "unique_tickets": "y"})
    return rows.groupBy("ds").agg(F.sum("y").alias("unique_tickets"))


def slice_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ops.with_weekday(ops.rows_at(_segments(spark, folder), *SLICE))


def weekly_resample(spark: SparkSession, folder: str) -> DataFrame:
    return ops.weekly(_segments(spark, folder))


def monthly_resample(spark: SparkSession, folder: str) -> DataFrame:
    return ops.monthly(_segments(spark, folder))


def rolling_30_mean(spark: SparkSession, folder: str) -> DataFrame:
    wide = ops.rolling(_segments(spark, folder))
    return wide.select("segment", "ds", "y", rounded(F.col("moving_mean")).alias("moving_mean"))


def rolling_30_std(spark: SparkSession, folder: str) -> DataFrame:
    wide = ops.rolling(_segments(spark, folder))
    return wide.select("segment", "ds", "y", rounded(F.col("moving_std")).alias("moving_std"))


def peak_day(spark: SparkSession, folder: str) -> DataFrame:
    return ops.peak_day(_orgs(spark, folder), "series")


def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _orgs(spark, folder).filter(F.col("ds") == F.lit(REVIEW_DAY))


def apply_overrides(spark: SparkSession, folder: str) -> DataFrame:
    overrides = literal_table(spark, STAR_OVERRIDES, OVERRIDES)
    return ops.apply_overrides(_orgs(spark, folder), overrides)


def _rounded_means(means: DataFrame) -> DataFrame:
    return means.withColumn("mean_y", rounded(F.col("mean_y")))


def seasonal_week_day(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_means(ops.by_week_and_day(_segments(spark, folder)))


def seasonal_year_doy(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_means(ops.by_year_and_day(_segments(spark, folder)))


def seasonal_last_point(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_means(ops.last_points(ops.by_week_and_day(_segments(spark, folder))))


def seasonal_last_point_year(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_means(ops.last_points(ops.by_year_and_day(_segments(spark, folder))))


def n_periods(spark: SparkSession, folder: str) -> DataFrame:
    return ops.period_counts(_segments(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        to_series,
        filter_org,
        filter_region,
        filter_country,
        filter_region_except,
        filter_region_org,
        distinct_countries,
        segment_series,
        daily_rollup,
        slice_rows,
        weekly_resample,
        monthly_resample,
        rolling_30_mean,
        rolling_30_std,
        peak_day,
        point_lookup,
        apply_overrides,
        seasonal_week_day,
        seasonal_year_doy,
        seasonal_last_point,
        seasonal_last_point_year,
        n_periods,
    )
}


def _resample(label: str, bin_of: str, step: str, next_bin: str) -> str:
    return f"""
SELECT g.segment, g.{label}, coalesce(s.y, 0.0) AS y FROM (
  SELECT segment, CAST({next_bin} AS DATE) AS {label} FROM (
    SELECT segment, unnest(generate_series(min({step}), max({step}), {_STEP[label]})) AS b FROM series GROUP BY segment)) g
LEFT JOIN (SELECT segment, CAST({bin_of} AS DATE) AS {label}, sum(y) AS y FROM series GROUP BY ALL) s
  ON s.segment = g.segment AND s.{label} = g.{label}"""


_STEP = {"week_end": "INTERVAL 7 DAY", "month_end": "INTERVAL 1 MONTH"}
_WEEK_START = "date_trunc('week', ds)"
_AROUND = "(PARTITION BY segment ORDER BY ds ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)"


def _rolling(fn: str, name: str) -> str:
    return f"""SELECT segment, ds, y,
  CASE WHEN count(y) OVER {_AROUND} = 30 THEN {sql.rnd(f'{fn}(y) OVER {_AROUND}')} END AS {name} FROM series"""


def _means(period: str, position: str) -> str:
    return f"""SELECT segment, CAST({period} AS INTEGER) AS period, CAST({position} AS INTEGER) AS position,
  {sql.rnd('avg(y)')} AS mean_y FROM series GROUP BY ALL"""


_WEEK_DAY = _means("strftime(ds, '%U')", "isodow(ds) - 1")
_YEAR_DOY = _means("year(ds)", "dayofyear(ds)")


def _last(means: str) -> str:
    return f"""SELECT segment, period, position, mean_y FROM ({means})
  QUALIFY row_number() OVER (PARTITION BY segment, period ORDER BY position DESC) = 1"""


ORACLE = {
    "to_series": sql.query(sql.DAILY, "SELECT sys_created_date AS ds, unique_tickets AS y FROM daily"),
    "filter_org": sql.query(sql.DAILY, "SELECT * FROM daily WHERE organization_flag = 'BUILDING'"),
    "filter_region": sql.query(sql.DAILY, "SELECT * FROM daily WHERE level1 = 'ASIA'"),
    "filter_country": sql.query(sql.DAILY, "SELECT * FROM daily WHERE level2 = 'NATION_3'"),
    "filter_region_except": sql.query(
        sql.DAILY, "SELECT * FROM daily WHERE level1 = 'ASIA' AND level2 IS DISTINCT FROM 'NATION_2'"
    ),
    "filter_region_org": sql.query(
        sql.DAILY, "SELECT * FROM daily WHERE level1 = 'EUROPE' AND organization_flag = 'BUILDING'"
    ),
    "distinct_countries": sql.query(sql.SEGMENTS, "SELECT DISTINCT segment, level2 FROM member"),
    "segment_series": sql.query(sql.SEGMENTS, "SELECT * FROM series"),
    "daily_rollup": sql.query(
        sql.DAILY,
        "SELECT sys_created_date AS ds, CAST(sum(unique_tickets) AS BIGINT) AS unique_tickets FROM daily GROUP BY 1",
    ),
    "slice_rows": sql.query(
        sql.SEGMENTS,
        """SELECT segment, ds, y, CAST(row_number() OVER (PARTITION BY segment ORDER BY ds) - 1 AS INTEGER) AS position,
             dayname(ds) AS day_name FROM series QUALIFY position BETWEEN 100 AND 124""",
    ),
    "weekly_resample": sql.query(
        sql.SEGMENTS, _resample("week_end", f"{_WEEK_START} + INTERVAL 6 DAY", _WEEK_START, "b + INTERVAL 6 DAY")
    ),
    "monthly_resample": sql.query(
        sql.SEGMENTS, _resample("month_end", "last_day(ds)", "date_trunc('month', ds)", "last_day(b)")
    ),
    "rolling_30_mean": sql.query(sql.SEGMENTS, _rolling("avg", "moving_mean")),
    "rolling_30_std": sql.query(sql.SEGMENTS, _rolling("stddev_samp", "moving_std")),
    "peak_day": sql.query(
        sql.ORG_SERIES,
        """SELECT series, y AS peak, ds AS peak_ds FROM org_series
           QUALIFY row_number() OVER (PARTITION BY series ORDER BY y DESC, ds) = 1""",
    ),
    "point_lookup": sql.query(sql.ORG_SERIES, "SELECT * FROM org_series WHERE ds = DATE '2000-09-12'"),
    "apply_overrides": sql.query(
        sql.ORG_SERIES,
        """SELECT series, ds, coalesce(y_new, y) AS y, y_new IS NOT NULL AS overridden
           FROM org_series FULL JOIN (VALUES ('BUILDING', DATE '2000-09-11', CAST(1269 AS DOUBLE)),
             ('MACHINERY', DATE '2001-02-02', CAST(200 AS DOUBLE))) o(series, ds, y_new) USING (series, ds)""",
    ),
    "seasonal_week_day": sql.query(sql.SEGMENTS, _WEEK_DAY),
    "seasonal_year_doy": sql.query(sql.SEGMENTS, _YEAR_DOY),
    "seasonal_last_point": sql.query(sql.SEGMENTS, _last(_WEEK_DAY)),
    "seasonal_last_point_year": sql.query(sql.SEGMENTS, _last(_YEAR_DOY)),
    "n_periods": sql.query(
        sql.SEGMENTS,
        """SELECT segment, CAST(count(DISTINCT strftime(ds, '%U')) AS BIGINT) AS n_weeks,
             CAST(count(DISTINCT year(ds)) AS BIGINT) AS n_years FROM series GROUP BY segment""",
    ),
}
