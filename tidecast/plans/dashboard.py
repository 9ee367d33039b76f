"""Scans and dashboard reports, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.dates import WEEKDAYS
from tidecast.functions.numbers import rounded
from tidecast.operators import reports
from tidecast.plans import sql
from tidecast.session import new_output_dir, settle
from tidecast.sources import tickets as src
from tidecast.sources.files import read_csv, read_table, write_csv
from tidecast.sources.registry import STAR_DATES
from tidecast.sources.schemas import DAILY_LOCATION

def _names(spark: SparkSession, folder: str, dimension: str, column: str) -> list[str]:
    """The column names of a wide report: every name of a dimension, a bounded list that does not depend on the facts."""
    return [r[0] for r in read_table(spark, folder, dimension).select(column).distinct().orderBy(column).collect() if r[0]]


def _days(spark: SparkSession, folder: str) -> DataFrame:
    return src.day_export(src.daily_location(spark, folder))


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    return src.request_export(src.request_location(spark, folder))


def first_touch_daily(spark: SparkSession, folder: str) -> DataFrame:
    return src.daily_org(spark, folder).orderBy("sys_created_date", "organization_flag")


def first_touch_events(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts from the flat event table, whatever its rows per ticket say about location."""
    touched = src.first_touch(src.tickets(spark, folder), STAR_DATES)
    return src.count_by_day(touched, ("organization_flag",))


def scan_tickets(spark: SparkSession, folder: str) -> DataFrame:
    return src.tickets(spark, folder)


def scan_daily(spark: SparkSession, folder: str) -> DataFrame:
    path = write_csv(src.daily_location(spark, folder), new_output_dir(spark, "daily"))
    return read_csv(spark, path, DAILY_LOCATION)


def row_count(spark: SparkSession, folder: str) -> DataFrame:
    return src.daily_org(spark, folder).agg(F.count(F.lit(1)).alias("row_count"))


def preview(spark: SparkSession, folder: str) -> DataFrame:
    return first_touch_daily(spark, folder).limit(5)


def tickets_by_country(spark: SparkSession, folder: str) -> DataFrame:
    return reports.rows_by(_requests(spark, folder), ["level2"], "tickets")


def top10_countries(spark: SparkSession, folder: str) -> DataFrame:
    return reports.top_rows(tickets_by_country(spark, folder), "tickets", "level2", 10)


def requests_by_region_country(spark: SparkSession, folder: str) -> DataFrame:
    return reports.sum_by(_requests(spark, folder), ["level1", "level2"], "unique_requests", "unique_requests")


def top_country_per_region(spark: SparkSession, folder: str) -> DataFrame:
    volume = requests_by_region_country(spark, folder)
    return reports.top_per_group(volume, ["level1"], "unique_requests", "level2", 1).drop("rank")


def requests_by_region(spark: SparkSession, folder: str) -> DataFrame:
    return reports.sum_by(_requests(spark, folder), ["level1"], "unique_requests", "unique_requests")


def requests_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return reports.requests_by_month(_requests(spark, folder))


def weekday_avg_by_month(spark: SparkSession, folder: str) -> DataFrame:
    wide = reports.weekday_average_by_month(_requests(spark, folder))
    return wide.select("month_year", *[rounded(F.col(d)).alias(d) for d in WEEKDAYS])


def tickets_by_weekday(spark: SparkSession, folder: str) -> DataFrame:
    return reports.sum_by(_days(spark, folder), ["day_name"], "unique_tickets", "unique_tickets")


def pivot_day_year(spark: SparkSession, folder: str) -> DataFrame:
    years = STAR_DATES.years
    wide = reports.pivot_sum(_days(spark, folder), ["day_name"], "created_year", years, "unique_tickets")
    return wide.select("day_name", *[F.col(str(y)).alias(f"y{y}") for y in years])


def pivot_day_region(spark: SparkSession, folder: str) -> DataFrame:
    return reports.pivot_sum(_days(spark, folder), ["day_name"], "level1", _names(spark, folder, "region", "r_name"), "unique_tickets")


def tickets_by_month_of_year(spark: SparkSession, folder: str) -> DataFrame:
    return reports.sum_by(_days(spark, folder), ["created_month"], "unique_tickets", "unique_tickets")


def tickets_by_year_country(spark: SparkSession, folder: str) -> DataFrame:
    return reports.sum_by(_days(spark, folder), ["created_year", "level2"], "unique_tickets", "unique_tickets")


def top5_rows_per_region(spark: SparkSession, folder: str) -> DataFrame:
    counts = reports.rows_by(_days(spark, folder), ["level1", "level2"], "export_rows")
    return reports.top_per_group(counts, ["level1"], "export_rows", "level2", 5)


def top5_tickets_per_region(spark: SparkSession, folder: str) -> DataFrame:
    volume = reports.sum_by(_days(spark, folder), ["level1", "level2"], "unique_tickets", "unique_tickets")
    return reports.top_per_group(volume, ["level1"], "unique_tickets", "level2", 5)


def top5_per_day(spark: SparkSession, folder: str) -> DataFrame:
    return reports.top_countries_per_day(_days(spark, folder))


def pivot_top5(spark: SparkSession, folder: str) -> DataFrame:
    top = reports.top_countries_per_day(_days(spark, folder))
    return reports.pivot_sum(top, ["level1", "day_name"], "level2", _names(spark, folder, "nation", "n_name"), "unique_tickets").na.fill(0)


def stacked_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return reports.stacked_offsets(settle(reports.top_countries_per_day(_days(spark, folder))))


def axis_bound(spark: SparkSession, folder: str) -> DataFrame:
    return reports.axis_bound(_days(spark, folder)).select("level1", rounded(F.col("upper")).alias("upper"))


QUERIES = {
    f.__name__: f
    for f in (
        first_touch_daily,
        first_touch_events,
        scan_tickets,
        scan_daily,
        row_count,
        preview,
        tickets_by_country,
        top10_countries,
        requests_by_region_country,
        top_country_per_region,
        requests_by_region,
        requests_by_month,
        weekday_avg_by_month,
        tickets_by_weekday,
        pivot_day_year,
        pivot_day_region,
        tickets_by_month_of_year,
        tickets_by_year_country,
        top5_rows_per_region,
        top5_tickets_per_region,
        top5_per_day,
        pivot_top5,
        stacked_offsets,
        axis_bound,
    )
}

# The names in the test tables' dimensions; a query's columns are fixed in SQL.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
COUNTRIES = tuple(f"NATION_{i}" for i in range(25))
_FIRST_TOUCH_DAILY = """
SELECT sys_created_date, CAST(year(sys_created_date) AS INTEGER) AS created_year,
       CAST(month(sys_created_date) AS INTEGER) AS created_month,
       CAST(weekofyear(sys_created_date) AS INTEGER) AS created_week,
       CAST(isodow(sys_created_date) AS INTEGER) AS created_day_number, organization_flag,
       CAST(count(*) AS BIGINT) AS unique_tickets
FROM first_touch GROUP BY sys_created_date, organization_flag"""

_TOP5 = """,
volume AS (SELECT level1, day_name, level2, CAST(sum(unique_tickets) AS BIGINT) AS unique_tickets
           FROM day_export GROUP BY ALL),
top5 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY level1, day_name
           ORDER BY unique_tickets DESC, level2) AS INTEGER) AS rank FROM volume) WHERE rank <= 5)"""


def _sum(keys: str, table: str, measure: str) -> str:
    return f"SELECT {keys}, CAST(sum({measure}) AS BIGINT) AS {measure} FROM {table} GROUP BY ALL"


_REQUESTS = sql.REQUEST_DAILY + ",\nrequests AS (SELECT sys_created_date, level1, level2, unique_tickets AS unique_requests FROM daily)"
_COUNTRY_ROWS = "SELECT level2, CAST(count(*) AS BIGINT) AS tickets FROM requests GROUP BY level2"
_REGION_COUNTRY = _sum("level1, level2", "requests", "unique_requests")

ORACLE = {
    "first_touch_daily": sql.query(sql.FIRST_TOUCH, _FIRST_TOUCH_DAILY + " ORDER BY 1, 6"),
    "first_touch_events": sql.query(
        sql.FIRST_TOUCH,
        "SELECT sys_created_date, organization_flag, CAST(count(*) AS BIGINT) AS unique_tickets FROM first_touch GROUP BY ALL",
    ),
    "scan_tickets": sql.query(sql.TICKETS, "SELECT * FROM tickets"),
    "scan_daily": sql.query(sql.DAILY, "SELECT * FROM daily"),
    "row_count": sql.query(
        sql.FIRST_TOUCH, f"SELECT CAST(count(*) AS BIGINT) AS row_count FROM ({_FIRST_TOUCH_DAILY})"
    ),
    "preview": sql.query(sql.FIRST_TOUCH, _FIRST_TOUCH_DAILY + " ORDER BY 1, 6 LIMIT 5"),
    "tickets_by_country": sql.query(_REQUESTS, _COUNTRY_ROWS),
    "top10_countries": sql.query(_REQUESTS, _COUNTRY_ROWS + " ORDER BY tickets DESC, level2 LIMIT 10"),
    "requests_by_region_country": sql.query(_REQUESTS, _REGION_COUNTRY),
    "top_country_per_region": sql.query(
        _REQUESTS,
        f"""SELECT level1, level2, unique_requests FROM ({_REGION_COUNTRY})
        QUALIFY row_number() OVER (PARTITION BY level1 ORDER BY unique_requests DESC, level2) = 1""",
    ),
    "requests_by_region": sql.query(_REQUESTS, _sum("level1", "requests", "unique_requests")),
    "requests_by_month": sql.query(
        _REQUESTS,
        _sum("CAST(date_trunc('month', sys_created_date) AS DATE) AS month_year", "requests", "unique_requests"),
    ),
    "weekday_avg_by_month": sql.query(
        _REQUESTS,
        "SELECT CAST(date_trunc('month', sys_created_date) AS DATE) AS month_year, "
        + ", ".join(
            f"{sql.rnd(f'''avg(unique_requests) FILTER (dayname(sys_created_date) = '{d}')''')} AS {d}" for d in WEEKDAYS
        )
        + " FROM requests GROUP BY 1",
    ),
    "tickets_by_weekday": sql.query(sql.DAY_EXPORT, _sum("day_name", "day_export", "unique_tickets")),
    "pivot_day_year": sql.query(
        sql.DAY_EXPORT,
        "SELECT day_name, "
        + ", ".join(
            f"CAST(sum(unique_tickets) FILTER (created_year = {y}) AS BIGINT) AS y{y}" for y in STAR_DATES.years
        )
        + " FROM day_export GROUP BY 1",
    ),
    "pivot_day_region": sql.query(
        sql.DAY_EXPORT,
        "SELECT day_name, "
        + ", ".join(f"CAST(sum(unique_tickets) FILTER (level1 = '{r}') AS BIGINT) AS \"{r}\"" for r in REGIONS)
        + " FROM day_export GROUP BY 1",
    ),
    "tickets_by_month_of_year": sql.query(sql.DAY_EXPORT, _sum("created_month", "day_export", "unique_tickets")),
    "tickets_by_year_country": sql.query(
        sql.DAY_EXPORT, _sum("created_year, level2", "day_export", "unique_tickets")
    ),
    "top5_rows_per_region": sql.query(
        sql.DAY_EXPORT,
        """SELECT level1, level2, export_rows, CAST(row_number() OVER (PARTITION BY level1
             ORDER BY export_rows DESC, level2) AS INTEGER) AS rank
           FROM (SELECT level1, level2, CAST(count(*) AS BIGINT) AS export_rows FROM day_export GROUP BY ALL)
           QUALIFY rank <= 5""",
    ),
    "top5_tickets_per_region": sql.query(
        sql.DAY_EXPORT,
        f"""SELECT level1, level2, unique_tickets, CAST(row_number() OVER (PARTITION BY level1
             ORDER BY unique_tickets DESC, level2) AS INTEGER) AS rank
           FROM ({_sum("level1, level2", "day_export", "unique_tickets")}) QUALIFY rank <= 5""",
    ),
    "top5_per_day": sql.query(sql.DAY_EXPORT + _TOP5, "SELECT * FROM top5"),
    "pivot_top5": sql.query(
        sql.DAY_EXPORT + _TOP5,
        "SELECT level1, day_name, "
        + ", ".join(
            f"CAST(coalesce(sum(unique_tickets) FILTER (level2 = '{c}'), 0) AS BIGINT) AS {c}" for c in COUNTRIES
        )
        + " FROM top5 GROUP BY ALL",
    ),
    "stacked_offsets": sql.query(
        sql.DAY_EXPORT + _TOP5,
        """SELECT g.level1, g.day_name, g.level2, CAST(coalesce(t.unique_tickets, 0) AS BIGINT) AS unique_tickets,
             CAST(coalesce(sum(coalesce(t.unique_tickets, 0)) OVER (PARTITION BY g.level1, g.day_name ORDER BY g.level2
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bottom
           FROM (SELECT * FROM (SELECT DISTINCT level1, day_name FROM top5)
                 JOIN (SELECT DISTINCT level1, level2 FROM top5) USING (level1)) g
           LEFT JOIN top5 t ON t.level1 = g.level1 AND t.day_name = g.day_name AND t.level2 = g.level2""",
    ),
    "axis_bound": sql.query(
        sql.DAY_EXPORT + _TOP5,
        f"SELECT level1, {sql.rnd('CAST(max(unique_tickets) AS DOUBLE) * 1.1')} AS upper FROM volume GROUP BY level1",
    ),
}
