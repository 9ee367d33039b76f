"""Spectrum, regressors, least-squares baseline and model dates, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.holidays import all_rules, holiday_calendar, holidays_by_day
from tidecast.functions.numbers import rounded
from tidecast.operators import features, regression, spectral
from tidecast.operators import series as ops
from tidecast.plans import sql
from tidecast.session import settle
from tidecast.sources import tickets as src
from tidecast.sources.files import literal_table
from tidecast.sources.registry import SEGMENTS, STAR_DATES, STAR_OVERRIDES, setting_of
from tidecast.sources.schemas import OVERRIDES

# History plus the longest forecast horizon of the test tables, for their SQL twins.
YEARS = (STAR_DATES.years[0], STAR_DATES.years[-1] + 1)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return ops.segment_series(src.daily_location(spark, folder))


def _orgs(spark: SparkSession, folder: str) -> DataFrame:
    return ops.org_series(src.daily_location(spark, folder))


def settled_days(spark: SparkSession, folder: str) -> DataFrame:
    """Model input per segment and date. Used several times per plan, so it is computed once."""
    return settle(ops.series_days(ops.segment_rows(src.daily_location(spark, folder))))


def whole_history(days: DataFrame) -> DataFrame:
    """One cutoff per segment, at its last day: the fit on everything."""
    return days.groupBy("segment").agg(F.max("ds").alias("cutoff"))


def periodogram(spark: SparkSession, folder: str) -> DataFrame:
    found = spectral.periodogram(_segments(spark, folder))
    return found.select(
        "segment", "k", "n", rounded(F.col("frequency")).alias("frequency"), rounded(F.col("spectrum")).alias("spectrum")
    )


def periodogram_orgs(spark: SparkSession, folder: str) -> DataFrame:
    found = spectral.periodogram(_orgs(spark, folder), "series")
    return found.select(
        "series", "k", "n", rounded(F.col("frequency")).alias("frequency"), rounded(F.col("spectrum")).alias("spectrum")
    )


def periodogram_bands(spark: SparkSession, folder: str) -> DataFrame:
    found = spectral.named_bands(spectral.periodogram(_segments(spark, folder)))
    return found.select(
        "segment",
        "band",
        "cycles",
        "k",
        rounded(F.col("frequency")).alias("frequency"),
        rounded(F.col("spectrum")).alias("spectrum"),
    )


def fourier_features(spark: SparkSession, folder: str) -> DataFrame:
    series = _orgs(spark, folder)
    wide = series.select("series", "ds", *features.fourier_columns(F.col("ds")))
    return wide.select("series", "ds", *[rounded(F.col(n)).alias(n) for n in features.FOURIER_NAMES])


def design_matrix(spark: SparkSession, folder: str) -> DataFrame:
    placed = features.with_position(_orgs(spark, folder), "series")
    wide = placed.select(
        "series", "ds", "position", *features.design_columns(F.col("position"), F.col("ds"))
    )
    names = features.DESIGN_NAMES
    return wide.select("series", "ds", "position", *[rounded(F.col(n)).alias(n) for n in names])


def ols_gram(spark: SparkSession, folder: str) -> DataFrame:
    rows = regression.design_rows(_orgs(spark, folder), "series")
    return regression.gram(rows, "series").select(
        "series", "i", "j", rounded(F.col("value"), 4).alias("value")
    )


def design_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term of the design per series, and whether the fit holds it or finds it made up of the terms before."""
    rows = regression.design_rows(_orgs(spark, folder), "series")
    return regression.kept_terms(regression.gram(rows, "series"), "series")


def ols_fit(spark: SparkSession, folder: str) -> DataFrame:
    fits = regression.named_coefficients(regression.fit_ols(_orgs(spark, folder), "series"), "series")
    return fits.select("series", "term", rounded(F.col("beta")).alias("beta"))


def ols_in_sample(spark: SparkSession, folder: str) -> DataFrame:
    series = settle(_orgs(spark, folder))
    rows = regression.design_rows(series, "series")
    fitted = regression.predict_ols(rows, regression.fit_ols(series, "series"), "series")
    return fitted.select("series", "ds", "position", "y", rounded(F.col("yhat")).alias("yhat"))


def ols_forecast_365(spark: SparkSession, folder: str) -> DataFrame:
    series = settle(_orgs(spark, folder))
    ahead = regression.forecast_ols(series, regression.fit_ols(series, "series"), "series")
    return ahead.select("series", "ds", "position", rounded(F.col("yhat")).alias("yhat"))


def _corrected(spark: SparkSession, folder: str) -> DataFrame:
    """The organisations' series after the outlier corrections."""
    return settle(ops.apply_overrides(_orgs(spark, folder), literal_table(spark, STAR_OVERRIDES, OVERRIDES)))


def ols_overridden_in_sample(spark: SparkSession, folder: str) -> DataFrame:
    corrected = _corrected(spark, folder)
    rows = regression.design_rows(corrected, "series")
    fitted = regression.predict_ols(rows, regression.fit_ols(corrected, "series"), "series")
    return fitted.select("series", "ds", "position", "y", rounded(F.col("yhat")).alias("yhat"))


def ols_overridden_forecast_365(spark: SparkSession, folder: str) -> DataFrame:
    corrected = _corrected(spark, folder)
    ahead = regression.forecast_ols(corrected, regression.fit_ols(corrected, "series"), "series")
    return ahead.select("series", "ds", "position", rounded(F.col("yhat")).alias("yhat"))


def ols_overridden(spark: SparkSession, folder: str) -> DataFrame:
    """The baseline's coefficients after the outlier corrections."""
    corrected = _corrected(spark, folder)
    fits = regression.named_coefficients(regression.fit_ols(corrected, "series"), "series")
    return fits.select("series", "term", rounded(F.col("beta")).alias("beta"))


def holiday_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Holidays of each segment's calendar on the days it has tickets."""
    days = _segments(spark, folder).withColumn("country", setting_of("country"))
    calendar = holidays_by_day(holiday_calendar(spark, *features.calendar_years(days)))
    return days.join(calendar, ["country", "ds"], "left").select(
        "segment", "country", "ds", "y", F.array_join("names", "; ").alias("holidays")
    )


def future_frame(spark: SparkSession, folder: str) -> DataFrame:
    return features.future_frame(settled_days(spark, folder))


def _changepoints(days: DataFrame) -> DataFrame:
    spans = features.training_spans(days, whole_history(days))
    return features.changepoint_dates(days, spans)


def changepoints(spark: SparkSession, folder: str) -> DataFrame:
    return _changepoints(settled_days(spark, folder))


def changepoint_rows(spark: SparkSession, folder: str) -> DataFrame:
    """History rows on the candidate dates."""
    days = settled_days(spark, folder)
    observed = days.select("segment", "ds", F.explode("ys").alias("y"))
    return observed.join(_changepoints(days), ["segment", "ds"], "left_semi")


QUERIES = {
    f.__name__: f
    for f in (
        periodogram,
        periodogram_orgs,
        periodogram_bands,
        fourier_features,
        design_matrix,
        ols_gram,
        design_terms,
        ols_fit,
        ols_in_sample,
        ols_forecast_365,
        ols_overridden,
        ols_overridden_in_sample,
        ols_overridden_forecast_365,
        holiday_flags,
        future_frame,
        changepoints,
        changepoint_rows,
    )
}


def _spectrum(table: str, key: str) -> str:
    return f""",
placed AS (SELECT {key}, y, CAST(row_number() OVER (PARTITION BY {key} ORDER BY ds) - 1 AS DOUBLE) AS x FROM {table}),
line AS (SELECT {key}, count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM placed GROUP BY {key}),
rest AS (SELECT {key}, n, x, y - a * x - b AS e FROM placed JOIN line USING ({key})),
waves AS (SELECT {key}, n, unnest(range(n // 2 + 1)) AS k FROM line),
sums AS (SELECT w.{key}, w.n, w.k, sum(e * cos(2 * pi() * w.k * x / w.n)) AS c, sum(e * sin(2 * pi() * w.k * x / w.n)) AS s
         FROM waves w JOIN rest r ON r.{key} = w.{key} GROUP BY ALL),
spectrum AS (SELECT {key}, CAST(k AS INTEGER) AS k, CAST(n AS INTEGER) AS n, {sql.rnd('CAST(365 AS DOUBLE) * k / n')} AS frequency,
         {sql.rnd('(c * c + s * s) / n / n * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END')} AS spectrum FROM sums)"""


_FRACTION = "(CAST(dayofyear(ds) - 1 AS DOUBLE) / dayofyear(make_date(year(ds), 12, 31)))"
_FOURIER = [f"{f}(2 * pi() * {k} * {_FRACTION})" for k in range(1, 11) for f in ("sin", "cos")]
_DUMMIES = [f"CAST(CASE WHEN (position - 1) % 7 = {i - 1} THEN 1 ELSE 0 END AS DOUBLE)" for i in range(2, 8)]
_DESIGN = ["CAST(1 AS DOUBLE)", "CAST(position AS DOUBLE)", *_DUMMIES, *_FOURIER]
_PLACED = (
    sql.ORG_SERIES
    + """,
placed AS (SELECT series, ds, y, CAST(row_number() OVER (PARTITION BY series ORDER BY ds) AS INTEGER) AS position
           FROM org_series)"""
)
_N = len(_DESIGN)
_GRAM = (
    _PLACED
    + f""",
wide AS (SELECT series, ds, position, y, [{', '.join(_DESIGN)}] AS x FROM placed),
xs AS (SELECT series, list_append(x, y) AS x FROM wide),
products AS (SELECT series, i, j, sum(x[i] * x[j]) AS value FROM xs, range(1, {_N + 2}) a(i), range(1, {_N + 2}) b(j)
             GROUP BY ALL)"""
)
# Gauss-Jordan elimination on the normal equations, one pivot per recursion step; ``d`` holds the sums of squares. A column
# of which nothing is left is passed over and has no effect.
_OLS = (
    _GRAM
    + f""",
matrix AS (SELECT series, list(row ORDER BY i) AS m FROM (
             SELECT series, i, list(value ORDER BY j) AS row FROM products WHERE i <= {_N} GROUP BY series, i) GROUP BY series),
steps AS (SELECT series, 1 AS k, m, list_transform(m, lambda r, i: r[i]) AS d FROM matrix
          UNION ALL
          SELECT series, k + 1, list_transform(m, lambda r, i: CASE
              WHEN m[k][k] <= 1e-8 * d[k] THEN list_transform(r, lambda v: CASE WHEN i = k THEN 0.0::DOUBLE ELSE v END)
              WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
              ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END), d
          FROM steps WHERE k <= {_N}),
fit AS (SELECT series, list_transform(m, lambda r: r[{_N + 1}]) AS beta FROM steps WHERE k = {_N + 1})"""
)

_BY_DS = ", ".join(f"'{s.name}'" for s in SEGMENTS if s.by_ds)
OBSERVED = (
    sql.SEGMENTS
    + f""",
observed AS (
  SELECT segment, ds, y FROM series WHERE segment IN ({_BY_DS})
  UNION ALL
  SELECT segment, sys_created_date, CAST(unique_tickets AS DOUBLE) FROM member WHERE segment NOT IN ({_BY_DS}))"""
)
_CHANGEPOINTS = (
    OBSERVED
    + """,
numbered AS (SELECT segment, ds, row_number() OVER (PARTITION BY segment ORDER BY ds) - 1 AS row FROM observed),
reach AS (SELECT segment, max(ds) AS cutoff, CAST(floor(count(*) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS head FROM observed GROUP BY 1),
wanted AS (SELECT segment, cutoff, CAST(round_even(CAST(i * (head - 1) AS DOUBLE) / n, 0) AS BIGINT) AS row
           FROM (SELECT segment, cutoff, head, least(25, head - 1) AS n, unnest(range(1, least(25, head - 1) + 1)) AS i FROM reach)),
changepoints AS (SELECT DISTINCT segment, cutoff, ds FROM wanted JOIN numbered USING (segment, row))"""
)


def _rule_values() -> str:
    quoted = ["(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in all_rules()]
    return ",\n  ".join(quoted)


HOLIDAYS = f"""
rules(country, holiday, kind, month, day, arg, since, until) AS (VALUES
  {_rule_values()}),
live AS (SELECT *, unnest(range(greatest(since, {YEARS[0]}), least(until, {YEARS[1]}) + 1)) AS y FROM rules),
moon AS (SELECT *, (19 * (y % 19) + y // 100 - y // 400 - ((y // 100) - (y // 100 + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM live),
week AS (SELECT *, (32 + 2 * ((y // 100) % 4) + 2 * ((y % 100) // 4) - h - (y % 100) % 4) % 7 AS l FROM moon),
march AS (SELECT *, h + l - 7 * ((y % 19 + 11 * h + 22 * l) // 451) + 114 AS p FROM week),
holidays AS (SELECT country, holiday, CAST(CASE kind
    WHEN 'fixed' THEN make_date(y, month, day)
    WHEN 'on_or_after' THEN make_date(y, month, day) + CAST((arg - (isodow(make_date(y, month, day)) - 1) + 7) % 7 AS INTEGER)
    WHEN 'nearest' THEN CASE isodow(make_date(y, month, day)) WHEN 6 THEN make_date(y, month, day) - 1 WHEN 7 THEN make_date(y, month, day) + 1 END
    WHEN 'monday' THEN CASE isodow(make_date(y, month, day)) WHEN 6 THEN make_date(y, month, day) + 2 WHEN 7 THEN make_date(y, month, day) + 1 END
    WHEN 'two_later' THEN CASE WHEN isodow(make_date(y, month, day)) >= 6 THEN make_date(y, month, day) + 2 END
    WHEN 'not_sunday' THEN make_date(y, month, day) - CASE WHEN isodow(make_date(y, month, day)) = 7 THEN 1 ELSE 0 END
    WHEN 'friday_or_monday' THEN CASE WHEN isodow(make_date(y, month, day)) = 5 THEN make_date(y, month, day)
      ELSE make_date(y, month, day) + CAST((arg - (isodow(make_date(y, month, day)) - 1) + 7) % 7 AS INTEGER) END
    WHEN 'easter' THEN make_date(y, p // 31, p % 31 + 1) + CAST(arg AS INTEGER)
    ELSE make_date(y, month, CAST(floor((y % 100) * 0.2422 + 4.81) - floor((y % 100) / 4) AS BIGINT)) END AS DATE) AS ds
  FROM march WHERE kind NOT IN ('nearest', 'monday', 'two_later') OR isodow(make_date(y, month, day)) >= 6),
names AS (SELECT country, ds, string_agg(DISTINCT holiday, '; ' ORDER BY holiday) AS holidays FROM holidays GROUP BY ALL)"""

COUNTRY_OF = "(VALUES " + ", ".join(f"('{s.name}', '{s.country}')" for s in SEGMENTS) + ") c(segment, country)"

_OLS_CORRECTED = _OLS.replace("FROM org_series)", "FROM corrected)").replace(
    ",\nplaced AS",
    """,
corrected AS (SELECT series, ds, coalesce(y_new, y) AS y
              FROM org_series FULL JOIN (VALUES ('BUILDING', DATE '2000-09-11', CAST(1269 AS DOUBLE)),
                ('MACHINERY', DATE '2001-02-02', CAST(200 AS DOUBLE))) o(series, ds, y_new) USING (series, ds)),
placed AS""",
)


def _ahead(table: str) -> str:
    return f""",
ahead AS (SELECT series, CAST(last_ds + CAST(step AS INTEGER) AS DATE) AS ds, CAST(n + step AS INTEGER) AS position FROM (
            SELECT series, max(ds) AS last_ds, count(*) AS n, unnest(range(1, 366)) AS step FROM {table} GROUP BY series)),
ahead_x AS (SELECT series, ds, position, [{', '.join(_DESIGN)}] AS x FROM ahead)"""


ORACLE = {
    "periodogram": sql.query(sql.SEGMENTS + _spectrum("series", "segment"), "SELECT * FROM spectrum"),
    "periodogram_orgs": sql.query(sql.ORG_SERIES + _spectrum("org_series", "series"), "SELECT * FROM spectrum"),
    "periodogram_bands": sql.query(
        sql.SEGMENTS + _spectrum("series", "segment"),
        """SELECT segment, band, CAST(cycles AS DOUBLE) AS cycles, k, frequency, spectrum FROM spectrum
           JOIN (VALUES ('Annual', 1), ('Semiannual', 2), ('Quarterly', 4), ('Bimonthly', 6), ('Monthly', 12),
                 ('Biweekly', 26), ('Weekly', 52), ('Semiweekly', 104)) b(band, cycles)
           ON k = CAST(floor(CAST(cycles AS DOUBLE) * n / 365 + 0.5) AS INTEGER)""",
    ),
    "fourier_features": sql.query(
        sql.ORG_SERIES,
        "SELECT series, ds, "
        + ", ".join(f"{sql.rnd(e)} AS {n}" for e, n in zip(_FOURIER, features.FOURIER_NAMES))
        + " FROM org_series",
    ),
    "design_matrix": sql.query(
        _PLACED,
        "SELECT series, ds, position, "
        + ", ".join(f"{sql.rnd(e)} AS {n}" for e, n in zip(_DESIGN, features.DESIGN_NAMES))
        + " FROM placed",
    ),
    "ols_gram": sql.query(
        _GRAM,
        f"""SELECT series, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, {sql.rnd('value', 4)} AS value
            FROM products WHERE i <= j""",
    ),
    "design_terms": sql.query(
        _OLS,
        f"""SELECT series, CAST(k - 1 AS INTEGER) AS position, ({features.DESIGN_NAMES!r})[k] AS term, m[k][k] > 1e-8 * d[k] AS kept
            FROM steps WHERE k <= {_N}""",
        recursive=True,
    ),
    "ols_fit": sql.query(
        _OLS,
        f"""SELECT series, unnest({features.DESIGN_NAMES!r}) AS term, {sql.rnd('unnest(beta)')} AS beta FROM fit""",
        recursive=True,
    ),
    "ols_in_sample": sql.query(
        _OLS,
        f"SELECT series, ds, position, y, {sql.rnd('list_inner_product(beta, x)')} AS yhat FROM wide JOIN fit USING (series)",
        recursive=True,
    ),
    "ols_forecast_365": sql.query(
        _OLS + _ahead("org_series"),
        f"SELECT series, ds, position, {sql.rnd('list_inner_product(beta, x)')} AS yhat FROM ahead_x JOIN fit USING (series)",
        recursive=True,
    ),
    "ols_overridden": sql.query(
        _OLS_CORRECTED,
        f"""SELECT series, unnest({features.DESIGN_NAMES!r}) AS term, {sql.rnd('unnest(beta)')} AS beta FROM fit""",
        recursive=True,
    ),
    "ols_overridden_in_sample": sql.query(
        _OLS_CORRECTED,
        f"SELECT series, ds, position, y, {sql.rnd('list_inner_product(beta, x)')} AS yhat FROM wide JOIN fit USING (series)",
        recursive=True,
    ),
    "ols_overridden_forecast_365": sql.query(
        _OLS_CORRECTED + _ahead("corrected"),
        f"SELECT series, ds, position, {sql.rnd('list_inner_product(beta, x)')} AS yhat FROM ahead_x JOIN fit USING (series)",
        recursive=True,
    ),
    "holiday_flags": sql.query(
        sql.SEGMENTS + "," + HOLIDAYS,
        f"""SELECT segment, country, ds, y, holidays FROM series JOIN {COUNTRY_OF} USING (segment)
            LEFT JOIN names USING (country, ds)""",
    ),
    "future_frame": sql.query(
        sql.SEGMENTS,
        """SELECT segment, ds, false AS future FROM series UNION ALL
           SELECT segment, CAST(last_ds + CAST(i AS INTEGER) AS DATE), true
           FROM (SELECT segment, max(ds) AS last_ds FROM series GROUP BY 1), range(1, 181) r(i)""",
    ),
    "changepoints": sql.query(_CHANGEPOINTS, "SELECT * FROM changepoints"),
    "changepoint_rows": sql.query(
        _CHANGEPOINTS, "SELECT o.* FROM observed o SEMI JOIN changepoints c ON c.segment = o.segment AND c.ds = o.ds"
    ),
}
