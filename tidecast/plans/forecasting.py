"""Fits, forecasts, back-tests and tuning of the decomposable model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.numbers import rounded
from tidecast.operators import backtest, bands, features, forecast, sampler, series
from tidecast.plans import model_sql, sql
from tidecast.plans.modelling import COUNTRY_OF, OBSERVED, settled_days, whole_history
from tidecast.session import settle
from tidecast.sources import tickets as src
from tidecast.sources.files import literal_table
from tidecast.sources.registry import SEGMENTS, STAR_DATES, setting_of

# Model results pass through chains of solves; they are compared to four digits.
DIGITS = 4
CV_SEGMENTS = [s.name for s in SEGMENTS if s.cv_initial]
GRID_SEGMENTS = [s.name for s in SEGMENTS if s.grid]
SHORT_SEGMENTS = [s.name for s in SEGMENTS if s.cv_30_days]
TUNED_SEGMENTS = [s.name for s in SEGMENTS if s.trials]
#: Settings per segment that `search_proposals` asks for.
PROPOSED = 20


def _r(name: str) -> Column:
    return rounded(F.col(name), DIGITS).alias(name)


def _only(days: DataFrame, names: list[str]) -> DataFrame:
    return days.filter(F.col("segment").isin(names))


def _seasonal(days: DataFrame, calendar: str = "country") -> DataFrame:
    return features.with_season(days, setting_of(calendar), features.calendar_years(days))


def _whole_fit(spark: SparkSession, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trend inputs and the fit of every segment on its whole history with its own setting."""
    cutoffs = whole_history(days)
    inputs = settle(forecast.trend_inputs(days, cutoffs))
    return inputs, forecast.fit(_seasonal(days), inputs, backtest.tuned_settings(spark))


def whole_forecast(spark: SparkSession, days: DataFrame) -> DataFrame:
    """History and the next 180 days with components and bands."""
    inputs, fits = _whole_fit(spark, days)
    frame = features.future_frame(days).join(whole_history(days), "segment")
    return forecast.components(forecast.with_trend(_seasonal(frame), inputs), fits)


def fit_status(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of the registry: whether it is fitted on its whole history, or why not."""
    days = settled_days(spark, folder)
    names = literal_table(spark, [(s.name,) for s in SEGMENTS], T.StructType([T.StructField("segment", T.StringType())]))
    windows = names.join(whole_history(days), "segment", "left").select("segment", "cutoff")
    return forecast.fit_status(days, windows)


def forecast_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients in long form: trend (level, slope, changes), then season (weekly, yearly, holidays)."""
    _, fits = _whole_fit(spark, settled_days(spark, folder))
    long = forecast.long_coefficients(fits)
    return long.select("segment", "mode", "part", "position", _r("sigma"), _r("beta"))


def forecast_180(spark: SparkSession, folder: str) -> DataFrame:
    found = whole_forecast(spark, settled_days(spark, folder))
    return found.select("segment", "ds", "future", _r("yhat"))


def forecast_components(spark: SparkSession, folder: str) -> DataFrame:
    found = whole_forecast(spark, settled_days(spark, folder))
    parts = [_r(c) for c in ("trend", "weekly", "yearly", "holidays")]
    return found.select("segment", "ds", "mode", *parts)


def forecast_bands(spark: SparkSession, folder: str) -> DataFrame:
    found = whole_forecast(spark, settled_days(spark, folder))
    return found.select("segment", "ds", _r("yhat"), _r("yhat_lower"), _r("yhat_upper"))


def simulated_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The next 180 days with bands from simulated trend changes, which widen with the days ahead."""
    days = settled_days(spark, folder)
    inputs, fits = _whole_fit(spark, days)
    fits = settle(fits)
    frame = features.future_frame(days).filter("future").join(whole_history(days), "segment")
    ahead = forecast.components(forecast.with_trend(_seasonal(frame), inputs), fits)
    found = bands.simulated_bands(ahead, bands.trend_prospects(inputs, fits), features.FUTURE_DAYS)
    return found.select("segment", "ds", "step", _r("yhat"), _r("yhat_lower"), _r("yhat_upper"))


def changepoint_deltas(spark: SparkSession, folder: str) -> DataFrame:
    inputs, fits = _whole_fit(spark, settled_days(spark, folder))
    return forecast.changepoint_deltas(inputs, fits).select("segment", "ds", _r("delta"), "significant")


def cv_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.generated_cutoffs(settled_days(spark, folder), backtest.INITIAL)


def cutoff_ladder(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.ladder_cutoffs(settled_days(spark, folder))


def cv_windows(spark: SparkSession, folder: str) -> DataFrame:
    days = settled_days(spark, folder)
    cutoffs = backtest.generated_cutoffs(days, backtest.INITIAL)
    return backtest.window_summary(backtest.windows(days, cutoffs), full_history=days)


def cv_windows_fixed(spark: SparkSession, folder: str) -> DataFrame:
    days = settled_days(spark, folder)
    cutoffs = backtest.fixed_cutoffs(days, STAR_DATES.cutoffs)
    return backtest.window_summary(backtest.windows(days, cutoffs), full_history=days)


def _windows(days: DataFrame, cutoffs: DataFrame, calendar: str = "country") -> tuple[DataFrame, DataFrame]:
    """Days with their season, and the windows' trend inputs.

    Cutoffs and trend inputs, a few values per window, are settled; the days are not, as their regressors are
    cheap to form again and many times larger than what they are formed from.
    """
    inputs = settle(forecast.trend_inputs(days, settle(cutoffs)))
    return _seasonal(days, calendar), inputs


def _batches(spark: SparkSession, segments: list[str]) -> int:
    """As many batches of windows per segment as give every core of the cluster two groups."""
    return max(1, -(-2 * spark.sparkContext.defaultParallelism // max(1, len(segments))))


def _cv_model(spark: SparkSession, days: DataFrame, cutoffs: DataFrame, horizon: int) -> DataFrame:
    """Out-of-sample forecasts of the tuned model with its band, one row per observation."""
    seasonal, inputs = _windows(days, cutoffs)
    fits = forecast.fit(seasonal, inputs, backtest.tuned_settings(spark), _batches(spark, CV_SEGMENTS))
    test = forecast.components(backtest.horizon_rows(seasonal, inputs, horizon), fits)
    return test.select("segment", "cutoff", "ds", F.explode("ys").alias("y"), "yhat", "yhat_lower", "yhat_upper")


def _cv_generated(spark: SparkSession, folder: str) -> DataFrame:
    days = _only(settled_days(spark, folder), CV_SEGMENTS)
    return _cv_model(spark, days, backtest.generated_cutoffs(days, backtest.INITIAL), backtest.HORIZON)


def cv_forecast(spark: SparkSession, folder: str) -> DataFrame:
    cv = _cv_generated(spark, folder)
    return cv.select("segment", "cutoff", "ds", "y", _r("yhat"))


def cv_forecast_fixed(spark: SparkSession, folder: str) -> DataFrame:
    days = _only(settled_days(spark, folder), CV_SEGMENTS)
    cutoffs = backtest.fixed_cutoffs(days, STAR_DATES.cutoffs)
    cv = _cv_model(spark, days, cutoffs, backtest.HORIZON)
    return cv.select("segment", "cutoff", "ds", "y", _r("yhat"))


def requests_cv_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed cutoffs on the request table, whose volume does not fade towards the end of the history."""
    daily = src.request_location(spark, folder)
    days = _only(settle(series.series_days(series.segment_rows(daily))), CV_SEGMENTS)
    cv = _cv_model(spark, days, backtest.fixed_cutoffs(days, STAR_DATES.cutoffs), backtest.HORIZON)
    return cv.select("segment", "cutoff", "ds", "y", _r("yhat"))


def cv_model_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Overall error measures of the tuned model's back-test."""
    return _rounded(backtest.overall_metrics(_cv_generated(spark, folder)), DIGITS)


def model_metrics_by_horizon(spark: SparkSession, folder: str) -> DataFrame:
    """Error measures of the tuned model by days ahead."""
    return _rounded(backtest.metrics_by_horizon(settle(_cv_generated(spark, folder))), DIGITS)


def model_ape_points(spark: SparkSession, folder: str) -> DataFrame:
    """Absolute percentage errors of the tuned model's back-test by days ahead."""
    points = backtest.ape_points(_cv_generated(spark, folder))
    return points.select("segment", "cutoff", "ds", "horizon", _r("ape"))


def _line_cv(spark: SparkSession, folder: str) -> DataFrame:
    days = settled_days(spark, folder)
    cutoffs = backtest.generated_cutoffs(days, backtest.INITIAL)
    return backtest.trend_line_cv(backtest.windows(days, cutoffs))


METRICS = ("mse", "rmse", "mae", "mape", "mdape", "smape", "coverage")


def _rounded(metrics: DataFrame, digits: int = 6) -> DataFrame:
    keys = [c for c in metrics.columns if c not in METRICS]
    return metrics.select(*keys, *[rounded(F.col(m), 6 if m == "coverage" else digits).alias(m) for m in METRICS])


def cv_metrics_by_horizon(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(backtest.metrics_by_horizon(settle(_line_cv(spark, folder))))


def cv_metrics_overall(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(backtest.overall_metrics(_line_cv(spark, folder)))


def cv_ape_points(spark: SparkSession, folder: str) -> DataFrame:
    points = backtest.ape_points(_line_cv(spark, folder))
    return points.select("segment", "cutoff", "ds", "horizon", rounded(F.col("ape")).alias("ape"))


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """Segments found in the data, with the number of days and observations a search would fit."""
    days = settled_days(spark, folder)
    return days.groupBy("segment").agg(F.count(F.lit(1)).alias("n_days"), F.sum(F.size("ys")).alias("n_rows"))


def param_grid(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.grid_settings(_names(spark, folder))


def search_space(spark: SparkSession, folder: str) -> DataFrame:
    return backtest.search_settings(_names(spark, folder))


def _grid_scores(spark: SparkSession, folder: str) -> DataFrame:
    days = _only(settled_days(spark, folder), GRID_SEGMENTS)
    cutoffs = backtest.generated_cutoffs(days, backtest.GRID_INITIAL)
    return _grid_of(days, cutoffs, backtest.HORIZON, _batches(spark, GRID_SEGMENTS))


def _grid_of(days: DataFrame, cutoffs: DataFrame, horizon: int, batches: int) -> DataFrame:
    seasonal, inputs = _windows(days, cutoffs)
    settings = backtest.grid_settings(days.select("segment").distinct())
    return backtest.tuning_scores(backtest.without_holidays(seasonal), inputs, settings, horizon, batches)


def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    scores = _grid_scores(spark, folder)
    return scores.select("segment", "param_id", "cps", "sps", _r("mape"))


def grid_search_rmse(spark: SparkSession, folder: str) -> DataFrame:
    """The same grid scored by RMSE on the fixed cutoffs, thirty days ahead."""
    days = _only(settled_days(spark, folder), SHORT_SEGMENTS)
    cutoffs = backtest.fixed_cutoffs(days, STAR_DATES.cutoffs)
    scores = _grid_of(days, cutoffs, backtest.SHORT_HORIZON, _batches(spark, SHORT_SEGMENTS))
    return scores.select("segment", "param_id", "cps", "sps", _r("rmse"))


def best_params(spark: SparkSession, folder: str) -> DataFrame:
    best = backtest.best_setting(_grid_scores(spark, folder), "mape")
    return best.select("segment", "param_id", "cps", "sps", _r("mape"))


def _ladder_windows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Days of the tuned segments with the season of the tuner's calendar, and their windows on the six-cutoff ladder."""
    days = _only(settled_days(spark, folder), TUNED_SEGMENTS)
    return _windows(days, backtest.ladder_cutoffs(days), "tuner_country")


def search_trials(spark: SparkSession, folder: str) -> DataFrame:
    """The settings that the search draws for every segment."""
    days = _only(settled_days(spark, folder), TUNED_SEGMENTS)
    drawn = backtest.sampled_settings(days.select("segment").distinct())
    return drawn.select("segment", "param_id", "cps", "sps", "mode")


def tuned_objective(spark: SparkSession, folder: str) -> DataFrame:
    """The search's objective for each segment's own setting."""
    days, inputs = _ladder_windows(spark, folder)
    scores = backtest.tuning_scores(days, inputs, backtest.tuned_settings(spark), backtest.HORIZON, _batches(spark, TUNED_SEGMENTS))
    return scores.select("segment", "mode", _r("mape"), _r("rmse"))


def random_search(spark: SparkSession, folder: str) -> DataFrame:
    """Best of each segment's sampled settings by MAPE on the six-cutoff ladder."""
    days, inputs = _ladder_windows(spark, folder)
    settings = settle(backtest.sampled_settings(inputs.select("segment").distinct()))
    scores = backtest.tuning_scores(days, inputs, settings, backtest.HORIZON, _batches(spark, TUNED_SEGMENTS))
    best = backtest.best_setting(scores, "mape")
    return best.select("segment", "param_id", "cps", "sps", "mode", _r("mape"))


def _guided(spark: SparkSession, folder: str) -> DataFrame:
    """All trials of the guided search on the six-cutoff ladder."""
    days, inputs = _ladder_windows(spark, folder)

    def score(settings: DataFrame) -> DataFrame:
        return backtest.tuning_scores(days, inputs, settings, backtest.HORIZON, _batches(spark, TUNED_SEGMENTS))

    return sampler.guided_search(inputs.select("segment").distinct(), score, "mape")


def guided_trials(spark: SparkSession, folder: str) -> DataFrame:
    """Every setting that the guided search tried, the round and its score."""
    trials = _guided(spark, folder)
    return trials.select("segment", "round", "param_id", "cps", "sps", "mode", _r("score").alias("mape"))


def guided_search(spark: SparkSession, folder: str) -> DataFrame:
    """Best setting of each segment by the guided search, with as many trials as the plain draw has."""
    trials = _guided(spark, folder).withColumnRenamed("score", "mape")
    best = backtest.best_setting(trials, "mape")
    return best.select("segment", "param_id", "cps", "sps", "mode", _r("mape"))


def search_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """What the guided search would try next, given the scores of the grid."""
    scores = _grid_scores(spark, folder).select("segment", "param_id", "cps", "sps", "mode", F.round("mape", DIGITS).alias("score"))
    return sampler.proposals(settle(scores), F.lit(PROPOSED), 1)


QUERIES = {
    f.__name__: f
    for f in (
        fit_status,
        forecast_fit,
        forecast_180,
        forecast_components,
        forecast_bands,
        simulated_bands,
        changepoint_deltas,
        cv_cutoffs,
        cutoff_ladder,
        cv_windows,
        cv_windows_fixed,
        cv_forecast,
        cv_forecast_fixed,
        cv_model_metrics,
        model_metrics_by_horizon,
        model_ape_points,
        cv_metrics_by_horizon,
        cv_metrics_overall,
        cv_ape_points,
        param_grid,
        search_space,
        grid_search,
        grid_search_rmse,
        best_params,
        requests_cv_forecast,
        search_trials,
        tuned_objective,
        random_search,
        search_proposals,
        guided_trials,
        guided_search,
    )
}

# One recursion step per cutoff; an empty test window moves the next one back.
def _cutoffs(initial: int) -> str:
    return (
        OBSERVED
        + f""",
cut_days AS (SELECT DISTINCT segment, ds FROM observed),
cut_span AS (SELECT segment, min(ds) AS lo, max(ds) AS hi FROM cut_days GROUP BY segment),
ladder AS (
  SELECT segment, lo, CAST(hi - 90 AS DATE) AS cutoff FROM cut_span
  UNION ALL
  SELECT s.segment, s.lo, CAST(CASE WHEN s.next > s.lo AND NOT EXISTS (SELECT 1 FROM cut_days d WHERE d.segment = s.segment
        AND d.ds > s.next AND d.ds <= s.next + 90)
      THEN (SELECT max(ds) FROM cut_days d WHERE d.segment = s.segment AND d.ds <= s.next) - 90 ELSE s.next END AS DATE)
  FROM (SELECT segment, lo, CAST(cutoff - 90 AS DATE) AS next FROM ladder WHERE cutoff >= lo + {initial}) s),
cutoffs AS (SELECT segment, cutoff FROM ladder WHERE cutoff >= lo + {initial})"""
    )


_WINDOWS = """,
windows AS (SELECT segment, cutoff, ds, y, ds <= cutoff AS is_train FROM observed JOIN cutoffs USING (segment)
            WHERE ds <= cutoff + 90)"""
_SUMMARY = """SELECT segment, cutoff, CAST(count(*) FILTER (is_train) AS BIGINT) AS n_train,
  CAST(count(*) FILTER (NOT is_train) AS BIGINT) AS n_test, min(ds) AS first_ds, max(ds) AS last_ds,
  coalesce(sum(y) FILTER (is_train), 0.0) AS sum_train, coalesce(sum(y) FILTER (NOT is_train), 0.0) AS sum_test,
  count(*) FILTER (NOT is_train) > 0 AND (SELECT max(ds) FROM observed o WHERE o.segment = windows.segment) >= cutoff + 90 AS complete
FROM windows GROUP BY segment, cutoff"""
_LINE_CV = _WINDOWS + """,
numbered AS (SELECT *, CAST(ds - DATE '1970-01-01' AS DOUBLE) AS x FROM windows),
line AS (SELECT segment, cutoff, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
           1.2815515655446004::DOUBLE * sqrt(greatest((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / count(*), 1e-8::DOUBLE)) AS half
         FROM numbered WHERE is_train GROUP BY ALL),
cv AS (SELECT segment, cutoff, ds, CAST(ds - cutoff AS INTEGER) AS horizon, y, intercept + slope * x AS yhat, half
       FROM numbered JOIN line USING (segment, cutoff) WHERE NOT is_train),
errors AS (SELECT *, (y - yhat) * (y - yhat) AS se, abs(y - yhat) AS ae, abs(y - yhat) / nullif(abs(y), 0) AS ape,
             abs(y - yhat) / nullif((abs(y) + abs(yhat)) / 2, 0) AS sape,
             CAST(CASE WHEN y >= yhat - half AND y <= yhat + half THEN 1 ELSE 0 END AS DOUBLE) AS inside FROM cv)"""
_OVERALL = f"""SELECT segment, {sql.rnd('avg(se)')} AS mse, {sql.rnd('sqrt(avg(se))')} AS rmse, {sql.rnd('avg(ae)')} AS mae,
  {sql.rnd('avg(ape)')} AS mape, {sql.rnd('median(ape)')} AS mdape, {sql.rnd('avg(sape)')} AS smape,
  {sql.rnd('avg(inside)')} AS coverage FROM errors GROUP BY segment"""
# Every row gets the weight with which it enters the window that ends at a day: whole days count 1,
# the earliest one its missing share.
_BY_HORIZON = f""",
sizes AS (SELECT segment, greatest(CAST(floor(count(*) * CAST(0.1 AS DOUBLE)) AS BIGINT), 1) AS w FROM errors GROUP BY segment),
per_day AS (SELECT segment, horizon, count(*) AS n FROM errors GROUP BY ALL),
upto AS (SELECT segment, horizon, n, w, CAST(sum(n) OVER (PARTITION BY segment ORDER BY horizon) AS BIGINT) AS cum
         FROM per_day JOIN sizes USING (segment)),
weights AS (SELECT e.segment, e.horizon, e.w, d.horizon AS day, d.n, least(d.n, e.w - (e.cum - d.cum)) AS part,
              least(1.0, (e.w - (e.cum - d.cum)) / CAST(d.n AS DOUBLE)) AS weight
            FROM upto e JOIN upto d ON d.segment = e.segment AND d.horizon <= e.horizon AND e.cum - d.cum < e.w
            WHERE e.cum >= e.w),
means AS (SELECT k.segment, k.horizon, sum(weight * se) / any_value(w) AS mse, sum(weight * ae) / any_value(w) AS mae,
            sum(weight * ape) / nullif(sum(weight) FILTER (ape IS NOT NULL), 0) AS mape,
            sum(weight * sape) / nullif(sum(weight) FILTER (sape IS NOT NULL), 0) AS smape,
            (coalesce(sum(inside) FILTER (part = n), 0) * max(n) FILTER (part < n) + sum(inside) FILTER (part < n) * max(part) FILTER (part < n))
              / (max(n) FILTER (part < n) * any_value(w)) AS part_coverage,
            coalesce(part_coverage, sum(inside) / any_value(w)) AS coverage
          FROM weights k JOIN errors r ON r.segment = k.segment AND r.horizon = k.day GROUP BY ALL),
placed AS (SELECT segment, horizon, ape, row_number() OVER (PARTITION BY segment ORDER BY horizon, cutoff, ds, ape) AS row FROM errors),
ends AS (SELECT segment, horizon, w, min(row) AS a, max(row) AS b FROM placed JOIN sizes USING (segment) GROUP BY ALL),
medians AS (SELECT e.segment, e.horizon, median(p.ape) AS mdape FROM ends e JOIN placed p
            ON p.segment = e.segment AND p.row BETWEEN least(e.a, e.b - e.w + 1) AND e.b WHERE e.b >= e.w GROUP BY ALL)"""


def _axis(table: str, name: str) -> str:
    return f"(VALUES {', '.join(f'({i}, CAST({v} AS DOUBLE))' for i, v in enumerate(table))}) {name}({name}_i, {name})"


_NAMES = (
    OBSERVED
    + """,
names AS (SELECT segment, CAST(count(DISTINCT ds) AS BIGINT) AS n_days, CAST(count(*) AS BIGINT) AS n_rows
          FROM observed GROUP BY segment)"""
)

ORACLE = {
    "fit_status": sql.query(
        OBSERVED,
        """SELECT segment, max(ds) AS cutoff, CAST(count(ds) AS BIGINT) AS n_rows,
             CASE count(ds) WHEN 0 THEN 'no history' WHEN 1 THEN 'a single observation' ELSE 'fitted' END AS status
           FROM (SELECT segment FROM segments) LEFT JOIN observed USING (segment) GROUP BY segment""",
    ),
    "cv_cutoffs": sql.query(_cutoffs(180), "SELECT * FROM cutoffs", recursive=True),
    "cutoff_ladder": sql.query(
        OBSERVED,
        """SELECT segment, CAST(hi - CAST(60 + 30 * i AS INTEGER) AS DATE) AS cutoff, CAST(i AS INTEGER) AS step
           FROM (SELECT segment, max(ds) AS hi FROM observed GROUP BY 1), range(1, 7) r(i)""",
    ),
    "cv_windows": sql.query(_cutoffs(180) + _WINDOWS, _SUMMARY, recursive=True),
    "cv_windows_fixed": sql.query(
        OBSERVED
        + """,
cutoffs AS (SELECT segment, cutoff FROM (SELECT segment, min(ds) AS lo FROM observed GROUP BY 1),
  (VALUES (DATE '2001-03-01'), (DATE '2001-01-01'), (DATE '2000-10-01')) c(cutoff) WHERE lo <= cutoff)"""
        + _WINDOWS,
        _SUMMARY,
    ),
    "cv_metrics_by_horizon": sql.query(
        _cutoffs(180) + _LINE_CV + _BY_HORIZON,
        f"""SELECT segment, horizon, {sql.rnd('mse')} AS mse, {sql.rnd('sqrt(mse)')} AS rmse, {sql.rnd('mae')} AS mae,
              {sql.rnd('mape')} AS mape, {sql.rnd('mdape')} AS mdape, {sql.rnd('smape')} AS smape,
              {sql.rnd('coverage')} AS coverage FROM means JOIN medians USING (segment, horizon)""",
        recursive=True,
    ),
    "cv_metrics_overall": sql.query(_cutoffs(180) + _LINE_CV, _OVERALL, recursive=True),
    "cv_ape_points": sql.query(
        _cutoffs(180) + _LINE_CV, f"SELECT segment, cutoff, ds, horizon, {sql.rnd('ape')} AS ape FROM errors", recursive=True
    ),
    "param_grid": sql.query(
        _NAMES,
        f"""SELECT names.*, cps, sps, CAST(cps_i * 4 + sps_i AS INTEGER) AS param_id, 'additive' AS mode
            FROM names, {_axis((0.001, 0.01, 0.1, 0.5), 'cps')}, {_axis((0.01, 0.1, 1.0, 10.0), 'sps')}""",
    ),
    "search_space": sql.query(
        _NAMES,
        """SELECT names.*, round(CAST(0.01 AS DOUBLE) + i * CAST(0.005 AS DOUBLE), 3) AS cps, CAST(0.5 * (j + 1) AS DOUBLE) AS sps,
             mode, CAST((i * 20 + j) * 2 + k AS INTEGER) AS param_id
           FROM names, range(0, 199) a(i), range(0, 20) b(j), (VALUES (0, 'multiplicative'), (1, 'additive')) m(k, mode)""",
    ),
}


def _d(expr: str) -> str:
    return sql.rnd(expr, DIGITS)


def _listed(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _cv_groups(names: list[str]) -> str:
    return f"""SELECT segment || ' ' || cutoff AS gid, segment, cutoff, country FROM cutoffs JOIN {COUNTRY_OF} USING (segment)
      WHERE segment IN {_listed(names)}"""


_CV_PARAMS = f"""SELECT gid AS sid, gid, 0 AS param_id, cps, sps, mode FROM groups JOIN {model_sql.TUNED} USING (segment)"""


def _test_days(horizon: int) -> str:
    return f"""SELECT DISTINCT gid, ds FROM groups g JOIN observed o ON o.segment = g.segment
      AND o.ds > g.cutoff AND o.ds <= g.cutoff + {horizon}"""


_FIXED = """,
cutoffs AS (SELECT segment, cutoff FROM (SELECT segment, min(ds) AS lo FROM observed GROUP BY 1),
  (VALUES (DATE '2001-03-01'), (DATE '2001-01-01'), (DATE '2000-10-01')) c(cutoff) WHERE lo <= cutoff)"""


_LADDER = """,
cutoffs AS (SELECT segment, CAST(hi - CAST(60 + 30 * i AS INTEGER) AS DATE) AS cutoff
            FROM (SELECT segment, max(ds) AS hi FROM observed GROUP BY 1), range(1, 7) r(i))"""
_TUNER_COUNTRY = "(VALUES " + ", ".join(f"('{s.name}', '{s.tuner_country}')" for s in SEGMENTS) + ") c(segment, country)"
_TRIALS = "(VALUES " + ", ".join(f"('{s.name}', {s.trials})" for s in SEGMENTS if s.trials) + ") t(segment, trials)"


def _cv(cutoffs: str, groups: str = _cv_groups(CV_SEGMENTS)) -> str:
    fits = model_sql.model(groups, _CV_PARAMS, _test_days(90), cutoffs=cutoffs)
    return fits + """,
cv AS (SELECT segment, cutoff, ds, CAST(ds - cutoff AS INTEGER) AS horizon, o.y, yhat, sigma FROM predicted JOIN observed o USING (segment, ds)),
errors AS (SELECT *, (y - yhat) * (y - yhat) AS se, abs(y - yhat) AS ae, abs(y - yhat) / nullif(abs(y), 0) AS ape,
             abs(y - yhat) / nullif((abs(y) + abs(yhat)) / 2, 0) AS sape,
             CAST(CASE WHEN abs(y - yhat) <= CAST(1.2815515655446004 AS DOUBLE) * sigma THEN 1 ELSE 0 END AS DOUBLE) AS inside FROM cv)"""


def _grid(names: list[str], cutoffs: str, horizon: int) -> str:
    params = f"""SELECT gid || ' ' || (cps_i * 4 + sps_i) AS sid, gid, CAST(cps_i * 4 + sps_i AS INTEGER) AS param_id, cps, sps, 'additive' AS mode
      FROM groups, {_axis((0.001, 0.01, 0.1, 0.5), 'cps')}, {_axis((0.01, 0.1, 1.0, 10.0), 'sps')}"""
    fits = model_sql.model(
        _cv_groups(names), params, _test_days(horizon), holidays=False, modes=("additive",), cutoffs=cutoffs
    )
    return fits + """,
scores AS (SELECT segment, p.param_id, any_value(cps) AS cps, any_value(sps) AS sps, avg(abs(o.y - yhat) / o.y) AS mape,
             sqrt(avg((o.y - yhat) * (o.y - yhat))) AS rmse
           FROM predicted p JOIN observed o USING (segment, ds) JOIN (SELECT DISTINCT param_id, cps, sps FROM params) q
             ON q.param_id = p.param_id GROUP BY ALL)"""


_SPACE = """space AS (SELECT names.segment, round(CAST(0.01 AS DOUBLE) + i * CAST(0.005 AS DOUBLE), 3) AS cps, CAST(0.5 * (j + 1) AS DOUBLE) AS sps,
            mode, CAST((i * 20 + j) * 2 + k AS INTEGER) AS param_id
          FROM names, range(0, 199) a(i), range(0, 20) b(j), (VALUES (0, 'multiplicative'), (1, 'additive')) m(k, mode))"""


def _density(axis: str, reach: float, size: int) -> str:
    """Good and bad density at every place of an axis: one kernel per trial and the uniform density."""
    kernel = f"exp(-pow((places.{axis} - tpe_parted.{axis}) / ({reach}::DOUBLE * 0.25::DOUBLE / pow(n, 0.2::DOUBLE)), 2) / 2)"
    return f"""
{axis}_weight AS (SELECT segment, places.{axis}, good, any_value(n) AS n, sum({kernel}) AS w FROM tpe_parted
  JOIN (SELECT DISTINCT segment, {axis} FROM space) places USING (segment) GROUP BY segment, places.{axis}, good),
{axis}_part AS (SELECT segment, {axis}, good, (n * w / sum(w) OVER (PARTITION BY segment, good) + 1::DOUBLE / {size}) / (n + 1) AS density
  FROM {axis}_weight)"""


def _proposals(batch: int, round_: int) -> str:
    """The sampler given ``trials``: candidates tpe_raced by the good density, the best ratios win."""
    return f""",
searched AS (SELECT DISTINCT segment FROM trials),
{_SPACE.replace("names", "searched")},
tpe_placed AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY score, param_id)
    <= least(ceil(count(*) OVER (PARTITION BY segment) * 0.1::DOUBLE), 25) AS good FROM trials),
tpe_parted AS (SELECT *, count(*) OVER (PARTITION BY segment, good) AS n FROM tpe_placed),
{_density('cps', 0.99, 199)},
{_density('sps', 9.5, 20)},
mode_part AS (SELECT segment, m.mode, good, (count(*) FILTER (own = m.mode) + 0.5::DOUBLE) / (count(*) + 1) AS density
  FROM (SELECT segment, good, mode AS own FROM tpe_parted), (VALUES ('multiplicative'), ('additive')) m(mode) GROUP BY segment, m.mode, good),
tpe_weighed AS (SELECT segment, param_id, cps, sps, mode, good, c.density * s.density * m.density AS density FROM space
  JOIN cps_part c USING (segment, cps) JOIN sps_part s USING (segment, sps, good) JOIN mode_part m USING (segment, mode, good)
  ANTI JOIN trials USING (segment, cps, sps, mode)),
tpe_both_parts AS (SELECT segment, param_id, cps, sps, mode, max(density) FILTER (good) AS l, max(density) FILTER (NOT good) AS g
  FROM tpe_weighed GROUP BY ALL),
tpe_raced AS (SELECT *, round(l / g, 9) AS ratio FROM tpe_both_parts QUALIFY row_number() OVER (PARTITION BY segment ORDER BY
    -ln((CAST('0x' || substr(md5('0:' || segment || ':{round_}:' || param_id), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / l,
    param_id) <= {batch * sampler.CANDIDATES}),
proposed AS (SELECT segment, param_id, cps, sps, mode FROM tpe_raced
  QUALIFY row_number() OVER (PARTITION BY segment ORDER BY ratio DESC, param_id) <= {batch})"""


def _generated(initial: int) -> str:
    return _cutoffs(initial).removeprefix(OBSERVED)


def _scores(metric: str) -> str:
    return f"SELECT segment, param_id, cps, sps, {_d(metric)} AS {metric} FROM scores"


_WHOLE = model_sql.whole()


def _uniform(place: int) -> str:
    return f"((CAST('0x' || substr(digest, {8 * place + 1}, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE))"


_SIMULATED = f""",
prospects AS (SELECT segment, cutoff, sigma, least(number / days, CAST(1 AS DOUBLE)) AS rate,
    CASE WHEN number > 0 THEN list_sum(list_transform(trend_beta[3:len(trend_beta)], lambda v: abs(v))) / number / days ELSE 0.0 END AS change
  FROM (SELECT segment, cutoff, sigma, trend_beta, CAST(days AS DOUBLE) AS days, CAST(len(trend_beta) - 2 AS DOUBLE) AS number
        FROM fits JOIN span USING (gid))),
digests AS (SELECT segment, rate, change, sigma, path, step, md5(concat_ws(':', '0', segment, CAST(cutoff AS VARCHAR), path, step)) AS digest
  FROM prospects, range(1, {bands.PATHS + 1}) p(path), range(1, {features.FUTURE_DAYS + 1}) s(step)),
uniforms AS (SELECT * EXCLUDE (digest), {_uniform(0)} AS u, {_uniform(1)} - CAST(0.5 AS DOUBLE) AS v, {_uniform(2)} AS w, {_uniform(3)} AS x FROM digests),
draws AS (SELECT segment, path, step, CASE WHEN u < rate THEN -change * sign(v) * ln(1 - 2 * abs(v)) ELSE 0.0 END AS bend,
    sigma * sqrt(-2 * ln(w)) * cos(2 * pi() * x) AS noise FROM uniforms),
paths AS (SELECT segment, path, step, noise, coalesce(sum(bend) OVER before * step - sum(bend * step) OVER before, 0) AS drift
  FROM draws WINDOW before AS (PARTITION BY segment, path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
simulated AS (SELECT segment, ds, step, any_value(yhat) AS yhat, quantile_cont(yhat + noise + drift *
    CASE WHEN mode = 'multiplicative' THEN 1 + weekly + yearly + holidays ELSE 1 END, [{bands.LOWER}, {bands.UPPER}]) AS ends
  FROM (SELECT *, ds - cutoff AS step FROM predicted WHERE ds > cutoff) JOIN paths USING (segment, step) GROUP BY segment, ds, step)"""

ORACLE.update(
    {
        "forecast_fit": sql.query(
            _WHOLE,
            f"""SELECT segment, mode, part, CAST(position AS INTEGER) AS position, {_d('sigma')} AS sigma, {_d('beta')} AS beta FROM (
                SELECT segment, mode, 'trend' AS part, sigma, unnest(range(len(trend_beta))) AS position, unnest(trend_beta) AS beta FROM fits
                UNION ALL
                SELECT segment, mode, 'season', sigma, unnest(range(len(season_beta))), unnest(season_beta) FROM fits)""",
            recursive=True,
        ),
        "forecast_180": sql.query(
            _WHOLE, f"SELECT segment, ds, ds > cutoff AS future, {_d('yhat')} AS yhat FROM predicted", recursive=True
        ),
        "forecast_components": sql.query(
            _WHOLE,
            f"""SELECT segment, ds, mode, {_d('trend')} AS trend, {_d('weekly')} AS weekly, {_d('yearly')} AS yearly,
                  {_d('holidays')} AS holidays FROM predicted""",
            recursive=True,
        ),
        "forecast_bands": sql.query(
            _WHOLE,
            f"""SELECT segment, ds, {_d('yhat')} AS yhat, {_d(f'yhat - {model_sql.BAND} * sigma')} AS yhat_lower,
                  {_d(f'yhat + {model_sql.BAND} * sigma')} AS yhat_upper FROM predicted""",
            recursive=True,
        ),
        "simulated_bands": sql.query(
            _WHOLE + _SIMULATED,
            f"""SELECT segment, ds, CAST(step AS INTEGER) AS step, {_d('yhat')} AS yhat, {_d('ends[1]')} AS yhat_lower,
                  {_d('ends[2]')} AS yhat_upper FROM simulated""",
            recursive=True,
        ),
        "changepoint_deltas": sql.query(
            _WHOLE,
            f"""SELECT segment, ds, {_d('delta')} AS delta, abs(delta) >= 0.01 AS significant FROM (
                  SELECT segment, unnest(points) AS ds, unnest(a[3:len(a)]) AS delta FROM fits JOIN points USING (gid))""",
            recursive=True,
        ),
        "cv_forecast": sql.query(
            _cv(_generated(180)), f"SELECT segment, cutoff, ds, y, {_d('yhat')} AS yhat FROM cv", recursive=True
        ),
        "cv_forecast_fixed": sql.query(
            _cv(_FIXED), f"SELECT segment, cutoff, ds, y, {_d('yhat')} AS yhat FROM cv", recursive=True
        ),
        "requests_cv_forecast": sql.query(
            _cv(_FIXED).replace(sql.DAILY, sql.REQUEST_DAILY), f"SELECT segment, cutoff, ds, y, {_d('yhat')} AS yhat FROM cv", recursive=True
        ),
        "search_trials": sql.query(
            _NAMES
            + ",\n" + _SPACE,
            f"""SELECT segment, param_id, cps, sps, mode FROM space JOIN {_TRIALS} USING (segment)
                QUALIFY row_number() OVER (PARTITION BY segment ORDER BY md5('0:' || segment || ':' || param_id), param_id) <= trials""",
        ),
        "search_proposals": sql.query(
            _grid(GRID_SEGMENTS, _generated(366), 90)
            + f""",
trials AS (SELECT segment, param_id, cps, sps, 'additive' AS mode, round(mape, {DIGITS}) AS score FROM scores)"""
            + _proposals(PROPOSED, 1),
            "SELECT * FROM proposed",
            recursive=True,
        ),
        "tuned_objective": sql.query(
            _cv(_LADDER, _cv_groups(TUNED_SEGMENTS).replace(COUNTRY_OF, _TUNER_COUNTRY))
            + f", modes AS (SELECT segment, mode AS tuned FROM {model_sql.TUNED})",
            f"""SELECT segment, any_value(tuned) AS mode, {_d('avg(ape)')} AS mape, {_d('sqrt(avg(se))')} AS rmse
                FROM errors JOIN modes USING (segment) GROUP BY segment""",
            recursive=True,
        ),
        "cv_model_metrics": sql.query(_cv(_generated(180)), _OVERALL.replace(", 6)", f", {DIGITS})").replace(f"avg(inside), {DIGITS})", "avg(inside), 6)"), recursive=True),
        "model_metrics_by_horizon": sql.query(
            _cv(_generated(180)) + _BY_HORIZON.replace("per_day", "horizon_day").replace("placed", "ordered_rows"),
            f"""SELECT segment, horizon, {_d('mse')} AS mse, {_d('sqrt(mse)')} AS rmse, {_d('mae')} AS mae, {_d('mape')} AS mape,
                  {_d('mdape')} AS mdape, {_d('smape')} AS smape, {sql.rnd('coverage')} AS coverage
                FROM means JOIN medians USING (segment, horizon)""",
            recursive=True,
        ),
        "model_ape_points": sql.query(
            _cv(_generated(180)), f"SELECT segment, cutoff, ds, horizon, {_d('ape')} AS ape FROM errors", recursive=True
        ),
        "grid_search": sql.query(_grid(GRID_SEGMENTS, _generated(366), 90), _scores("mape"), recursive=True),
        "grid_search_rmse": sql.query(_grid(SHORT_SEGMENTS, _FIXED, 30), _scores("rmse"), recursive=True),
        "best_params": sql.query(
            _grid(GRID_SEGMENTS, _generated(366), 90),
            f"""SELECT segment, param_id, cps, sps, {_d('score')} AS mape FROM (SELECT * RENAME (mape AS score) FROM scores)
                QUALIFY row_number() OVER (PARTITION BY segment ORDER BY score, param_id) = 1""",
            recursive=True,
        ),
    }
)
