"""Decomposable forecast: piecewise-linear trend, weekly and yearly seasonality, holidays.

The model of Taylor and Letham, "Forecasting at Scale" (2018), solved by penalised least squares: a lasso over the trend
changes, whose exact solution is found on its path.
Spark builds the seasonal regressors, groups the daily rows by segment and evaluates the result. A segment's days meet
all its cutoffs in one group: the normal equations of every cutoff come from running sums by date, those of a trend
change from differences of two of them. A group holds one row per date, so the calendar bounds it whatever the ticket volume.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.numbers import dot
from tidecast.operators import lasso
from tidecast.operators.features import N_WEEKLY, N_YEARLY, changepoint_dates, training_spans

# Fixed values of the model: turns of trend and season in multiplicative mode, prior scale of holidays, 80 % normal
# quantile, size from which a trend change is reported as significant, smallest variance the penalties use.
ALTERNATIONS = 2
HOLIDAY_SCALE = 10.0
BAND_QUANTILE = 1.2815515655446004
SIGNIFICANT = 0.01
SMALLEST_VARIANCE = 1e-8

WINDOW = ["segment", "cutoff"]


def trend_inputs(days: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Per segment and cutoff: training span and changepoints as shares of it, in date order."""
    spans = training_spans(days, cutoffs).filter(F.col("n_rows") >= 2)
    dated = changepoint_dates(days, spans).groupBy(*WINDOW).agg(F.array_sort(F.collect_list("ds")).alias("points"))
    return spans.join(dated, WINDOW, "left").select(
        *WINDOW, "first_ds", "last_ds", F.coalesce("points", F.array().cast("array<date>")).alias("points")
    )


def fit_status(days: DataFrame, windows: DataFrame) -> DataFrame:
    """Why a segment has no fit: ``segment, cutoff, n_rows, status`` for every row of ``windows`` (segment, cutoff).

    A fit needs two observations up to the cutoff. Segments without any are in ``windows`` only.
    """
    spans = training_spans(days, windows.dropna())
    known = spans.select(*[F.col(k).alias(f"its_{k}") for k in WINDOW], F.col("n_rows").alias("found"))
    n = F.coalesce("found", F.lit(0)).cast("bigint")
    status = F.when(n == 0, "no history").when(n < 2, "a single observation").otherwise("fitted")
    same = [F.col(k) == F.col(f"its_{k}") for k in WINDOW]
    return windows.join(known, same, "left").select(*WINDOW, n.alias("n_rows"), status.alias("status"))


def elapsed(ds: Column) -> Column:
    """Position in the training span, 0 at its first day and 1 at its last."""
    length = F.greatest(F.date_diff("last_ds", "first_ds"), F.lit(1))
    return F.date_diff(ds, "first_ds") / length


def with_trend(rows: DataFrame, inputs: DataFrame) -> DataFrame:
    """Adds ``trend``: constant, elapsed share, one hinge per changepoint."""
    t = elapsed(F.col("ds"))
    hinges = F.transform("points", lambda p: F.greatest(t - elapsed(p), F.lit(0.0)))
    return rows.join(inputs, WINDOW).withColumn("trend", F.concat(F.array(F.lit(1.0), t), hinges))


def _solve(lhs: np.ndarray, rhs: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Ridge solutions for a stack of settings."""
    size = rhs.shape[-1]
    diagonal = np.arange(size)
    a = np.broadcast_to(lhs, (len(penalty), size, size)).copy()
    a[:, diagonal, diagonal] += penalty + 1e-10 * a[:, diagonal, diagonal].mean(axis=1, keepdims=True)
    return np.linalg.solve(a, np.broadcast_to(rhs, (len(penalty), size))[..., None])[..., 0]


def _weighted_products(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """X' diag(w) X for every row ``w`` of ``weights``."""
    i, j = np.triu_indices(x.shape[1])
    triangle = weights @ (x[:, i] * x[:, j])
    out = np.empty((len(weights), x.shape[1], x.shape[1]))
    out[:, i, j] = triangle
    out[:, j, i] = triangle
    return out


def _noise_variance(products: np.ndarray, moments: np.ndarray, squares: float, rows: float) -> float:
    """Residual variance of the straight line, the one rule for histories of any length.

    A history without noise gets a small variance, or else the penalties would vanish and the fit be
    undefined.
    """
    lhs, rhs = products[:2, :2], moments[:2]
    free = _solve(lhs, rhs, np.zeros((1, 2)))[0]
    left = squares - 2 * free @ rhs + free @ lhs @ free
    return max(left / max(rows - 2, 1.0), SMALLEST_VARIANCE)


def fit_settings(trend, season, n, mean, squares, multiplicative, cps, sps, sums=None):
    """Trend and season coefficients for every pair (cps, sps) under one mode.

    One row per date: ``n`` observations with the given ``mean``, in units of the largest one;
    ``squares`` is the sum of all squared observations, ``sums`` the normal equations if they are known.
    Returns two arrays with a row per setting.
    """
    q, p = trend.shape[1], season.shape[1]
    deltas = slice(2, q)
    if sums is None:
        both = np.hstack([trend, season])
        sums = both.T @ (n[:, None] * both), both.T @ (n * mean)
    products, moments = sums
    variance = _noise_variance(products, moments, squares, n.sum())

    def season_penalty(scales: np.ndarray) -> np.ndarray:
        penalty = np.empty((len(scales), p))
        penalty[:] = variance / scales[:, None] ** 2
        penalty[:, N_WEEKLY + N_YEARLY :] = variance / HOLIDAY_SCALE**2
        return penalty

    if not multiplicative:
        # One path for every season scale answers all its trend scales.
        scales, owner = np.unique(sps, return_inverse=True)
        penalty = np.hstack([np.zeros((len(scales), q)), season_penalty(scales)])
        paths = len(scales)
        lhs, rhs = np.broadcast_to(products, (paths, *products.shape)), np.broadcast_to(moments, (paths, q + p))
        found = lasso.with_ridge(lhs, rhs, penalty, deltas, owner, variance / cps)
        return found[:, :q], found[:, q:]
    own = np.arange(len(cps))
    factor = np.ones((len(cps), len(n)))
    for _ in range(ALTERNATIONS):
        lhs, rhs = _weighted_products(n * factor**2, trend), (n * mean * factor) @ trend
        a = lasso.with_ridge(lhs, rhs, np.zeros((len(cps), q)), deltas, own, variance / cps)
        level = a @ trend.T
        lhs, rhs = _weighted_products(n * level**2, season), (n * level * (mean - level)) @ season
        b = _solve(lhs, rhs, season_penalty(sps))
        factor = 1.0 + b @ season.T
    return a, b


def values_at(trend, season, a, b, multiplicative):
    level, swing = a @ trend.T, b @ season.T
    return level * (1.0 + swing) if multiplicative else level + swing


def _from_zero(values: np.ndarray) -> np.ndarray:
    """Running sums by row, from the empty one on."""
    return np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])


class History:
    """A segment's days in order, with running sums by date of all that normal equations are made of."""

    def __init__(self, days: pd.DataFrame):
        days = days.sort_values("ds")
        self.day = days["ds"].to_numpy("datetime64[D]")
        self.elapsed = (self.day - self.day[0]).astype(float)
        self.season = np.stack(days["season"].to_numpy())
        self.ys = days["ys"].to_numpy()
        self.n = days["ys"].map(len).to_numpy(float)
        self.total = days["ys"].map(np.sum).to_numpy(float)
        self.squares = _from_zero(days["ys"].map(lambda ys: np.square(ys).sum()).to_numpy(float))
        self.largest = np.maximum.accumulate(days["ys"].map(lambda ys: np.abs(ys).max()).to_numpy(float))
        base = np.column_stack([np.ones(len(days)), self.elapsed, self.season])
        self.sums = _from_zero(self.n[:, None] * base)
        self.times = _from_zero((self.n * self.elapsed)[:, None] * base)
        self.values = _from_zero(self.total[:, None] * base)
        self.products = {0: np.zeros((self.season.shape[1],) * 2)}

    def rows_upto(self, date) -> int:
        return int(np.searchsorted(self.day, np.datetime64(date, "D"), side="right"))

    def season_products(self, end: int) -> np.ndarray:
        """Sums of products of the season up to a row, from those of the last row asked for before it."""
        if end not in self.products:
            known = max(k for k in self.products if k < end)
            part = self.season[known:end]
            self.products[end] = self.products[known] + part.T @ (self.n[known:end, None] * part)
        return self.products[end]

    def trend(self, first: int, end: int, length: float, points: np.ndarray) -> np.ndarray:
        """Constant, elapsed share, one hinge per point, for some of the rows."""
        u = self.elapsed[first:end, None]
        return np.hstack([np.ones_like(u), u / length, np.maximum(u - points, 0.0) / length])

    def normal_equations(self, end: int, length: float, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of trend and season over the first ``end`` rows, and their moments with the observations."""
        k, q = points.size, 2 + points.size
        after = np.searchsorted(self.elapsed, points, side="right")
        sums, times, values = (x[end] - x[after] for x in (self.sums, self.times, self.values))
        hinge = (times - points[:, None] * sums) / length
        late = np.maximum.outer(np.arange(k), np.arange(k))
        both = points[:, None] + points
        cross = (times[late, 1] - both * sums[late, 1] + np.outer(points, points) * sums[late, 0]) / length**2
        size = q + self.season.shape[1]
        a, m = np.empty((size, size)), np.empty(size)
        a[0, :2], a[0, q:] = self.sums[end, :2], self.sums[end, 2:]
        a[1, 1], a[1, q:] = self.times[end, 1] / length, self.times[end, 2:]
        a[2:q, 0], a[2:q, 1], a[2:q, q:], a[2:q, 2:q] = hinge[:, 0], hinge[:, 1], hinge[:, 2:], cross
        a[0, 2:q], a[1, 2:q], a[q:, 2:q], a[1, 0] = hinge[:, 0], hinge[:, 1], hinge[:, 2:].T, a[0, 1]
        a[q:, 0], a[q:, 1], a[q:, q:] = a[0, q:], a[1, q:], self.season_products(end)
        a[1] /= length
        a[2:, 1], a[0, 1] = a[2:, 1] / length, a[0, 1] / length
        m[:2], m[2:q], m[q:] = self.values[end, :2], (values[:, 1] - points * values[:, 0]) / length, self.values[end, 2:]
        m[1] /= length
        return a, m


def _windows(key, days: pd.DataFrame, windows: pd.DataFrame):
    """Fits every window of one group of a segment's history; yields cutoff, rows up to it, elapsed days, points, settings
    of a mode, mode, coefficients, scale and spread."""
    if days.empty or windows.empty:
        return
    history = History(days)
    for cutoff, asked in windows.sort_values(["cutoff", "param_id"]).groupby("cutoff"):
        end = history.rows_upto(cutoff)
        length = max(history.elapsed[end - 1], 1.0)
        points = (np.array(list(asked["points"].iloc[0]), "datetime64[D]") - history.day[0]).astype(float)
        scale = max(history.largest[end - 1], 1e-12)
        products, moments = history.normal_equations(end, length, points)
        trend, season, n = history.trend(0, end, length, points), history.season[:end], history.n[:end]
        mean, squares = history.total[:end] / n / scale, history.squares[end] / scale**2
        for mode, chosen in asked.groupby("mode"):
            multiplicative = mode == "multiplicative"
            cps, sps = chosen["cps"].to_numpy(float), chosen["sps"].to_numpy(float)
            a, b = fit_settings(trend, season, n, mean, squares, multiplicative, cps, sps, (products, moments / scale))
            fitted = values_at(trend, season, a, b, multiplicative)
            spread = (squares - 2 * fitted @ (n * mean) + (fitted**2) @ n) / n.sum()
            spread = np.maximum(spread, SMALLEST_VARIANCE)
            yield history, cutoff, end, length, points, chosen, multiplicative, a, b, scale, np.sqrt(spread) * scale


FITS = (
    "segment string, cutoff date, param_id int, mode string, sigma double, "
    "trend_beta array<double>, season_beta array<double>, deltas array<double>"
)
SCORES = "segment string, cutoff date, param_id int, n bigint, sum_ape double, n_ape bigint, sum_se double"


def _fit_group(key, days: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for _, cutoff, _, _, _, chosen, multiplicative, a, b, scale, sigma in _windows(key, days, windows):
        parts.append(
            pd.DataFrame(
                {
                    "segment": key[0],
                    "cutoff": cutoff,
                    "param_id": chosen["param_id"].to_numpy(),
                    "mode": chosen["mode"].to_numpy(),
                    "sigma": sigma,
                    "trend_beta": list(a * scale),
                    "season_beta": list(b if multiplicative else b * scale),
                    "deltas": list(a[:, 2:]),
                }
            )
        )
    return pd.concat(parts) if parts else _empty(FITS)


def _score_group(horizon: int):
    """Error sums of every setting over each window's test rows, ready to be added up over cutoffs."""

    def score_group(key, days: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for history, cutoff, end, length, points, chosen, multiplicative, a, b, scale, _ in _windows(key, days, windows):
            last = history.rows_upto(cutoff + pd.Timedelta(days=horizon))
            if last == end:
                continue
            trend, season = history.trend(end, last, length, points), history.season[end:last]
            actual = np.concatenate(history.ys[end:last])
            day_of = np.repeat(np.arange(last - end), history.n[end:last].astype(int))
            miss = actual - values_at(trend, season, a, b, multiplicative)[:, day_of] * scale
            known = actual != 0
            parts.append(
                pd.DataFrame(
                    {
                        "segment": key[0],
                        "cutoff": cutoff,
                        "param_id": chosen["param_id"].to_numpy(),
                        "n": len(actual),
                        "sum_ape": np.abs(miss[:, known] / actual[known]).sum(axis=1),
                        "n_ape": int(known.sum()),
                        "sum_se": np.square(miss).sum(axis=1),
                    }
                )
            )
        return pd.concat(parts) if parts else _empty(SCORES)

    return score_group


def _empty(schema: str) -> pd.DataFrame:
    return pd.DataFrame({field.split()[0]: pd.Series([], dtype=object) for field in schema.split(", ")})


def _by_group(days: DataFrame, inputs: DataFrame, settings: DataFrame, batches: int, work, schema: str) -> DataFrame:
    """Runs ``work`` once per segment and batch, with all days of the segment and the batch's windows and settings.

    The history is shuffled once per batch, without regressors of the trend, whatever the number of cutoffs. A batch holds
    whole pairs of cutoff and season scale, whose settings share a path. The work is heavy and its input small, so the
    number of tasks follows the cores of the cluster and not the bytes: an explicit partition count is not coalesced
    by adaptive execution.
    """
    tasks = days.sparkSession.sparkContext.defaultParallelism * 2
    numbers = F.sequence(F.lit(0), F.lit(batches - 1))
    history = days.select("segment", "ds", "ys", "season", F.explode(numbers).alias("batch"))
    # The second side comes from the first: new key names keep the two apart.
    windows = inputs.select(F.col("segment").alias("its_segment"), "cutoff", "points")
    asked = windows.join(settings, F.col("its_segment") == F.col("segment")).withColumn(
        "its_batch", F.pmod(F.xxhash64("cutoff", "sps"), F.lit(batches)).cast("int")
    )
    left = history.repartition(tasks, "segment", "batch").groupBy("segment", "batch")
    right = asked.select("its_segment", "its_batch", "cutoff", "points", "param_id", "cps", "sps", "mode").repartition(
        tasks, "its_segment", "its_batch").groupBy("its_segment", "its_batch")
    return left.cogroup(right).applyInPandas(work, schema)


def fit(days: DataFrame, inputs: DataFrame, settings: DataFrame, batches: int = 1) -> DataFrame:
    """Coefficients per segment, cutoff and setting.

    ``days``: ``segment, ds, ys, season``; ``inputs``: the windows as ``trend_inputs`` gives them; ``settings``: ``segment,
    param_id, cps, sps, mode``. A window is fitted to all days up to its cutoff.
    """
    return _by_group(days, inputs, settings, batches, _fit_group, FITS)


def score(days: DataFrame, inputs: DataFrame, settings: DataFrame, horizon: int, batches: int = 1) -> DataFrame:
    """Errors over the ``horizon`` days after each cutoff per segment, cutoff and setting; predictions never leave the task."""
    return _by_group(days, inputs, settings, batches, _score_group(horizon), SCORES)


def components(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Trend, weekly, yearly and holiday parts, forecast and band for rows with regressors.

    In multiplicative mode the seasonal parts are shares of the trend.
    """

    def part(start: int, length: Column) -> Column:
        place = F.lit(start)
        return dot(F.slice("season", place, length), F.slice("season_beta", place, length))

    first_holiday = N_WEEKLY + N_YEARLY + 1
    n_holidays = F.size("season") - F.lit(N_WEEKLY + N_YEARLY)
    split = rows.join(fits, WINDOW).select(
        *rows.columns,
        "param_id",
        "mode",
        "sigma",
        dot(F.col("trend_beta"), F.col("trend")).alias("trend_part"),
        part(1, F.lit(N_WEEKLY)).alias("weekly"),
        part(N_WEEKLY + 1, F.lit(N_YEARLY)).alias("yearly"),
        part(first_holiday, n_holidays).alias("holidays"),
    )
    swing = F.col("weekly") + F.col("yearly") + F.col("holidays")
    yhat = F.when(F.col("mode") == "multiplicative", F.col("trend_part") * (F.lit(1.0) + swing)).otherwise(
        F.col("trend_part") + swing
    )
    half = F.col("sigma") * F.lit(BAND_QUANTILE)
    return (
        split.withColumn("yhat", yhat)
        .drop("trend", "season", "first_ds", "last_ds", "points")
        .withColumnRenamed("trend_part", "trend")
        .withColumn("yhat_lower", F.col("yhat") - half)
        .withColumn("yhat_upper", F.col("yhat") + half)
    )


def changepoint_deltas(inputs: DataFrame, fits: DataFrame) -> DataFrame:
    """Trend change at each candidate date, in units of the largest value per training span."""
    pairs = F.inline(F.arrays_zip(F.col("points").alias("ds"), F.col("deltas").alias("delta")))
    changes = inputs.join(fits, WINDOW).select(*WINDOW, "param_id", pairs)
    return changes.withColumn("significant", F.abs("delta") >= F.lit(SIGNIFICANT))


def long_coefficients(fits: DataFrame) -> DataFrame:
    """One row per coefficient, numbered from 0 within trend and season."""

    def listed(part: str) -> Column:
        return F.transform(F.col(f"{part}_beta"), lambda v, i: F.struct(F.lit(part).alias("part"), i.alias("position"), v.alias("beta")))

    return fits.select(*WINDOW, "mode", "sigma", F.inline(F.concat(listed("trend"), listed("season"))))
