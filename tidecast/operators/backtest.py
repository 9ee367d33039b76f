"""Rolling-origin back-tests: cutoffs, windows, error measures, tuning."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.numbers import ratio
from tidecast.operators import forecast
from tidecast.operators.features import N_WEEKLY, N_YEARLY
from tidecast.sources.files import literal_table
from tidecast.sources.registry import (
    GRID_CPS,
    GRID_SPS,
    SEARCH_CPS,
    SEARCH_MODES,
    SEARCH_SPS,
    SEGMENTS,
    Segment,
    setting_of,
)

# Back-test spans in days, tuning ladder, share of rows in a metric's window.
PERIOD = 90
HORIZON = 90
SHORT_HORIZON = 30
INITIAL = 180
GRID_INITIAL = 366
LADDER_STEPS = 6
LADDER_STEP = 30
METRIC_SHARE = 0.1


def generated_cutoffs(days: DataFrame, initial: int, period: int = PERIOD, horizon: int = HORIZON) -> DataFrame:
    """Cutoffs stepping back from the last possible one while ``initial`` days of history remain.

    A cutoff whose test window would be empty moves back to one horizon before the last earlier
    date. A group holds the distinct dates of one segment.
    """

    def ladder(dates: pd.DataFrame) -> pd.DataFrame:
        ds = pd.to_datetime(dates["ds"]).sort_values().reset_index(drop=True)
        step, ahead = pd.Timedelta(days=period), pd.Timedelta(days=horizon)
        earliest = ds.iloc[0] + pd.Timedelta(days=initial)
        cutoff, kept = ds.iloc[-1] - ahead, []
        while cutoff >= earliest:
            kept.append(cutoff)
            cutoff = cutoff - step
            before = ds.searchsorted(cutoff, side="right")
            if ds.searchsorted(cutoff + ahead, side="right") == before and cutoff > ds.iloc[0]:
                cutoff = ds.iloc[before - 1] - ahead
        return pd.DataFrame({"segment": dates["segment"].iloc[0], "cutoff": [c.date() for c in kept]})

    return days.select("segment", "ds").distinct().groupBy("segment").applyInPandas(
        ladder, "segment string, cutoff date"
    )


def fixed_cutoffs(days: DataFrame, dates) -> DataFrame:
    """The given dates for every segment that has history before them."""
    listed = F.explode(F.array(*[F.lit(d) for d in dates]))
    first = days.groupBy("segment").agg(F.min("ds").alias("first_ds"))
    return first.withColumn("cutoff", listed).filter(F.col("first_ds") <= F.col("cutoff")).select("segment", "cutoff")


def ladder_cutoffs(days: DataFrame) -> DataFrame:
    """Six tuning cutoffs: one horizon before the last day, then five steps of thirty days."""
    last = days.groupBy("segment").agg(F.max("ds").alias("last_ds"))
    step = F.explode(F.sequence(F.lit(0), F.lit(LADDER_STEPS - 1)))
    stepped = last.withColumn("step", step)
    back = F.lit(HORIZON) + F.col("step") * F.lit(LADDER_STEP)
    return stepped.select("segment", F.date_sub("last_ds", back).alias("cutoff"), (F.col("step") + 1).alias("step"))


def windows(days: DataFrame, cutoffs: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Training and test rows per cutoff. The cutoffs of a segment are few, so is the repetition."""
    paired = days.join(cutoffs.select("segment", "cutoff"), "segment")
    reach = F.date_add("cutoff", horizon)
    return paired.filter(F.col("ds") <= reach).withColumn("is_train", F.col("ds") <= F.col("cutoff"))


def window_summary(rows: DataFrame, horizon: int = HORIZON, full_history: DataFrame | None = None) -> DataFrame:
    """Size and reach of every training and test window.

    ``complete``: the window has test rows and the history reaches its end, so that its score is one of
    the whole horizon. ``full_history`` are the days the windows are cut from.
    """
    train, size = F.col("is_train"), F.size("ys")
    total = F.aggregate("ys", F.lit(0.0), lambda s, y: s + y)
    summary = rows.groupBy("segment", "cutoff").agg(
        F.sum(F.when(train, size).otherwise(0)).alias("n_train"),
        F.sum(F.when(train, 0).otherwise(size)).alias("n_test"),
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.sum(F.when(train, total).otherwise(F.lit(0.0))).alias("sum_train"),
        F.sum(F.when(train, F.lit(0.0)).otherwise(total)).alias("sum_test"),
    )
    if full_history is None:
        return summary
    reach = full_history.groupBy("segment").agg(F.max("ds").alias("history_to"))
    complete = (F.col("n_test") > 0) & (F.col("history_to") >= F.date_add("cutoff", horizon))
    return summary.join(reach, "segment").withColumn("complete", complete).drop("history_to")


def trend_line_cv(rows: DataFrame) -> DataFrame:
    """Test rows forecast by the straight line through each training window, with its spread.

    A predictor whose coefficients are plain aggregates: the reference point of the model's skill.
    """
    day = F.unix_date("ds").cast("double")
    flat = rows.select("segment", "cutoff", "ds", "is_train", day.alias("x"), F.explode("ys").alias("y"))
    train = flat.filter("is_train").groupBy("segment", "cutoff").agg(
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.count("y").alias("n"),
        F.regr_syy("y", "x").alias("syy"),
        F.regr_sxy("y", "x").alias("sxy"),
    )
    variance = (F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n")
    spread = F.sqrt(F.greatest(variance, F.lit(forecast.SMALLEST_VARIANCE)))
    half = spread * F.lit(forecast.BAND_QUANTILE)
    yhat = F.col("intercept") + F.col("slope") * F.col("x")
    return (
        flat.filter(~F.col("is_train"))
        .join(train, ["segment", "cutoff"])
        .select("segment", "cutoff", "ds", "y", yhat.alias("yhat"), half.alias("half"))
        .select("segment", "cutoff", "ds", "y", "yhat", (F.col("yhat") - F.col("half")).alias("yhat_lower"),
                (F.col("yhat") + F.col("half")).alias("yhat_upper"))
    )


def _errors() -> dict[str, Column]:
    y, yhat = F.col("y"), F.col("yhat")
    miss = F.abs(y - yhat)
    inside = (y >= F.col("yhat_lower")) & (y <= F.col("yhat_upper"))
    return {
        "se": miss * miss,
        "ae": miss,
        "ape": ratio(miss, F.abs(y)),
        "sape": ratio(miss, (F.abs(y) + F.abs(yhat)) / 2),
        "inside": inside.cast("bigint"),
    }


def ape_points(cv: DataFrame) -> DataFrame:
    """Absolute percentage error of every back-test row by days ahead."""
    ahead = F.date_diff("ds", "cutoff").alias("horizon")
    return cv.select("segment", "cutoff", "ds", ahead, _errors()["ape"].alias("ape"))


def overall_metrics(cv: DataFrame, keys=("segment",)) -> DataFrame:
    """One value per error measure over all back-test rows."""
    e = _errors()
    return cv.groupBy(*keys).agg(
        F.avg(e["se"]).alias("mse"),
        F.sqrt(F.avg(e["se"])).alias("rmse"),
        F.avg(e["ae"]).alias("mae"),
        F.avg(e["ape"]).alias("mape"),
        F.median(e["ape"]).alias("mdape"),
        F.avg(e["sape"]).alias("smape"),
        F.avg(e["inside"]).alias("coverage"),
    )


def metrics_by_horizon(cv: DataFrame, share: float = METRIC_SHARE) -> DataFrame:
    """Error measures per days ahead, averaged over the latest tenth of the rows up to there.

    The window holds exactly w rows: whole days ahead, and of the earliest one as large a share of
    its mean as is missing. With running sums that is one lookup: the sum at the row count w
    earlier, interpolated inside the day it falls into. Days with fewer than w rows behind them
    have no value. A mean divides by the known errors of its measure: a percentage error of a zero
    actual is unknown and takes no part. Counts are whole numbers throughout: the coverage is one division of
    them, so no order of summation moves it.
    """
    errors = _errors()
    names = list(errors)
    rows = cv.select(
        "segment", "cutoff", "ds", F.date_diff("ds", "cutoff").alias("horizon"), *[c.alias(n) for n, c in errors.items()]
    )
    by_day = rows.groupBy("segment", "horizon").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        *[F.count(n).alias(f"known_{n}") for n in names],
    )
    names = [*names, *[f"known_{n}" for n in names]]
    upto = Window.partitionBy("segment").orderBy("horizon").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("segment")
    size = F.greatest(F.floor(F.sum("n").over(whole) * F.lit(share)), F.lit(1))
    sums = by_day.select(
        "segment", "horizon", "n", *names, size.alias("w"),
        F.sum("n").over(upto).alias("cum_n"), *[F.sum(n).over(upto).alias(f"cum_{n}") for n in names],
    )
    # Each day enters twice on one axis of row counts: as a known sum and as a question about the sum
    # w rows earlier. The next known sum after a question answers it; no pairs of days are formed.
    known = F.struct(F.lit(0).alias("kind"), F.col("cum_n").alias("at"))
    asked = F.struct(F.lit(1).alias("kind"), (F.col("cum_n") - F.col("w")).alias("at"))
    marks = sums.withColumn("mark", F.explode(F.array(known, asked))).filter(F.col("mark.at") >= 0)
    after = Window.partitionBy("segment").orderBy("mark.at", "mark.kind").rowsBetween(1, Window.unboundedFollowing)
    day = F.struct("n", "cum_n", *names, *[f"cum_{n}" for n in names])
    answer = F.first(F.when(F.col("mark.kind") == 0, day), ignorenulls=True).over(after)
    met = marks.withColumn("day", answer).filter(F.col("mark.kind") == 1)

    # Rows of the earliest day that the window takes, times the day's rows: whole numbers.
    rows_of_day, taken = F.col("day.n"), F.col("day.cum_n") - F.col("mark.at")

    def inside(n: str) -> Column:
        """The window's sum of n, times the rows of its earliest day."""
        return (F.col(f"cum_{n}") - F.col(f"day.cum_{n}")) * rows_of_day + F.col(f"day.{n}") * taken

    def mean(n: str) -> Column:
        return ratio(inside(n), inside(f"known_{n}"))

    return met.select(
        "segment",
        "horizon",
        mean("se").alias("mse"),
        F.sqrt(F.greatest(mean("se"), F.lit(0.0))).alias("rmse"),
        mean("ae").alias("mae"),
        mean("ape").alias("mape"),
        mean("sape").alias("smape"),
        mean("inside").alias("coverage"),
    ).join(_median_by_horizon(rows, share), ["segment", "horizon"])


def _median_by_horizon(rows: DataFrame, share: float) -> DataFrame:
    """Median percentage error over a day's rows and as many before them as make up the window.

    A day ahead is one row that holds its errors in order; a segment's days slide over one sorted list, which every error
    enters once and leaves once. A group holds the back-test rows of one segment: cutoffs x days ahead x observations
    a day, whatever the ticket volume.
    """
    entries = F.sort_array(F.collect_list(F.struct("cutoff", "ds", "ape")))
    runs = rows.groupBy("segment", "horizon").agg(F.transform(entries, lambda e: e["ape"]).alias("run"))

    def slide(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("horizon")
        entered = np.concatenate([np.asarray(run, float) for run in days["run"]])
        size = max(math.floor(entered.size * share), 1)
        held, first, end, found = [], 0, 0, []
        for horizon, run in zip(days["horizon"], days["run"]):
            begin, start = end, max(first, 0)
            end += len(run)
            for value in entered[begin:end]:
                if not math.isnan(value):
                    bisect.insort(held, value)
            first = min(begin, end - size)
            for value in entered[start : max(first, 0)]:
                if not math.isnan(value):
                    del held[bisect.bisect_left(held, value)]
            if first >= 0:
                n = len(held)
                found.append((horizon, 0.5 * held[(n - 1) // 2] + 0.5 * held[n // 2] if n else None))
        return pd.DataFrame({"segment": days["segment"].iloc[0], "horizon": [h for h, _ in found],
                             "mdape": pd.Series([m for _, m in found], dtype=float)})

    return runs.groupBy("segment").applyInPandas(slide, "segment string, horizon int, mdape double").select(
        "segment", "horizon", F.when(~F.isnan("mdape"), F.col("mdape")).alias("mdape")
    )


SETTINGS = T.StructType(
    [
        T.StructField("segment", T.StringType()),
        T.StructField("param_id", T.IntegerType()),
        T.StructField("cps", T.DoubleType()),
        T.StructField("sps", T.DoubleType()),
        T.StructField("mode", T.StringType()),
    ]
)


def tuned_settings(spark: SparkSession, segments: tuple[Segment, ...] = SEGMENTS) -> DataFrame:
    """The hand-picked setting of every segment."""
    return literal_table(spark, [(s.name, 0, s.cps, s.sps, s.mode) for s in segments], SETTINGS)


def grid_settings(segments: DataFrame) -> DataFrame:
    """All pairs of the tuning grid for every segment, numbered in the order of the lists."""
    cps = F.posexplode(F.array(*[F.lit(v) for v in GRID_CPS])).alias("i", "cps")
    sps = F.posexplode(F.array(*[F.lit(v) for v in GRID_SPS])).alias("j", "sps")
    pairs = segments.select("*", cps).select("*", sps)
    number = F.col("i") * F.lit(len(GRID_SPS)) + F.col("j")
    return pairs.withColumn("param_id", number).withColumn("mode", F.lit("additive")).drop("i", "j")


def _steps(low: float, high: float, step: float) -> int:
    return round((high - low) / step)


def search_settings(segments: DataFrame) -> DataFrame:
    """Every point of the search space for every segment, numbered."""

    def axis(low: float, high: float, step: float, index: str, name: str, rows: DataFrame) -> DataFrame:
        placed = rows.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(_steps(low, high, step)))))
        return placed.withColumn(name, F.round(F.lit(low) + F.col(index) * F.lit(step), 3))

    rows = axis(*SEARCH_SPS, "j", "sps", axis(*SEARCH_CPS, "i", "cps", segments))
    modes = F.posexplode(F.array(*[F.lit(m) for m in SEARCH_MODES])).alias("k", "mode")
    rows = rows.select("*", modes)
    n_sps, n_modes = _steps(*SEARCH_SPS) + 1, len(SEARCH_MODES)
    number = (F.col("i") * F.lit(n_sps) + F.col("j")) * F.lit(n_modes) + F.col("k")
    return rows.withColumn("param_id", number).drop("i", "j", "k")


def sampled_settings(segments: DataFrame, seed: int = 0, trials: Column | None = None) -> DataFrame:
    """The segment's number of trials (by default the registry's), drawn without replacement from the search space.

    The draw orders the space by the MD5 of seed, segment and number, so it is the same on every run
    and in every engine.
    """
    lot = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("segment"), F.col("param_id").cast("string")))
    draw = Window.partitionBy("segment").orderBy(lot, "param_id")
    space = search_settings(segments.select("segment"))
    drawn = space.withColumn("draw", F.row_number().over(draw))
    return drawn.filter(F.col("draw") <= (setting_of("trials") if trials is None else trials)).drop("draw")


def without_holidays(days: DataFrame) -> DataFrame:
    return days.withColumn("season", F.slice("season", 1, N_WEEKLY + N_YEARLY))


def horizon_rows(days: DataFrame, inputs: DataFrame, horizon: int) -> DataFrame:
    """The days of the horizon after every cutoff with all regressors. ``days`` carries its ``season`` already."""
    rows = windows(days, inputs, horizon).filter(~F.col("is_train"))
    return forecast.with_trend(rows, inputs)


def tuning_scores(days: DataFrame, inputs: DataFrame, settings: DataFrame, horizon: int, batches: int) -> DataFrame:
    """MAPE and RMSE of every setting over all cutoffs."""
    sums = forecast.score(days, inputs, settings, horizon, batches).groupBy("segment", "param_id").agg(
        F.sum("sum_ape").alias("sum_ape"), F.sum("n_ape").alias("n_ape"), F.sum("sum_se").alias("sum_se"), F.sum("n").alias("n")
    )
    return sums.join(settings, ["segment", "param_id"]).select(
        "segment", "param_id", "cps", "sps", "mode",
        ratio(F.col("sum_ape"), F.col("n_ape")).alias("mape"), F.sqrt(F.col("sum_se") / F.col("n")).alias("rmse"),
    )


def best_setting(scores: DataFrame, metric: str) -> DataFrame:
    """Setting with the smallest score per segment.

    Only equal scores are ties, which the first setting wins.
    """
    best = F.min(F.struct(metric, "param_id", "cps", "sps", "mode")).alias("best")
    return scores.dropna(subset=[metric]).groupBy("segment").agg(best).select("segment", "best.*")
