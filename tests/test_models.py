"""Models and back-tests against direct numpy solutions and hand-made series."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.functions import holidays
from tidecast.operators import backtest, features, forecast, regression, scoring, spectral
from tidecast.plans import forecasting, modelling
from tidecast.plans import scoring as plans_scoring
from tidecast.session import settle
from tidecast.sources import registry

D = dt.date


def make_days(spark, values, name="s", start=D(2000, 1, 1), skip=()):
    """One row per date; a value may be a list of observations."""
    rows = [
        (name, start + dt.timedelta(days=i), [float(v) for v in (y if isinstance(y, (list, tuple)) else [y])])
        for i, y in enumerate(values)
        if i not in skip
    ]
    return spark.createDataFrame(rows, "segment string, ds date, ys array<double>")


def make_series(spark, y, key="series", name="s", start=D(2000, 1, 1)):
    rows = [(name, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, f"{key} string, ds date, y double")


def wavy(n, seed=0, noise=0.0):
    t = np.arange(n)
    rng = np.random.default_rng(seed)
    return 20 + 0.01 * t + 3 * np.sin(2 * np.pi * t / 7) + noise * rng.normal(size=n)


@pytest.mark.parametrize("n", [60, 61])
def test_periodogram_matches_direct_sum(spark, n):
    y = wavy(n, noise=1.0)
    got = spectral.periodogram(make_series(spark, y, "segment")).orderBy("k").toPandas()
    x = np.arange(n)
    rest = y - np.polyval(np.polyfit(x, y, 1), x)
    for k in range(n // 2 + 1):
        wave = np.exp(-2j * np.pi * k * x / n)
        power = abs((rest * wave).sum()) ** 2 / n**2 * (1 if k == 0 or 2 * k == n else 2)
        assert got.spectrum[k] == pytest.approx(power, abs=1e-12)
    assert np.allclose(got.frequency, 365 * got.k / n)


def design(n, start):
    ds = pd.date_range(start, periods=n)
    pos = np.arange(1, n + 1)
    u = (ds.dayofyear - 1) / np.where(ds.is_leap_year, 366, 365)
    cols = [np.ones(n), pos] + [((pos - 1) % 7 == i - 1).astype(float) for i in range(2, 8)]
    for k in range(1, 11):
        cols += [np.sin(2 * np.pi * k * u), np.cos(2 * np.pi * k * u)]
    return np.column_stack(cols)


def test_ols_matches_lstsq_and_carries_the_position_on(spark):
    n = 800
    y = wavy(n, noise=2.0)
    series = make_series(spark, y)
    fits = regression.fit_ols(series, "series")
    x = design(n + 365, "2000-01-01")
    beta = np.linalg.lstsq(x[:n], y, rcond=None)[0]
    assert np.allclose(fits.first().beta, beta, atol=1e-8)
    ahead = regression.forecast_ols(series, fits, "series").orderBy("ds").toPandas()
    assert list(ahead.position) == list(range(n + 1, n + 366))
    assert np.allclose(ahead.yhat, x[n:] @ beta, atol=1e-7)


def test_ols_with_redundant_columns_still_fits(spark):
    y = wavy(20)
    series = make_series(spark, y)
    rows = regression.design_rows(series, "series")
    fitted = regression.predict_ols(rows, regression.fit_ols(series, "series"), "series").toPandas()
    assert np.allclose(fitted.yhat, fitted.y, atol=1e-4)


def shares_left(x, kept):
    """What is left of every column, as a share of its length, after projection on the kept columns before it."""
    basis, found = np.zeros((len(x), 0)), []
    for column in range(x.shape[1]):
        rest = x[:, column] / (np.linalg.norm(x[:, column]) or 1.0)
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        found.append(np.linalg.norm(rest))
        if kept[column]:
            basis = np.column_stack([basis, rest / found[-1]])
    return np.array(found)


@pytest.mark.parametrize("n, start", [(1, D(2000, 1, 1)), (5, D(2000, 1, 1)), (20, D(2000, 1, 1)), (28, D(2001, 3, 1)), (800, D(2000, 1, 1))])
def test_redundant_terms_are_dropped_and_listed(spark, n, start):
    rng = np.random.default_rng(n)
    series = make_series(spark, rng.normal(size=n), start=start)
    rows = regression.design_rows(series, "series")
    told = regression.kept_terms(regression.gram(rows, "series"), "series").orderBy("position").toPandas()
    assert list(told.term) == features.DESIGN_NAMES and told.kept[0] and told.kept.sum() <= n
    # A column is decided by the share 1e-4. Products hold half of the digits: shares near it may go either way.
    left, kept = shares_left(design(n, start), told.kept), told.kept.to_numpy()
    assert (left[kept] > 1e-5).all() and (left[~kept] < 1e-3).all()
    if n >= 28:
        assert kept[:8].all()
    if n == 800:
        assert kept.all()
    beta = np.array(regression.fit_ols(series, "series").first().beta)
    assert not beta[~told.kept.to_numpy()].any()


def test_a_column_that_the_ones_before_it_make_up_goes(spark):
    constant, days, empty = np.ones((70, 1)), np.eye(7)[np.arange(70) % 7], np.zeros((70, 1))
    x = np.hstack([constant, days, empty])
    assert list(np.flatnonzero(regression.independent(x.T @ x))) == [0, 1, 2, 3, 4, 5, 6]


def test_gram_adds_up_over_tasks(spark):
    series = make_series(spark, wavy(200, noise=1.0)).repartition(7)
    rows = regression.design_rows(series, "series")
    whole = {(r.i, r.j): r.value for r in regression.gram(rows.coalesce(1), "series").collect()}
    split = {(r.i, r.j): r.value for r in regression.gram(rows.repartition(5), "series").collect()}
    assert whole.keys() == split.keys() and all(abs(whole[k] - split[k]) < 1e-6 for k in whole)


def test_easter_and_moving_holidays(spark):
    days = {(r.country, r.holiday, r.ds) for r in holidays.holiday_calendar(spark, 1995, 2030).collect()}
    for day in (D(1995, 4, 17), D(2000, 4, 24), D(2008, 3, 24), D(2011, 4, 25), D(2024, 4, 1), D(2025, 4, 21)):
        assert ("UK", "Easter Monday", day) in days
    assert ("US", "Thanksgiving", D(2023, 11, 23)) in days and ("US", "Memorial Day", D(2024, 5, 27)) in days
    assert ("CA", "Victoria Day", D(2024, 5, 20)) in days and ("CN", "Tomb-Sweeping Day", D(2024, 4, 4)) in days
    assert ("US", "Juneteenth", D(2020, 6, 19)) not in days and ("NL", "King's Day", D(2014, 4, 26)) in days


def test_published_days_of_every_country(spark):
    """Dates as published by the authorities of each country."""
    days = {(r.country, r.ds) for r in holidays.holiday_calendar(spark, 1995, 2026).collect()}
    published = {
        "US": ["2022-06-20", "2022-12-26", "2023-01-02", "2021-12-31", "2023-11-10", "2023-06-19", "2000-11-10", "1995-01-02"],
        "UK": ["2022-06-02", "2022-06-03", "2022-09-19", "2022-12-27", "2023-01-02", "2023-05-08", "2021-12-27", "2021-12-28",
               "2020-05-08", "1995-05-08", "2022-01-03", "1999-12-31", "2002-06-03", "2002-06-04"],
        "CA": ["2022-12-26", "2022-12-27", "2023-01-02", "2023-07-03", "2023-09-30"],
        "NL": ["1995-04-29", "2000-04-29", "2001-04-30", "2023-04-27", "2014-04-26", "2025-04-26"],
        "IE": ["2023-02-06", "2024-02-05", "2030-02-01"][:2] + ["2022-12-27", "2023-01-02", "2024-03-18"],
        "BR": ["2023-04-07", "2023-09-07", "2024-11-20"],
        "CN": ["2023-01-22", "2023-04-05", "2023-06-22", "2023-09-29", "2001-05-03", "2024-02-12"],
    }
    assert not [(c, d) for c, ds in published.items() for d in ds if (c, D.fromisoformat(d)) not in days]
    absent = {"NL": ["1995-04-30", "2000-04-30", "2014-04-27"], "UK": ["2020-05-04", "2022-05-30", "1995-05-01"], "US": ["2022-06-21"]}
    assert not [(c, d) for c, ds in absent.items() for d in ds if (c, D.fromisoformat(d)) in days]
    brigid = {r.ds for r in holidays.holiday_calendar(spark, 2030, 2030).collect() if r.holiday.startswith("Saint Brigid")}
    assert brigid == {D(2030, 2, 1)}


def test_years_beyond_the_lunar_lists_are_an_error(spark):
    assert holidays.holiday_calendar(spark, 2031, 2050).where("holiday = 'Spring Festival'").count() == 60
    for first, last in ((1994, 2000), (2049, 2051)):
        with pytest.raises(ValueError):
            holidays.holiday_calendar(spark, first, last)
    assert holidays.holiday_calendar(spark, 2060, 2061, lunar=False).where("country = 'US'").count() > 20
    days = spark.createDataFrame([("a", D(2023, 12, 25)), ("a", D(2031, 1, 1))], "segment string, ds date")
    assert features.calendar_years(days) == (2023, 2031)
    flagged = features.with_season(days, F.lit("US"), features.calendar_years(days)).orderBy("ds").collect()
    assert sum(flagged[0].season[26:]) == 1 and sum(flagged[1].season[26:]) == 1


def test_horizon_metrics_skip_zero_actuals(spark):
    """With a window of all rows the means by horizon are the overall ones."""
    rows = [("s", D(2000, 1, 1), D(2000, 1, 2 + i), y, 1.5, 1.0, 2.0) for i, y in enumerate([0.0, 2.0, 0.0, 4.0, 2.0])]
    cv = spark.createDataFrame(rows, "segment string, cutoff date, ds date, y double, yhat double, yhat_lower double, yhat_upper double")
    last = backtest.metrics_by_horizon(cv, share=1.0).collect()
    overall = backtest.overall_metrics(cv).first()
    assert len(last) == 1
    for name in ("mse", "rmse", "mae", "mape", "mdape", "smape", "coverage"):
        assert abs(last[0][name] - overall[name]) < 1e-12, name
    one = backtest.metrics_by_horizon(cv, share=0.2).orderBy("horizon").collect()
    assert [r.mape for r in one][0] is None and abs(one[1].mape - 0.25) < 1e-12


def settings(spark, rows):
    return spark.createDataFrame(rows, backtest.SETTINGS)


def whole_rows(days, country="US", years=(1999, 2004)):
    cutoffs = modelling.whole_history(days)
    seasonal = features.with_season(days, F.lit(country), years)
    return forecast.trend_inputs(days, cutoffs), seasonal


def brute_force(train, cps, sps, multiplicative):
    """The same model row by row: no aggregation over equal dates, one dense solve per step."""
    trend = np.repeat(np.stack(train.trend), train.ys.map(len), axis=0)
    season = np.repeat(np.stack(train.season), train.ys.map(len), axis=0)
    y = np.concatenate(train.ys.to_numpy())
    scale = np.abs(y).max()
    y = y / scale
    q, p, n = trend.shape[1], season.shape[1], len(y)

    def ridge(x, target, penalty):
        lhs = x.T @ x
        lhs = lhs + np.diag(penalty + 1e-10 * np.diag(lhs).mean())
        return np.linalg.solve(lhs, x.T @ target)

    def sparse(x, target, penalty):
        """Lasso by coordinate descent, until the active set it finds has an exact solution that is optimal."""
        lhs, rhs = x.T @ x, x.T @ target
        lhs = lhs + np.diag(penalty + 1e-10 * np.diag(lhs).mean())
        inner, outer = np.arange(2, q), np.r_[0:2, q : len(rhs)]
        tied = np.linalg.solve(lhs[np.ix_(outer, outer)], np.c_[lhs[np.ix_(outer, inner)], rhs[outer]])
        s = lhs[np.ix_(inner, inner)] - lhs[np.ix_(inner, outer)] @ tied[:, :-1]
        r, lam, b = rhs[inner] - lhs[np.ix_(inner, outer)] @ tied[:, -1], variance / cps, np.zeros(q - 2)
        for sweep in range(1, 100_000):
            for j in range(q - 2):
                rho = r[j] - s[j] @ b + s[j, j] * b[j]
                b[j] = np.sign(rho) * max(abs(rho) - lam, 0) / s[j, j]
            if sweep % 50 == 0:
                on, exact = np.flatnonzero(b), np.zeros(q - 2)
                exact[on] = np.linalg.solve(s[np.ix_(on, on)], r[on] - lam * np.sign(b[on]))
                if np.all(exact * b >= 0) and np.all(np.abs(r - s @ exact) <= lam * (1 + 1e-9)):
                    break
        out = np.empty(len(rhs))
        out[inner], out[outer] = exact, tied[:, -1] - tied[:, :-1] @ exact
        return out

    both = np.hstack([trend, season])
    free = both[:, :2]
    variance = np.square(y - free @ ridge(free, y, np.zeros(free.shape[1]))).sum() / (n - free.shape[1])
    swing_penalty = np.r_[np.full(26, variance / sps**2), np.full(p - 26, variance / 100)]
    if not multiplicative:
        b = sparse(both, y, np.r_[np.zeros(q), swing_penalty])
        return both @ b * scale
    factor = np.ones(n)
    for _ in range(2):
        a = sparse(trend * factor[:, None], y, np.zeros(q))
        level = trend @ a
        b = ridge(season * level[:, None], y - level, swing_penalty)
        factor = 1 + season @ b
    return level * factor * scale


def test_running_sums_give_the_normal_equations():
    """Every cutoff's products and moments against those of its rows, days missing and several observations a day."""
    rng = np.random.default_rng(5)
    day = np.sort(rng.choice(900, 400, replace=False))
    frame = pd.DataFrame({
        "ds": [D(2000, 1, 1) + dt.timedelta(days=int(d)) for d in day], "ys": [rng.normal(size=rng.integers(1, 4)) for _ in day],
        "season": list(rng.normal(size=(400, 7))),
    })
    history = forecast.History(frame.sample(frac=1, random_state=1))
    for end in (2, 150, 399, 400, 80):
        length = max(history.elapsed[end - 1], 1.0)
        points = np.unique(history.elapsed[rng.integers(0, end, 9)])
        x = np.hstack([history.trend(0, end, length, points), history.season[:end]])
        products, moments = history.normal_equations(end, length, points)
        assert np.allclose(products, x.T @ (history.n[:end, None] * x), rtol=1e-9, atol=1e-9)
        assert np.allclose(moments, x.T @ history.total[:end], rtol=1e-9, atol=1e-9)


def test_history_is_shuffled_once_for_all_cutoffs(spark):
    """One exchange of the days, without trend regressors, however many cutoffs there are."""
    days = make_days(spark, wavy(420, noise=1.0))
    seasonal = features.with_season(days, F.lit("US"), (1999, 2004))
    chosen = settings(spark, [("s", 0, 0.05, 10.0, "additive")])
    for cutoffs in (backtest.ladder_cutoffs(days).where("step = 1"), backtest.ladder_cutoffs(days)):
        inputs = settle(forecast.trend_inputs(days, cutoffs))
        plan = forecast.score(seasonal, inputs, chosen, 90, 4)._jdf.queryExecution().executedPlan().toString()
        season = [line for line in plan.splitlines() if "Exchange" in line and "REPARTITION" in line]
        assert len(season) == 2 and "trend" not in plan
        assert plan.count("FlatMapCoGroupsIn") == 1


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
@pytest.mark.parametrize("n", [90, 500])
def test_fit_matches_a_row_by_row_solution(spark, mode, n):
    rng = np.random.default_rng(n)
    values = [list(v + rng.normal(size=rng.integers(1, 4))) for v in wavy(n, noise=1.0)]
    days = make_days(spark, values)
    inputs, seasonal = whole_rows(days)
    pairs = [(0, 0.05, 10.0), (1, 0.5, 0.1)]
    fits = forecast.fit(seasonal, inputs, settings(spark, [("s", i, c, s, mode) for i, c, s in pairs]))
    ready = forecast.with_trend(seasonal.join(modelling.whole_history(days), "segment"), inputs)
    found = forecast.components(ready, fits).toPandas()
    train = ready.orderBy("ds").toPandas()
    for number, cps, sps in pairs:
        got = found[found.param_id == number].sort_values("ds")
        want = brute_force(train, cps, sps, mode == "multiplicative")
        first = np.r_[0, train.ys.map(len).cumsum()[:-1]]
        assert np.allclose(got.yhat, want[first], atol=1e-6)
        y = np.concatenate(train.ys.to_numpy())
        assert got.sigma.iloc[0] == pytest.approx(np.sqrt(np.mean((y - want) ** 2)), rel=1e-6)


def test_components_add_up(spark):
    days = make_days(spark, wavy(400, noise=1.0))
    inputs, seasonal = whole_rows(days)
    for mode in ("additive", "multiplicative"):
        fits = forecast.fit(seasonal, inputs, settings(spark, [("s", 0, 0.05, 10.0, mode)]))
        ready = forecast.with_trend(seasonal.join(modelling.whole_history(days), "segment"), inputs)
        p = forecast.components(ready, fits).toPandas()
        swing = p.weekly + p.yearly + p.holidays
        assert np.allclose(p.yhat, p.trend + swing if mode == "additive" else p.trend * (1 + swing))
        assert ((p.yhat_upper - p.yhat) - 1.2815515655446004 * p.sigma).abs().max() < 1e-9


def test_noiseless_trend_and_week_are_recovered(spark):
    n = 730
    days = make_days(spark, wavy(n))
    inputs, seasonal = whole_rows(days)
    fits = forecast.fit(seasonal, inputs, settings(spark, [("s", 0, 0.05, 10.0, "additive")]))
    frame = features.future_frame(days).join(modelling.whole_history(days), "segment")
    ready = forecast.with_trend(features.with_season(frame, F.lit("US"), (1999, 2004)), inputs)
    got = forecast.components(ready, fits).orderBy("ds").toPandas()
    assert len(got) == n + 180
    assert np.abs(got.yhat - wavy(n + 180)).max() < 0.05


def test_changepoints_are_evenly_spaced_observations(spark):
    days = make_days(spark, [[1.0, 2.0] if i % 5 == 0 else 1.0 for i in range(100)])
    spans = features.training_spans(days, modelling.whole_history(days))
    got = [r.ds for r in features.changepoint_dates(days, spans).orderBy("ds").collect()]
    dated = [d for d in range(100) for _ in range(2 if d % 5 == 0 else 1)]
    head = int(np.floor(len(dated) * 0.8))
    rows = np.linspace(0, head - 1, 26).round().astype(int)[1:]
    assert got == sorted({D(2000, 1, 1) + dt.timedelta(days=dated[r]) for r in rows})


def test_short_history_has_fewer_changepoints(spark):
    days = make_days(spark, range(1, 6))
    spans = features.training_spans(days, modelling.whole_history(days))
    assert features.changepoint_dates(days, spans).count() == 3


def test_cutoffs_step_back_and_skip_empty_windows(spark):
    dense = make_days(spark, [1.0] * 600)
    got = sorted(r.cutoff for r in backtest.generated_cutoffs(dense, 180).collect())
    last = D(2000, 1, 1) + dt.timedelta(days=599)
    want = []
    c = last - dt.timedelta(days=90)
    while c >= D(2000, 1, 1) + dt.timedelta(days=180):
        want.append(c)
        c -= dt.timedelta(days=90)
    assert got == sorted(want)
    gap = make_days(spark, [1.0] * 1000, name="g", skip=range(400, 800))
    for r in backtest.window_summary(backtest.windows(gap, backtest.generated_cutoffs(gap, 180))).collect():
        assert r.n_test > 0 and r.n_train > 0


def test_windows_split_at_the_cutoff(spark):
    days = make_days(spark, [1.0] * 500)
    rows = backtest.windows(days, backtest.ladder_cutoffs(days)).toPandas()
    assert rows.cutoff.nunique() == 6
    assert (rows[rows.is_train].ds <= rows[rows.is_train].cutoff).all()
    ahead = (pd.to_datetime(rows[~rows.is_train].ds) - pd.to_datetime(rows[~rows.is_train].cutoff)).dt.days
    assert ahead.between(1, 90).all()


def rolling_by_horizon(x, h, w):
    """Mean over exactly w rows ending at each horizon, walking back day by day."""
    sums = pd.DataFrame({"x": x, "h": h}).groupby("h")["x"].agg(["sum", "count"])
    out = {}
    for end in range(len(sums)):
        total, need = 0.0, w
        for k in range(end, -1, -1):
            s, c = sums.iloc[k]
            take = min(need, c)
            total += s * take / c
            need -= take
            if need == 0:
                out[sums.index[end]] = total / w
                break
    return out


def test_metrics_by_horizon_match_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(4):
        cutoff = D(2000, 1, 1) + dt.timedelta(days=30 * c)
        for h in sorted(rng.choice(np.arange(1, 91), 40, replace=False)):
            y, yhat = rng.uniform(1, 9), rng.uniform(1, 9)
            rows.append(("s", cutoff, cutoff + dt.timedelta(days=int(h)), float(y), float(yhat), float(yhat - 2), float(yhat + 2)))
    cv = spark.createDataFrame(rows, "segment string, cutoff date, ds date, y double, yhat double, yhat_lower double, yhat_upper double")
    got = backtest.metrics_by_horizon(cv).orderBy("horizon").toPandas().set_index("horizon")
    df = pd.DataFrame(rows, columns=["s", "cutoff", "ds", "y", "yhat", "lo", "hi"])
    h = (pd.to_datetime(df.ds) - pd.to_datetime(df.cutoff)).dt.days
    w = int(0.1 * len(df))
    ape = ((df.y - df.yhat) / df.y).abs()
    for name, x in (("mape", ape), ("mse", (df.y - df.yhat) ** 2), ("coverage", ((df.y >= df.lo) & (df.y <= df.hi)).astype(float))):
        want = rolling_by_horizon(x, h, w)
        assert list(got.index) == list(want)
        assert np.allclose(got[name], list(want.values()))


def test_search_scores_match_separate_forecasts(spark):
    """Error sums formed inside the tasks equal errors of joined predictions; the best one wins."""
    rng = np.random.default_rng(3)
    days = make_days(spark, [list(v + rng.normal(size=2)) for v in wavy(420, noise=1.0)])
    seasonal = features.with_season(days, F.lit("US"), (1999, 2004))
    inputs = forecast.trend_inputs(days, backtest.ladder_cutoffs(days))
    chosen = settings(
        spark,
        [("s", 0, 0.05, 10.0, "additive"), ("s", 1, 0.5, 0.5, "additive"), ("s", 2, 0.05, 10.0, "multiplicative"), ("s", 3, 0.9, 2.0, "multiplicative")],
    )
    scores = backtest.tuning_scores(seasonal, inputs, chosen, 90, 2).toPandas().set_index("param_id")
    test = forecast.components(backtest.horizon_rows(seasonal, inputs, 90), forecast.fit(seasonal, inputs, chosen, 3))
    flat = test.select("param_id", F.explode("ys").alias("y"), "yhat").toPandas()
    flat["ape"] = ((flat.y - flat.yhat) / flat.y).abs()
    flat["se"] = (flat.y - flat.yhat) ** 2
    want = flat.groupby("param_id")[["ape", "se"]].mean()
    assert np.allclose(scores.mape.sort_index(), want.ape) and np.allclose(scores.rmse.sort_index(), np.sqrt(want.se))
    best = backtest.best_setting(backtest.tuning_scores(seasonal, inputs, chosen, 90, 1), "mape").first()
    assert best.param_id == want.ape.idxmin()


def test_samples_are_as_many_as_the_registry_says_and_repeatable(spark):
    names = spark.createDataFrame([("north_us",), ("apac_no_china",)], "segment string")
    first = backtest.sampled_settings(names).toPandas()
    again = backtest.sampled_settings(names.repartition(3)).toPandas()
    assert first.groupby("segment").size().to_dict() == {"north_us": 500, "apac_no_china": 100}
    assert set(map(tuple, first.to_numpy())) == set(map(tuple, again.to_numpy()))
    assert not first.duplicated(["segment", "param_id"]).any()


def test_random_search_beats_or_ties_every_sampled_setting(spark, folder):
    got = forecasting.random_search(spark, folder).collect()
    assert len({r.segment for r in got}) == len(got) > 0
    assert all(r.mape >= 0 and 0.01 <= r.cps <= 1.0 and 0.5 <= r.sps <= 10 for r in got)


def test_undefined_accuracy_drops_out(spark):
    rows = spark.createDataFrame(
        [("s", D(2000, 1, 1), 0.0, 0.0), ("s", D(2000, 1, 2), 2.0, 0.0), ("s", D(2000, 1, 3), 2.0, 4.0), ("s", D(2000, 1, 4), 2.0, None)],
        "segment string, ds date, y double, yhat double",
    )
    assert [(r.ds, r.accuracy_by_day) for r in scoring.accuracy_by_day(rows).collect()] == [(D(2000, 1, 3), 0.5)]


def test_missing_segment_days_count_as_zero_and_empty_totals_have_no_error(spark):
    totals = spark.createDataFrame([(D(2000, 1, 1), 10.0), (D(2000, 1, 2), 0.0), (D(2000, 1, 3), 4.0)], "ds date, unique_tickets double")
    results = spark.createDataFrame(
        [("a", D(2000, 1, 1), 6.0), ("b", D(2000, 1, 1), 2.0), ("a", D(2000, 1, 2), 1.0), ("a", D(1999, 1, 1), 9.0)],
        "segment string, ds date, yhat double",
    )
    daily = scoring.reconcile_daily(totals, results)
    got = {r.ds.day: (r.predictions, r.percent_error) for r in daily.collect()}
    assert got == {1: (8.0, 0.2), 2: (1.0, None), 3: (0.0, 1.0)}
    summary = scoring.mape(daily).first()
    assert (summary.mape, summary.n_rows, summary.n_skipped) == (pytest.approx(0.6), 3, 1)
    month = scoring.reconcile_monthly(daily).first()
    assert (month.year_month, month.unique_tickets, month.predictions) == (D(2000, 1, 1), 14.0, 9.0)


def test_short_series_are_reported(spark):
    days = spark.createDataFrame(
        [("a", D(2023, 1, d), [1.0]) for d in range(1, 9)] + [("b", D(2023, 1, 1), [2.0])], "segment string, ds date, ys array<double>"
    )
    windows = spark.createDataFrame([("a", D(2023, 1, 5)), ("b", D(2023, 1, 1)), ("c", None), ("a", D(2022, 1, 1))], "segment string, cutoff date")
    found = {(r.segment, r.cutoff): (r.n_rows, r.status) for r in forecast.fit_status(days, windows).collect()}
    assert found == {
        ("a", D(2023, 1, 5)): (5, "fitted"), ("b", D(2023, 1, 1)): (1, "a single observation"), ("c", None): (0, "no history"),
        ("a", D(2022, 1, 1)): (0, "no history"),
    }


def test_own_daily_table_with_export_labels(spark):
    """The whole way from a daily table of 2022 to 2024, spelled as in the exports, to the reconciliation."""
    labels, dates = registry.export_labels("One", "Two"), registry.EXPORT_DATES
    rows = []
    for i in range(500):
        day = D(2022, 6, 1) + dt.timedelta(days=i)
        for place, country, volume in ((labels.emea, labels.united_kingdom, 40 + i % 7), (labels.latam, labels.brazil, 20 + i // 50)):
            rows.append((day, place, country, "One", 0 if (day.month, day.day) == (12, 26) else volume))
    daily = spark.createDataFrame(rows, "sys_created_date date, level1 string, level2 string, organization_flag string, unique_tickets bigint")
    found = plans_scoring.model_reconciliation(spark, daily, labels, dates).orderBy("ds").toPandas()
    assert len(found) == 500
    errors = found.abs_percent_error[found.unique_tickets > 0]
    assert errors.mean() < 0.05


def test_sliding_median_matches_a_loop_and_repeats_no_row(spark):
    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("a", 300), ("b", 7), ("none", 12)):
        for i in range(n):
            ape = None if name == "none" or rng.random() < 0.1 else float(np.round(rng.uniform(0, 1), 1))
            rows.append((name, int(rng.integers(1, 31)), D(2000, 1, 1), D(2000, 1, 1) + dt.timedelta(days=i), ape))
    frame = spark.createDataFrame(rows, "segment string, horizon int, cutoff date, ds date, ape double")
    for share in (0.01, 0.1, 0.5, 1.0):
        found = backtest._median_by_horizon(frame, share)
        got = {(r["segment"], r["horizon"]): r["mdape"] for r in found.collect()}
        want = {}
        for name in ("a", "b", "none"):
            own = sorted((r for r in rows if r[0] == name), key=lambda r: r[1:4])
            w = max(int(len(own) * share), 1)
            for h in {r[1] for r in own}:
                last = max(i for i, r in enumerate(own) if r[1] == h) + 1
                first = min(min(i for i, r in enumerate(own) if r[1] == h), last - w)
                if first >= 0:
                    known = [r[4] for r in own[first:last] if r[4] is not None]
                    want[name, h] = float(np.median(known)) if known else None
        assert got.keys() == want.keys()
        assert all(got[k] == (None if v is None else pytest.approx(v, abs=1e-12)) for k, v in want.items())
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
