"""Simulated bands: the draws by another route, their spread, and how often series of the model stay inside."""

from __future__ import annotations

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import bands

D = dt.date
CUTOFF = D(2001, 1, 1)
WINDOWS = "segment string, cutoff date, param_id int, rate double, change double, sigma double"


def frame(spark, names, steps, mode="additive", swing=0.0):
    rows = [(n, CUTOFF, 0, CUTOFF + dt.timedelta(days=k), 50.0, mode, swing, 0.0, 0.0) for n in names for k in range(-3, steps + 6)]
    return spark.createDataFrame(
        rows, "segment string, cutoff date, param_id int, ds date, yhat double, mode string, weekly double, yearly double, holidays double"
    )


def plain_path(segment, path, steps, rate, change, sigma):
    """Drift and noise of one path, drawn by hashlib and added up change by change."""
    drift, noise = np.zeros(steps + 1), []
    for step in range(1, steps + 1):
        digest = hashlib.md5(f"0:{segment}:{CUTOFF}:{path}:{step}".encode()).hexdigest()
        u, v, w, x = ((int(digest[8 * k : 8 * k + 8], 16) + 0.5) / 2**32 for k in range(4))
        if u < rate:
            bend = -change * np.sign(v - 0.5) * np.log(1 - 2 * abs(v - 0.5))
            drift += bend * np.maximum(np.arange(steps + 1) - step, 0)
        noise.append(sigma * np.sqrt(-2 * np.log(w)) * np.cos(2 * np.pi * x))
    return drift[1:], np.array(noise)


@pytest.mark.parametrize("mode, swing", [("additive", 0.5), ("multiplicative", 0.5)])
def test_bands_match_paths_drawn_one_by_one(spark, mode, swing):
    steps, paths = 40, 60
    prospects = spark.createDataFrame([("a", CUTOFF, 0, 0.2, 0.3, 2.0), ("b", CUTOFF, 0, 0.0, 0.0, 1.0)], WINDOWS)
    got = bands.simulated_bands(frame(spark, "ab", steps, mode, swing), prospects, steps, paths).toPandas()
    assert len(got) == 2 * steps and got.step.between(1, steps).all()
    for name, rate, change, sigma in (("a", 0.2, 0.3, 2.0), ("b", 0.0, 0.0, 1.0)):
        drawn = [plain_path(name, p, steps, rate, change, sigma) for p in range(1, paths + 1)]
        factor = 1.5 if mode == "multiplicative" else 1.0
        values = np.array([50.0 + factor * drift + noise for drift, noise in drawn])
        own = got[got.segment == name].sort_values("step")
        assert np.allclose(own.yhat_lower, np.quantile(values, 0.1, axis=0), atol=1e-9)
        assert np.allclose(own.yhat_upper, np.quantile(values, 0.9, axis=0), atol=1e-9)


def test_bands_widen_and_hold_four_fifths_of_the_model_s_series(spark):
    steps, names = 120, [f"s{i}" for i in range(40)]
    prospects = spark.createDataFrame([(n, CUTOFF, 0, 0.05, 0.2, 2.0) for n in names], WINDOWS)
    got = bands.simulated_bands(frame(spark, names, steps), prospects, steps, 200).toPandas().sort_values(["segment", "step"])
    width = (got.yhat_upper - got.yhat_lower).groupby(got.step).mean()
    assert width[1] == pytest.approx(2 * 1.2816 * 2.0, rel=0.1)
    assert all(width[b] > 1.3 * width[a] for a, b in ((10, 30), (30, 60), (60, 120)))
    rng, inside = np.random.default_rng(1), []
    for _, own in got.groupby("segment"):
        for _ in range(50):
            bend = np.where(rng.random(steps) < 0.05, rng.laplace(0, 0.2, steps), 0.0)
            slope = np.concatenate([[0.0], np.cumsum(bend)[:-1]])
            truth = 50.0 + np.cumsum(slope) + rng.normal(0, 2.0, steps)
            inside.append((truth >= own.yhat_lower.to_numpy()) & (truth <= own.yhat_upper.to_numpy()))
    share = np.array(inside).mean(axis=0)
    assert share.mean() == pytest.approx(0.8, abs=0.02) and share.min() > 0.74 and share.max() < 0.86


def test_prospects(spark):
    inputs = spark.createDataFrame([("a", CUTOFF, D(2000, 1, 1), D(2000, 4, 10)), ("b", CUTOFF, CUTOFF, CUTOFF)],
                                   "segment string, cutoff date, first_ds date, last_ds date")
    fits = spark.createDataFrame([("a", CUTOFF, 0, 1.5, [1.0, 2.0, 30.0, -10.0, 0.0, 0.0]), ("b", CUTOFF, 0, 1.0, [1.0, 2.0])],
                                 "segment string, cutoff date, param_id int, sigma double, trend_beta array<double>")
    rows = {r["segment"]: r for r in bands.trend_prospects(inputs, fits).collect()}
    assert rows["a"]["rate"] == pytest.approx(4 / 100) and rows["a"]["change"] == pytest.approx(40 / 4 / 100)
    assert (rows["b"]["rate"], rows["b"]["change"]) == (0.0, 0.0)


def test_draws_do_not_depend_on_the_number_of_tasks(spark):
    prospects = spark.createDataFrame([("a", CUTOFF, 0, 0.2, 0.3, 2.0)], WINDOWS)
    one, many = (bands.drawn_paths(prospects.repartition(n), 20, 10).orderBy("path", "step").collect() for n in (1, 8))
    assert one == many
    assert bands.drawn_paths(prospects.filter(F.lit(False)), 20, 10).count() == 0
