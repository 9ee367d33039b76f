from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidecast.operators import backtest, sampler

SEEN = "segment string, param_id int, cps double, sps double, mode string, score double"


def valley(settings):
    """A known objective with its lowest point at cps 0.7, sps 3, additive."""
    at = F.abs(F.col("cps") - 0.7) + F.abs(F.col("sps") - 3.0) / 10 + F.when(F.col("mode") == "additive", 0.0).otherwise(0.5)
    return settings.withColumn("mape", at)


@pytest.fixture(scope="module")
def trials(spark):
    names = spark.createDataFrame([("a",), ("b",)], "segment string")
    return valley(backtest.sampled_settings(names, 0, F.lit(60))).withColumnRenamed("mape", "score").toPandas()


def test_proposals_are_new_and_the_same_whatever_the_partitions(spark, trials):
    made = spark.createDataFrame(trials)
    first, again = (
        {tuple(r) for r in sampler.proposals(made.repartition(n), F.lit(15), 1).collect()} for n in (1, 7)
    )
    assert first == again and len(first) == 30
    assert not {r[:2] for r in first} & {(r.segment, r.param_id) for r in trials.itertuples()}
    assert {r[0] for r in first} == {"a", "b"}
    other = {tuple(r) for r in sampler.proposals(made, F.lit(15), 2).collect()}
    assert other != first


def test_densities_are_those_of_the_kernels(spark, trials):
    own = trials[trials.segment == "a"].sort_values(["score", "param_id"])
    good, bad = own[:6], own[6:]
    known = sampler.parted(spark.createDataFrame(trials)).filter("segment = 'a'")
    places = [0.5 + 0.5 * i for i in range(20)]

    def density(points):
        width = 9.5 * 0.25 / len(points) ** 0.2
        weights = [sum(math.exp(-(((v - x) / width) ** 2) / 2) for x in points) for v in places]
        return [(len(points) * w / sum(weights) + 1 / 20) / (len(points) + 1) for w in weights]

    got = {r.sps: (r.sps_good, r.sps_bad) for r in sampler.axis_density(known, "sps").collect()}
    assert [got[v][0] for v in places] == pytest.approx(density(list(good.sps)))
    assert [got[v][1] for v in places] == pytest.approx(density(list(bad.sps)))
    modes = {r.mode: (r.mode_good, r.mode_bad) for r in sampler.mode_density(known).collect()}
    for mode in modes:
        assert modes[mode] == pytest.approx([(sum(part["mode"] == mode) + 0.5) / (len(part) + 1) for part in (good, bad)])
    assert sum(v[0] for v in modes.values()) == pytest.approx(1.0)


def test_a_search_has_its_number_of_trials_and_ends_near_the_lowest_point(spark):
    names = spark.createDataFrame([("a",), ("b",), ("none",)], "segment string")
    total = F.when(F.col("segment") == "a", 103).when(F.col("segment") == "b", 40).otherwise(0)
    done = sampler.guided_search(names, valley, "mape", total).toPandas()
    assert done.groupby("segment").size().to_dict() == {"a": 103, "b": 40}
    assert not done.duplicated(["segment", "param_id"]).any()
    plain = valley(backtest.sampled_settings(names, 0, total)).toPandas().groupby("segment").mape.min()
    best = done.groupby("segment").score.min()
    assert best["a"] < plain["a"] and best["b"] <= plain["b"]
    late = done[(done.segment == "a") & (done["round"] > 0)]
    assert (late["mode"] == "additive").mean() > 0.7


def test_trials_without_a_score_are_bad_and_no_trials_give_no_proposals(spark):
    rows = [("s", 1, 0.2, 1.0, "additive", None), ("s", 2, 0.4, 2.0, "additive", 0.5), ("t", 3, 0.4, 2.0, "additive", None)]
    made = spark.createDataFrame(rows, SEEN)
    assert {r.param_id: r.good for r in sampler.parted(made).collect()} == {1: False, 2: True, 3: False}
    got = sampler.proposals(made, F.lit(4), 1).toPandas()
    assert got.groupby("segment").size().to_dict() == {"s": 4, "t": 4}
    assert sampler.proposals(spark.createDataFrame([], SEEN), F.lit(4), 1).count() == 0
