"""Guided search of settings: a tree-structured Parzen sampler that works in parallel rounds.

The state of a search is a table of trials, ``segment, param_id, cps, sps, mode, score``. After every round the trials of a
segment are parted into good and bad ones (Bergstra et al., "Algorithms for Hyper-Parameter Optimization", 2011). Each
part has a density per axis: a mixture of one kernel per trial and of the uniform density. Candidates are drawn from
the good density and those with the largest ratio of good to bad density are tried next, all segments' batches in one job.

The space is a finite table, so densities are rows of its axes and a draw is an exponential race: a point with weight w
finishes at -ln(u) / w, where u is a hash of seed, segment, round and point. Every engine and every run draws the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.operators.backtest import sampled_settings, search_settings
from tidecast.session import discard, settle
from tidecast.sources.registry import SEARCH_CPS, SEARCH_MODES, SEARCH_SPS, setting_of

#: Share of the trials that counts as good, and the most of them.
GOOD_SHARE, GOOD_MOST = 0.1, 25
#: Width of a kernel as a share of its axis: this over the fifth root of the number of kernels.
BANDWIDTH = 0.25
#: Candidates drawn for every setting that is tried.
CANDIDATES = 24
#: Rounds of a search, the plain draw of the first one included; each tries the same number of settings.
ROUNDS = 5
#: Scores are compared to so many digits, so that the order of summation decides no tie.
SCORE_DIGITS = 6

#: Kernels are counted in parts of one.
KERNEL_UNIT = 1e12

_AXES = {"cps": SEARCH_CPS, "sps": SEARCH_SPS}


def _parts() -> dict[str, Column]:
    return {"good": F.col("good"), "bad": ~F.col("good")}


def parted(trials: DataFrame) -> DataFrame:
    """Trials with ``good``, the best tenth of each segment, and ``n``, the size of the trial's part. Without a score it is bad."""
    score = F.round("score", SCORE_DIGITS)
    order = Window.partitionBy("segment").orderBy(score.asc_nulls_last(), "param_id")
    n = F.count("score").over(Window.partitionBy("segment"))
    share = F.least(F.ceil(n * F.lit(GOOD_SHARE)), F.lit(GOOD_MOST))
    told = trials.withColumn("good", F.col("score").isNotNull() & (F.row_number().over(order) <= share))
    return told.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("segment", "good")))


def axis_density(known: DataFrame, axis: str) -> DataFrame:
    """``segment, <axis>, <axis>_good, <axis>_bad``: both densities at every place of a numeric axis.

    ``known``: the parted trials. Kernels are added up as whole numbers, so that no order of summation moves a draw.
    """
    low, high, step = _AXES[axis]
    size = round((high - low) / step) + 1
    places = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.round(F.lit(low) + i * F.lit(step), 3))
    width = F.lit(BANDWIDTH * (high - low)) / F.pow(F.col("n").cast("double"), F.lit(0.2))
    z = (F.col("place") - F.col(axis)) / width
    kernel = F.round(F.exp(-z * z / F.lit(2.0)) * F.lit(KERNEL_UNIT)).cast("bigint")
    rows = known.select("segment", "good", "n", axis, F.explode(places).alias("place"))
    weights = rows.groupBy("segment", "place").agg(
        *[F.sum(F.when(part, kernel)).alias(f"{name}_weight") for name, part in _parts().items()],
        *[F.coalesce(F.max(F.when(part, F.col("n"))), F.lit(0)).alias(f"{name}_n") for name, part in _parts().items()],
    )
    whole = Window.partitionBy("segment")
    found = [F.col("segment"), F.col("place").alias(axis)]
    for name in _parts():
        n, weight = F.col(f"{name}_n"), F.col(f"{name}_weight")
        share = F.coalesce(weight / F.sum(weight).over(whole), F.lit(0.0))
        found.append(((n * share + F.lit(1.0 / size)) / (n + 1)).alias(f"{axis}_{name}"))
    return weights.select(*found)


def mode_density(known: DataFrame) -> DataFrame:
    """The same for the modes: how often each was tried, and the uniform density."""
    found = [F.col("segment"), F.col("listed").alias("mode")]
    rows = known.withColumn("listed", F.explode(F.array(*[F.lit(m) for m in SEARCH_MODES])))
    counts = rows.groupBy("segment", "listed").agg(
        *[F.count_if(part & (F.col("mode") == F.col("listed"))).alias(f"{name}_seen") for name, part in _parts().items()],
        *[F.count_if(part).alias(f"{name}_n") for name, part in _parts().items()],
    )
    for name in _parts():
        seen, n = F.col(f"{name}_seen"), F.col(f"{name}_n")
        found.append(((seen + F.lit(1.0 / len(SEARCH_MODES))) / (n + 1)).alias(f"mode_{name}"))
    return counts.select(*found)


def proposals(trials: DataFrame, batch: Column, round_: int, seed: int = 0) -> DataFrame:
    """The settings to try next: ``segment, param_id, cps, sps, mode``, up to ``batch`` per segment and none tried before.

    A segment's trials are as many as a search has, so its densities and its space are bounded; segments are
    spread over tasks. ``batch`` is an expression on the segment name.
    """
    known = parted(trials)
    point = ["cps", "sps", "mode"]
    tried = trials.select("segment", *point)
    space = search_settings(trials.select("segment").distinct()).join(tried, ["segment", *point], "left_anti")
    for axis in _AXES:
        space = space.join(axis_density(known, axis), ["segment", axis])
    space = space.join(mode_density(known), ["segment", "mode"])
    good, bad = (F.col(f"cps_{p}") * F.col(f"sps_{p}") * F.col(f"mode_{p}") for p in ("good", "bad"))
    named = F.concat_ws(":", F.lit(seed).cast("string"), "segment", F.lit(round_).cast("string"), F.col("param_id").cast("string"))
    drawn = F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("bigint")
    finish = -F.log((drawn + F.lit(0.5)) / F.lit(float(1 << 48))) / good
    race = Window.partitionBy("segment").orderBy("finish", "param_id")
    rank = Window.partitionBy("segment").orderBy(F.col("ratio").desc(), "param_id")
    raced = space.withColumn("finish", finish).withColumn("ratio", F.round(good / bad, 9))
    raced = raced.withColumn("place", F.row_number().over(race)).filter(F.col("place") <= batch * F.lit(CANDIDATES))
    best = raced.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= batch)
    return best.select("segment", "param_id", *point)


def guided_search(segments: DataFrame, score: Callable[[DataFrame], DataFrame], metric: str, trials: Column | None = None,
                  rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """All trials of a search: ``segment, round, param_id, cps, sps, mode, score``, a written table.

    ``score`` takes a table of settings and returns it with ``metric``; a setting that it leaves out or scores with
    NULL counts as bad. ``trials``: their number per segment, by default the registry's. The first round takes the first
    settings of the plain draw, every later one what the sampler proposes. Only tables of trials pass between rounds.
    """
    total = setting_of("trials") if trials is None else trials
    share = F.ceil(total / F.lit(rounds)).cast("int")
    point = ["segment", "param_id", "cps", "sps", "mode"]
    done = None
    for round_ in range(rounds):
        batch = F.greatest(F.least(share, total - share * F.lit(round_)), F.lit(0))
        drawn = sampled_settings(segments, seed, batch) if done is None else proposals(done, batch, round_, seed)
        wanted = settle(drawn.select(*point))
        known = score(wanted).select("segment", "param_id", F.col(metric).alias("score"))
        rows = wanted.join(known, ["segment", "param_id"], "left").select(
            "segment", F.lit(round_).alias("round"), *point[1:], "score"
        )
        before, done = done, settle(rows if done is None else done.unionByName(rows))
        discard(wanted, *([before] if before is not None else []))
    return done
