"""Forecast bands that widen with the horizon: simulated trend changes of the decomposable model.

The trend goes on changing after the history as often as it had places to change in it, by slopes from a Laplace
distribution whose scale is the mean size of the fitted changes (Taylor and Letham, 2018, section 3.1.4). A path draws such
changes and the noise of every day; the band of a day lies between two quantiles over its paths.

Draws come from a counter: the uniforms of a step are digits of a hash of seed, window, path and step. So no task
keeps a generator, a lost task draws the same again, and another engine can draw the same paths. All of it runs on the JVM; the
rows are windows x paths x days ahead, whatever the ticket volume, and are grouped by path, then by day.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.operators.forecast import WINDOW

# Paths per window, and the quantiles of an 80 % band.
PATHS = 500
LOWER, UPPER = 0.1, 0.9

_KEY = [*WINDOW, "param_id"]


def uniform(digest: str, place: int) -> Column:
    """A number between 0 and 1, both excluded, from 8 hexadecimal digits of a digest; ``place`` is 0 to 3."""
    digits = F.conv(F.substr(F.col(digest), F.lit(8 * place + 1), F.lit(8)), 16, 10).cast("bigint")
    return (digits + F.lit(0.5)) / F.lit(2.0**32)


def drawn_paths(windows: DataFrame, steps: int, paths: int = PATHS, seed: int = 0) -> DataFrame:
    """``windows`` (segment, cutoff, param_id, rate, change, sigma) x path x step, with ``drift`` and ``noise``.

    ``rate``: probability that the trend changes on a day; ``change``: mean size of a change, in units of the series a
    day. ``drift`` is what the changes before a step have added to the trend by then: the first day has none.
    """
    listed = windows.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(paths))))
    listed = listed.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    digest = F.md5(F.concat_ws(":", F.lit(seed), "segment", F.col("cutoff").cast("string"), "path", "step").cast("binary"))
    size, turn = uniform("digest", 1) - F.lit(0.5), uniform("digest", 0) < F.col("rate")
    laplace = -F.signum(size) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(size))
    normal = F.sqrt(F.lit(-2.0) * F.ln(uniform("digest", 2))) * F.cos(F.lit(2 * math.pi) * uniform("digest", 3))
    drawn = listed.withColumn("digest", digest).select(
        *_KEY, "path", "step", F.when(turn, F.col("change") * laplace).otherwise(F.lit(0.0)).alias("bend"),
        (F.col("sigma") * normal).alias("noise"),
    )
    before = Window.partitionBy(*_KEY, "path").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    # A bend at step j adds bend * (h - j) by step h: two running sums.
    sums = drawn.withColumn("bends", F.sum("bend").over(before)).withColumn("moments", F.sum(F.col("bend") * F.col("step")).over(before))
    drift = F.coalesce(F.col("bends") * F.col("step") - F.col("moments"), F.lit(0.0))
    return sums.select(*_KEY, "path", "step", drift.alias("drift"), "noise")


def trend_prospects(inputs: DataFrame, fits: DataFrame) -> DataFrame:
    """Per window and setting how often and how far its trend may change: the ``windows`` of ``drawn_paths``.

    A fit without changepoints has a rate and a change of zero: its band has one width.
    """
    length = F.greatest(F.date_diff("last_ds", "first_ds"), F.lit(1)).cast("double")
    changes = F.slice("trend_beta", F.lit(3), F.greatest(F.size("trend_beta") - 2, F.lit(0)))
    number = F.size(changes)
    total = F.aggregate(changes, F.lit(0.0), lambda s, v: s + F.abs(v))
    return inputs.join(fits, WINDOW).select(
        *_KEY, "sigma", F.least(number / length, F.lit(1.0)).alias("rate"),
        F.when(number > 0, total / number / length).otherwise(F.lit(0.0)).alias("change"),
    )


def simulated_bands(rows: DataFrame, prospects: DataFrame, steps: int, paths: int = PATHS, seed: int = 0) -> DataFrame:
    """``rows`` up to ``steps`` days after their cutoff with ``step`` and a simulated ``yhat_lower`` and ``yhat_upper``.

    ``rows``: the result of ``forecast.components``. Days up to the cutoff are left out; days beyond ``steps`` too, as their
    paths are not drawn. In multiplicative mode the season goes with the drift.
    """
    ahead = rows.withColumn("step", F.date_diff("ds", "cutoff")).filter(F.col("step").between(1, steps)).drop("yhat_lower", "yhat_upper")
    drawn = drawn_paths(prospects, steps, paths, seed)
    swing = F.when(F.col("mode") == "multiplicative", F.lit(1.0) + F.col("weekly") + F.col("yearly") + F.col("holidays")).otherwise(F.lit(1.0))
    value = F.col("yhat") + F.col("drift") * swing + F.col("noise")
    ends = F.percentile(value, F.array(F.lit(LOWER), F.lit(UPPER)))
    found = drawn.join(ahead.select(*_KEY, "ds", "step", "yhat", "mode", "weekly", "yearly", "holidays"), [*_KEY, "step"]).groupBy(
        *_KEY, "ds").agg(ends.alias("ends"))
    return ahead.join(found, [*_KEY, "ds"]).withColumns({"yhat_lower": F.col("ends")[0], "yhat_upper": F.col("ends")[1]}).drop("ends")
