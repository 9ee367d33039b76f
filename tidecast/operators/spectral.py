"""Periodogram of daily series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAYS_PER_CYCLE_UNIT = 365.0  # fixed value: frequencies count cycles per 365 observations

# Named frequencies, in cycles per year.
BANDS = (
    ("Annual", 1.0),
    ("Semiannual", 2.0),
    ("Quarterly", 4.0),
    ("Bimonthly", 6.0),
    ("Monthly", 12.0),
    ("Biweekly", 26.0),
    ("Weekly", 52.0),
    ("Semiweekly", 104.0),
)
SPECTRUM = "{key} string, k int, n int, frequency double, spectrum double"


def periodogram(series: DataFrame, key: str = "segment") -> DataFrame:
    """One-sided power spectrum of each series after removing its linear trend.

    A series holds one row per date, so a group is as long as the calendar. The fast transform
    costs N log N; a sum over rows x frequencies would cost N squared.
    """

    def spectrum(days: pd.DataFrame) -> pd.DataFrame:
        y = days.sort_values("ds")["y"].to_numpy(float)
        n = len(y)
        x = np.arange(n) - (n - 1) / 2
        slope = (x @ y) / max(x @ x, 1.0)
        power = np.abs(np.fft.rfft(y - y.mean() - slope * x)) ** 2 / n**2
        k = np.arange(len(power))
        paired = (k > 0) & (2 * k != n)
        return pd.DataFrame(
            {
                key: days[key].iloc[0],
                "k": k,
                "n": n,
                "frequency": DAYS_PER_CYCLE_UNIT * k / n,
                "spectrum": np.where(paired, 2.0, 1.0) * power,
            }
        )

    return series.groupBy(key).applyInPandas(spectrum, SPECTRUM.format(key=key))


def named_bands(spectrum: DataFrame, key: str = "segment") -> DataFrame:
    """The spectrum at the frequency nearest to each named one that the series can resolve."""
    # Every spectrum row keeps only the bands that land on it: one pass, no join.
    listed = [F.struct(F.lit(c).alias("cycles"), F.lit(b).alias("band")) for b, c in BANDS]
    here = F.filter(
        F.array(*listed),
        lambda b: F.floor(b["cycles"] * F.col("n") / F.lit(DAYS_PER_CYCLE_UNIT) + F.lit(0.5)) == F.col("k"),
    )
    return spectrum.select(key, "k", "frequency", "spectrum", F.inline(here))
