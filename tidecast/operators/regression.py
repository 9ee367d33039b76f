"""Least squares for many series at once from distributed sums of products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.numbers import dot
from tidecast.operators.features import DESIGN_NAMES, OLS_STEPS, design_columns, next_positions, with_position


def gram(rows: DataFrame, key: str) -> DataFrame:
    """Upper triangle of X'X with y as last column, one row per series and pair of columns.

    ``rows`` holds ``key, x ARRAY<DOUBLE>, y``. Every task multiplies its own rows and sends one
    small triangle per series, so a long series is spread over tasks and the shuffle does not grow
    with its rows.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby(key, sort=False):
                x = np.column_stack([np.stack(part["x"].to_numpy()), part["y"].to_numpy(float)])
                i, j = np.triu_indices(x.shape[1])
                yield pd.DataFrame({key: name, "i": i, "j": j, "value": (x.T @ x)[i, j]})

    pieces = rows.select(key, "x", "y").mapInPandas(partial, f"{key} string, i int, j int, value double")
    return pieces.groupBy(key, "i", "j").agg(F.sum("value").alias("value"))


#: A column is redundant if less than this share of its sum of squares is left after the columns before it.
REDUNDANT = 1e-8


def independent(products: np.ndarray) -> np.ndarray:
    """Which columns are no combination of the columns before them, from X'X alone.

    A Cholesky factorisation of the scaled products that takes the columns from left to right and passes over those
    with nothing left: the leftmost columns of full rank stay. Products hold half of the digits, so a column of which
    about 1e-4 of its length is left may go either way; all fits agree on the fitted values up to that.
    """
    size = len(products)
    squares = np.diag(products)
    scale = np.sqrt(np.where(squares > 0, squares, 1.0))
    left = products / np.outer(scale, scale)
    kept = np.zeros(size, bool)
    for column in range(size):
        pivot = left[column, column]
        if pivot <= REDUNDANT:
            continue
        kept[column] = True
        left = left - np.outer(left[:, column], left[column]) / pivot
    return kept


def _whole(triangle: pd.DataFrame) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    size = int(triangle["j"].max()) + 1
    full = np.zeros((size, size))
    full[triangle["i"], triangle["j"]] = triangle["value"]
    return full + np.triu(full, 1).T


def solve(products: DataFrame, key: str) -> DataFrame:
    """Coefficients per series from its triangle. Redundant columns are dropped: their coefficient is zero."""

    def coefficients(triangle: pd.DataFrame) -> pd.DataFrame:
        full = _whole(triangle)
        kept = np.flatnonzero(independent(full[:-1, :-1]))
        scale = np.sqrt(np.diag(full)[kept])
        lhs = full[np.ix_(kept, kept)] / np.outer(scale, scale)
        beta = np.zeros(len(full) - 1)
        beta[kept] = np.linalg.lstsq(lhs, full[kept, -1] / scale, rcond=1e-12)[0] / scale
        return pd.DataFrame({key: [triangle[key].iloc[0]], "beta": [beta]})

    return products.groupBy(key).applyInPandas(coefficients, f"{key} string, beta array<double>")


def kept_terms(products: DataFrame, key: str, names: list[str] = DESIGN_NAMES) -> DataFrame:
    """``key, position, term, kept``: every term of the design and whether a series' fit holds it."""

    def told(triangle: pd.DataFrame) -> pd.DataFrame:
        kept = independent(_whole(triangle)[:-1, :-1])
        return pd.DataFrame({key: triangle[key].iloc[0], "position": np.arange(len(kept)), "term": names, "kept": kept})

    return products.groupBy(key).applyInPandas(told, f"{key} string, position int, term string, kept boolean")


def design_rows(series: DataFrame, key: str) -> DataFrame:
    placed = with_position(series, key)
    x = F.array(*design_columns(F.col("position"), F.col("ds")))
    return placed.select(key, "ds", "position", "y", x.alias("x"))


def fit_ols(series: DataFrame, key: str) -> DataFrame:
    return solve(gram(design_rows(series, key), key), key)


def named_coefficients(fits: DataFrame, key: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in DESIGN_NAMES])
    pairs = F.arrays_zip(names.alias("term"), F.col("beta"))
    return fits.select(key, F.inline(pairs))


def predict_ols(rows: DataFrame, fits: DataFrame, key: str) -> DataFrame:
    """Fitted or forecast values; ``fits`` has one short row per series."""
    return rows.join(fits, key).withColumn("yhat", dot(F.col("beta"), F.col("x"))).drop("beta", "x")


def forecast_ols(series: DataFrame, fits: DataFrame, key: str, steps: int = OLS_STEPS) -> DataFrame:
    ahead = next_positions(series, key, steps)
    x = F.array(*design_columns(F.col("position"), F.col("ds")))
    return predict_ols(ahead.withColumn("x", x), fits, key)
