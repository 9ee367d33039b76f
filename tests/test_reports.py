"""Reports, filters and series on hand-made rows with the awkward cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.functions import dates, numbers
from tidecast.operators import reports
from tidecast.operators import series as ops
from tidecast.sources import tickets as src
from tidecast.sources.files import literal_table
from tidecast.sources.registry import SEGMENTS, STAR_DATES, STAR_LABELS, STAR_OVERRIDES, export_labels, membership
from tidecast.sources.schemas import DAILY_LOCATION, OVERRIDES

D = dt.date
EVENTS = "sr_number long, sys_created_date date, level1 string, level2 string, organization_flag string"


def daily(spark, rows):
    return literal_table(spark, rows, DAILY_LOCATION)


def series(spark, values, start=D(2000, 1, 3), name="s", step=1):
    rows = [(name, start + dt.timedelta(days=i * step), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "segment string, ds date, y double")


def test_first_touch_keeps_the_first_day_and_breaks_ties_by_name(spark):
    events = spark.createDataFrame(
        [
            (1, D(2000, 1, 2), "B", "b", "x"),
            (1, D(2000, 1, 1), "B", "b", "x"),
            (1, D(2000, 1, 1), "A", "z", "y"),
            (1, D(2000, 1, 1), "A", "z", "y"),
            (2, D(1994, 12, 31), "A", "a", "x"),
            (2, D(1995, 1, 1), "A", "a", "x"),
            (3, D(2001, 6, 1), "A", "a", "x"),
        ],
        EVENTS,
    )
    got = {tuple(r) for r in src.first_touch(events, STAR_DATES).collect()}
    assert got == {(1, D(2000, 1, 1), "A", "z", "y"), (2, D(1995, 1, 1), "A", "a", "x")}


def test_both_first_touch_forms_agree(spark, folder):
    star = src.first_touch_star(spark, folder)
    flat = src.first_touch(src.tickets(spark, folder), STAR_DATES)
    assert star.exceptAll(flat).count() == 0 and flat.exceptAll(star).count() == 0


def test_exclusion_keeps_rows_without_a_country(spark):
    rows = daily(
        spark,
        [
            (D(2000, 1, 1), "ASIA", None, "o", 1),
            (D(2000, 1, 1), "ASIA", "NATION_2", "o", 2),
            (D(2000, 1, 1), "ASIA", "NATION_7", "o", 4),
            (D(2000, 1, 1), None, "NATION_7", "o", 8),
        ],
    )
    segment = next(s for s in SEGMENTS if s.name == "apac_no_china")
    kept = rows.filter(membership(segment, STAR_LABELS)).agg(F.sum("unique_tickets")).first()[0]
    assert kept == 5


def test_groups_without_key_drop_out_and_empty_sums_are_zero(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 9), ("b", None)], "k string, v long")
    assert {tuple(r) for r in reports.sum_by(rows, ["k"], "v", "v").collect()} == {("a", 3), ("b", 0)}
    assert {tuple(r) for r in reports.rows_by(rows, ["k"], "n").collect()} == {("a", 2), ("b", 1)}


def test_ties_at_the_last_rank_go_by_name(spark):
    rows = spark.createDataFrame([("r", c, 1) for c in "fedcba"] + [("r", "z", 5)], "g string, c string, v long")
    top = reports.top_per_group(rows, ["g"], "v", "c", 5).orderBy("rank").collect()
    assert [r.c for r in top] == ["z", "a", "b", "c", "d"]


def test_stacked_offsets_fill_missing_bars(spark):
    top = spark.createDataFrame(
        [("r", "Monday", "a", 2), ("r", "Monday", "b", 3), ("r", "Tuesday", "b", 4)],
        "level1 string, day_name string, level2 string, unique_tickets long",
    )
    got = {(r.day_name, r.level2): (r.unique_tickets, r.bottom) for r in reports.stacked_offsets(top).collect()}
    assert got == {
        ("Monday", "a"): (2, 0), ("Monday", "b"): (3, 2), ("Tuesday", "a"): (0, 0), ("Tuesday", "b"): (4, 0),
    }


def test_date_parts_match_pandas(spark):
    days = pd.date_range("1995-01-01", "2006-12-31")
    got = (
        spark.createDataFrame([(d.date(),) for d in days], "ds date")
        .select("ds", dates.sunday_week(F.col("ds")).alias("u"), dates.iso_weekday(F.col("ds")).alias("w"),
                dates.weekday_name(F.col("ds")).alias("n"), dates.week_end(F.col("ds")).alias("e"),
                dates.year_fraction(F.col("ds")).alias("f"))
        .orderBy("ds").toPandas()
    )
    assert (got.u.to_numpy() == days.strftime("%U").astype(int)).all()
    assert (got.w.to_numpy() == days.dayofweek + 1).all()
    assert (got.n.to_numpy() == days.day_name()).all()
    assert (pd.to_datetime(got.e).to_numpy() == days.to_period("W").end_time.normalize().to_numpy()).all()
    assert np.allclose(got.f, (days.dayofyear - 1) / np.where(days.is_leap_year, 366, 365))


def test_resampling_fills_gaps_and_keeps_the_total(spark):
    rows = [("s", D(2000, 1, 5), 1.0), ("s", D(2000, 1, 9), 2.0), ("s", D(2000, 4, 30), 4.0)]
    frame = spark.createDataFrame(rows, "segment string, ds date, y double")
    pdf = pd.Series([1.0, 2.0, 4.0], pd.DatetimeIndex([r[1] for r in rows]))
    for got, want, name in (
        (ops.weekly(frame), pdf.resample("W").sum(), "week_end"),
        (ops.monthly(frame), pdf.resample("ME").sum(), "month_end"),
    ):
        got = got.orderBy(name).toPandas()
        assert list(pd.to_datetime(got[name])) == list(want.index)
        assert list(got.y) == list(want)


@pytest.mark.parametrize("n", [12, 29, 30, 31, 75])
def test_rolling_matches_pandas(spark, n):
    y = np.random.default_rng(n).integers(0, 50, n)
    got = ops.rolling(series(spark, y)).orderBy("ds").toPandas()
    want = pd.Series(y, dtype=float).rolling(30, center=True)
    assert np.allclose(got.moving_mean.astype(float), want.mean(), equal_nan=True)
    assert np.allclose(got.moving_std.astype(float), want.std(), equal_nan=True)


def test_rows_at_count_from_zero_per_series(spark):
    both = series(spark, range(10)).unionByName(series(spark, range(4), name="t"))
    got = {(r.segment, r.position, r.y) for r in ops.rows_at(both, 3, 5).collect()}
    assert got == {("s", 3, 3.0), ("s", 4, 4.0), ("t", 3, 3.0)}


def test_peak_is_the_first_of_equals(spark):
    got = ops.peak_day(series(spark, [1, 7, 7, 2]), "segment").first()
    assert (got.peak, got.peak_ds) == (7.0, D(2000, 1, 4))


def test_override_replaces_and_adds(spark):
    base = spark.createDataFrame([("BUILDING", D(2000, 9, 11), 3.0), ("OTHER", D(2000, 9, 11), 5.0)], "series string, ds date, y double")
    got = {(r.series, r.ds): (r.y, r.overridden) for r in ops.apply_overrides(base, literal_table(spark, STAR_OVERRIDES, OVERRIDES)).collect()}
    assert got == {
        ("BUILDING", D(2000, 9, 11)): (1269.0, True),
        ("OTHER", D(2000, 9, 11)): (5.0, False),
        ("MACHINERY", D(2001, 2, 2)): (200.0, True),
    }


def test_segments_overlap_and_one_region_is_outside(spark, folder):
    rows = ops.segment_rows(src.daily_location(spark, folder))
    inside = rows.filter(F.col("segment") == "emea_no_uk").filter(F.col("level2") == STAR_LABELS.netherlands)
    assert inside.count() > 0
    exported = [s.name for s in SEGMENTS if s.exported]
    assert rows.filter(F.col("segment").isin(exported) & (F.col("level1") == STAR_LABELS.unspecified)).count() == 0


def test_days_hold_one_value_or_one_per_location(spark):
    rows = daily(
        spark,
        [
            (D(2000, 1, 1), "EUROPE", "NATION_3", "BUILDING", 2),
            (D(2000, 1, 1), "EUROPE", "NATION_8", "BUILDING", 1),
            (D(2000, 1, 1), "EUROPE", "NATION_8", "MACHINERY", 4),
        ],
    )
    got = {r.segment: r.ys for r in ops.series_days(ops.segment_rows(rows)).collect()}
    assert got["org_a_emea"] == [1.0, 2.0] and got["org_a"] == [3.0] and got["emea_no_uk"] == [5.0]


def test_export_labels_name_every_registry_field():
    labels = export_labels("one", "two")
    assert membership(SEGMENTS[-1], labels) is not None and labels.spell("org_b") == "two"


def test_ratios_and_clip(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (3.0, 4.0), (None, 1.0)], "y double, p double")
    got = rows.select(
        numbers.day_accuracy(F.col("y"), F.col("p")), numbers.relative_error(F.col("y"), F.col("p")),
        numbers.not_below_zero(F.col("y") - 2),
    ).collect()
    assert [tuple(r) for r in got] == [(None, None, 0.0), (None, 1.0, 0.0), (0.25, -1 / 3, 1.0), (None, None, None)]
