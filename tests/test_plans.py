"""Shape of the physical plans, skewed input, files and the shared folder."""

from __future__ import annotations

import datetime as dt
import types

import pytest
from pyspark.sql import functions as F

from tidecast import session
from tidecast.operators import series as ops
from tidecast.plans import catalog
from tidecast.sources import files
from tidecast.sources import tickets as src
from tidecast.sources.registry import SEGMENTS, STAR_DATES, STAR_LABELS
from tidecast.sources.schemas import DAILY_LOCATION, SEGMENT_RESULT


def plan_of(df, explain="formatted"):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(explain))


def test_date_bounds_and_columns_reach_the_scan(spark, folder):
    plan = plan_of(src.daily_org(spark, folder))
    assert "GreaterThanOrEqual(l_shipdate,1995-01-01T00:00)" in plan and "LessThan(l_shipdate,2001-06-01T00:00)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize(
    "name", ["first_touch_daily", "first_touch_events", "segment_series", "weekly_resample", "rolling_30_mean", "top5_per_day"]
)
def test_no_single_task_exchange(spark, folder, name):
    assert "SinglePartition" not in plan_of(catalog.QUERIES[name](spark, folder), "simple")


def test_raw_events_are_combined_before_the_shuffle(spark, folder):
    plan = plan_of(src.first_touch_star(spark, folder), "simple")
    assert "partial_min(created_at" in plan


def test_top_lists_are_cut_before_the_shuffle(spark, folder):
    plan = plan_of(catalog.QUERIES["top5_per_day"](spark, folder), "simple")
    assert plan.count("WindowGroupLimit") == 2


def test_membership_needs_no_shuffle(spark):
    rows = files.literal_table(spark, [(dt.date(2000, 1, 1), "ASIA", "NATION_2", "BUILDING", 3)], DAILY_LOCATION)
    marked = ops.segment_rows(rows)
    assert "Exchange" not in plan_of(marked, "simple")
    assert {r.segment for r in marked.collect()} == {"apac_china", "org_a", "org_a_apac"}


def test_one_ticket_may_hold_most_events(spark):
    """A hot ticket, far beyond a third of the rows, still counts once and loses nothing else."""
    n = 30_000
    hot = spark.range(n, numPartitions=8).select(
        F.lit(-1).cast("long").alias("sr_number"),
        F.date_add(F.lit(dt.date(1996, 1, 1)), (F.col("id") % 700).cast("int")).alias("sys_created_date"),
    )
    others = spark.range(5_000).select(
        F.col("id").alias("sr_number"),
        F.date_add(F.lit(dt.date(1997, 1, 1)), (F.col("id") % 100).cast("int")).alias("sys_created_date"),
    )
    events = hot.unionByName(others).select(
        "*", F.lit("ASIA").alias("level1"), F.lit("NATION_2").alias("level2"), F.lit("BUILDING").alias("organization_flag")
    )
    touched = src.first_touch(events, STAR_DATES)
    assert touched.count() == 5_001
    assert touched.filter("sr_number = -1").first().sys_created_date == dt.date(1996, 1, 1)
    assert src.count_by_day(touched, src.LOCATION).agg(F.sum("unique_tickets")).first()[0] == 5_001


def test_segment_files_round_trip_with_one_folder_per_segment(spark):
    rows = files.literal_table(
        spark,
        [(dt.date(2000, 1, d), 1.0 * d, 2.0 * d, 0.5, s) for d in (1, 2, 3) for s in ("x", "y")],
        SEGMENT_RESULT,
    )
    path = files.write_csv(rows, session.new_output_dir(spark, "test"), ["segment"])
    back = files.read_csv(spark, path, SEGMENT_RESULT)
    assert back.dtypes == rows.dtypes
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    scan = plan_of(back.filter("segment = 'x'"))
    assert "PartitionFilters: [isnotnull(segment" in scan


def test_settled_frames_keep_rows_and_types(spark):
    frame = spark.createDataFrame([("a", [1.0, 2.0], dt.date(2000, 1, 1)), ("b", [], None)], "k string, v array<double>, d date")
    kept = session.settle(frame)
    assert kept.dtypes == frame.dtypes and {str(r) for r in kept.collect()} == {str(r) for r in frame.collect()}


def fake_session(master, named=None):
    context = types.SimpleNamespace(
        master=master, getConf=lambda: {"spark.checkpoint.dir": named} if named else {}, getCheckpointDir=lambda: None,
        setCheckpointDir=lambda d: None,
    )
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d=None: d))


def test_shared_folder_comes_from_the_cluster():
    assert session.shared_dir(fake_session("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        session.shared_dir(fake_session("yarn"))


def test_registry_covers_every_template_copy():
    assert len(SEGMENTS) == 17 and sum(s.exported for s in SEGMENTS) == 9
    assert sum(s.trials == 500 for s in SEGMENTS) == 10 and sum(s.trials == 100 for s in SEGMENTS) == 5
    assert all(getattr(STAR_LABELS, field) for field in ("apac", "unspecified", "org_a", "org_b"))


def test_flat_first_touch_is_a_hash_aggregate(spark, folder):
    plan = plan_of(src.first_touch(src.tickets(spark, folder), STAR_DATES), "simple")
    assert "SortAggregate" not in plan and "min(packed" in plan
