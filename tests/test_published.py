from __future__ import annotations

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from tidecast.plans import scoring
from tidecast.sources import published
from tidecast.sources.schemas import SEGMENT_RESULT

DAY = dt.date(2000, 1, 1)


def rows(spark, **values):
    made = [(DAY + dt.timedelta(days=i), float(i), v / 3, 0.5, name) for name, v in values.items() for i in range(3)]
    return spark.createDataFrame(made, SEGMENT_RESULT)


def content(spark, root, version=None):
    return sorted(map(tuple, published.read(spark, root, SEGMENT_RESULT, "segment", version).collect()))


def as_rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_version_is_read_as_it_was_written(spark, tmp_path):
    root = str(tmp_path / "r")
    assert content(spark, root) == [] and published.versions(spark, root) == []
    made = rows(spark, **{"a": 1, "b b": 2, "c+/%é=": 1e-300})
    assert published.write(made, root, "segment") == 1
    assert content(spark, root) == as_rows(made)


def test_single_segments_are_replaced_and_old_versions_stay(spark, tmp_path):
    root = str(tmp_path / "r")
    first = rows(spark, a=1, b=2)
    published.write(first, root, "segment")
    folders = published.manifest(spark, root)
    assert published.write(rows(spark, b=5, c=6), root, "segment", replace=True) == 2
    assert content(spark, root) == as_rows(rows(spark, a=1, b=5, c=6))
    assert published.manifest(spark, root)["a"] == folders["a"]
    assert content(spark, root, 1) == as_rows(first)
    assert published.write(rows(spark, d=1), root, "segment") == 3
    assert content(spark, root) == as_rows(rows(spark, d=1))
    with pytest.raises(FileNotFoundError):
        published.read(spark, root, SEGMENT_RESULT, "segment", 9)


def test_an_aborted_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "r")
    published.write(rows(spark, a=1), root, "segment")
    broken = rows(spark, a=2, b=3).withColumn("y", F.when(F.col("segment") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("y")))
    with pytest.raises(Exception, match="lost"):
        published.write(broken, root, "segment")
    assert published.versions(spark, root) == [1] and content(spark, root) == as_rows(rows(spark, a=1))
    with pytest.raises(ValueError, match="without a value"):
        published.write(rows(spark, a=2).withColumn("segment", F.lit(None).cast("string")), root, "segment")
    assert content(spark, root) == as_rows(rows(spark, a=1))


def test_of_two_writers_one_fails(spark, tmp_path):
    root = str(tmp_path / "r")
    published.write(rows(spark, a=1), root, "segment")
    published.write(rows(spark, a=2), root, "segment", based_on=1)
    with pytest.raises(published.StaleVersion):
        published.write(rows(spark, a=3), root, "segment", based_on=1)
    with pytest.raises(published.StaleVersion):
        published._publish(spark, root, 2, {})
    assert content(spark, root) == as_rows(rows(spark, a=2))
    assert not list(pathlib.Path(root).glob("_waiting-*"))


def test_forgotten_versions_take_only_their_own_folders(spark, tmp_path):
    root = str(tmp_path / "r")
    published.write(rows(spark, a=1, b=2), root, "segment")
    published.write(rows(spark, b=5), root, "segment", replace=True)
    old = published.manifest(spark, root, 1)
    assert published.forget(spark, root, 1) == [1] and published.versions(spark, root) == [2]
    assert content(spark, root) == as_rows(rows(spark, a=1, b=5))
    assert (tmp_path / "r" / old["a"]).exists() and not (tmp_path / "r" / old["b"]).exists()


def test_reconciliation_reads_the_files(spark, tmp_path):
    root = str(tmp_path / "r")
    daily = spark.createDataFrame([(DAY, "x", "y", "z", 10)], "sys_created_date date, level1 string, level2 string, organization_flag string, unique_tickets long")
    scoring.publish_segments(rows(spark, a=6, b=9), root)
    assert scoring.reconcile_published(spark, daily, root).first().predictions == 5.0
    scoring.publish_segments(rows(spark, b=3), root)
    assert scoring.reconcile_published(spark, daily, root).first().predictions == 3.0
    assert scoring.reconcile_published(spark, daily, root, 1).first().predictions == 5.0
