from __future__ import annotations

import pytest
from pyspark.sql import types as T

from tidecast.sources import files

SCHEMA = T.StructType([T.StructField("ds", T.DateType()), T.StructField("n", T.LongType()), T.StructField("name", T.StringType())])


def write(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_good_files_are_read_by_both(spark, tmp_path):
    path = write(tmp_path, a="ds,n,name\n2000-01-01,1,x\n2000-01-02,,\n", b="ds,n,name\n2000-01-03,3,\"a,b\"\n")
    rows = sorted(map(tuple, files.read_csv(spark, path, SCHEMA).collect()))
    good, bad = files.scan_csv(spark, path, SCHEMA)
    assert len(rows) == 3 and sorted(map(tuple, good.collect())) == rows and good.schema == SCHEMA
    assert bad.count() == 0 and bad.columns == ["file", "bad_line"]


@pytest.mark.parametrize("header", ["n,ds,name", "ds,n", "ds,n,name,more", "ds,n,nome"])
def test_other_headers_are_errors(spark, tmp_path, header):
    line = ",".join(["2000-01-01", "1", "x", "y"][: header.count(",") + 1])
    path = write(tmp_path, good="ds,n,name\n2000-01-01,1,x\n", other=f"{header}\n{line}\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, path, SCHEMA).collect()
    with pytest.raises(Exception, match="(?i)header"):
        files.scan_csv(spark, path, SCHEMA)[0].collect()


def test_bad_lines_are_kept_apart_and_counted(spark, tmp_path):
    bad_lines = ["bad,2,x", "2000-01-05,xx,y", "2000-01-06,1", "2000-01-07,1,x,more"]
    path = write(tmp_path, a="ds,n,name\n2000-01-01,1,x\n" + "\n".join(bad_lines[:2]) + "\n", b="ds,n,name\n" + "\n".join(bad_lines[2:]) + "\n2000-01-02,2,y\n")
    good, bad = files.scan_csv(spark, path, SCHEMA)
    assert sorted(r["n"] for r in good.collect()) == [1, 2]
    found = bad.collect()
    assert sorted(r["bad_line"] for r in found) == sorted(bad_lines)
    assert {r["file"].rsplit("/", 1)[1] for r in found} == {"a.csv", "b.csv"}
    # a query that needs one column only sees the same lines as good
    assert good.select("name").count() == good.count() == 2 and bad.count() == 4
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, path, SCHEMA).collect()
