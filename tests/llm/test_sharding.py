from __future__ import annotations

import duckdb
import pytest

from tests import oracle
from tests.llm import cases
from tidecast.llm import queries, sharding


def test_sql_twin(spark, folder):
    tables = oracle.connect(folder)
    assert oracle.compare(spark, tables, folder, "op5", queries.op5_shard_placement, sharding.ORACLE_PLACE) is None


def test_table_is_even_and_stable():
    names = sharding.shard_names(12)
    table = sharding.lookup_table(names, 1009)
    sizes = [table.count(s) for s in range(12)]
    assert max(sizes) - min(sizes) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 11)
    assert moved < 0.25 * 1009
    for bad in ((names, 1000), (["a", "a"], 1009), ([], 7), (names, 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_tricky_rows(spark, tmp_path):
    docs = cases.tricky(spark)
    placed = sharding.place(docs, 4, 409)
    assert placed.count() == docs.count() and set(placed.columns) == set(docs.columns)
    table = sharding.lookup_table(sharding.shard_names(4), 409)
    for row in placed.collect():
        key = "" if row["doc_id"] is None else str(row["doc_id"])
        assert row["slot"] == sharding._number(key) % 409 and row["shard"] == table[row["slot"]]
    assert sharding.place(cases.empty(docs)).count() == 0
    path = str(tmp_path / "out")
    sharding.write_shards(docs, path, 4, 409, tasks_per_shard=2)
    assert spark.read.parquet(path).count() == docs.count()
    assert duckdb.sql(f"SELECT count(*) FROM read_parquet('{path}/*/*.parquet')").fetchall()[0][0] == docs.count()
