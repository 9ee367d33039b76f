from __future__ import annotations

import duckdb
import numpy as np

from tests import oracle
from tests.llm import cases
from tidecast.llm import queries, urls

SCHEMA = "page_id bigint, url string, html string, host string, path string, rule string, verdict string, by_rule string"


def graph(spark):
    rows = [
        (1, "http://good.example.net/en/1", '<a href="http://mid.org/x">a</a> <A class=x HREF=//Far.org>'),
        (2, "http://mid.org/1", '<a href="https://spam.example.net/q"> <a href="/rel"> <a href="http://mid.org/own">'),
        (3, "http://spam.example.net/fr/1", '<a href="http://other.info/">'),
        (4, "http://linker.org/a", "<a href='http://spam.example.net/x'>"), (5, None, None), (6, "no scheme", "x"),
        (7, "http://other.info", ""), (8, "HTTP://Far.ORG/fr/x?q#z", ""), (9, "x://net?/", ""), (7, "http://other.info", ""),
        (None, "http://www.example.com/de/?a", "<a href=http://linker.org>"), (10, "http://notexample.com/de/", ""),
        (11, "http://u:p@Example.NET:80/en/", ""), (12, "http://\n/", None),
    ]
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def test_sql_twin(spark, folder):
    tables = oracle.connect(folder)
    assert oracle.compare(spark, tables, folder, "op7", queries.op7_url_filter, urls.ORACLE_JUDGE) is None


def test_sql_twin_with_links(spark):
    pages = graph(spark)
    con = duckdb.connect()
    local = pages.toPandas()
    con.register("pages", local)
    want = con.sql(urls.ORACLE_JUDGE).fetchall()
    found = [(*r[:5], round(r[5], 4), round(r[6], 4)) for r in map(tuple, urls.judge(pages).collect())]
    plain = [tuple(None if v != v else v for v in r) for r in want]
    assert sorted(found, key=str) == sorted(((None if r[0] is None else int(r[0]), *r[1:]) for r in plain), key=str)
    verdict = {r[0]: (r[1], r[2], r[3], r[4]) for r in found}
    assert verdict[4][3] == "block" and verdict[7][3] == "allow"
    assert verdict[9] == ("net", "", None, "allow") and verdict[11] == ("u:p@example.net:80", "/en/", None, "allow")
    assert verdict[None][2:] == ("example.com/de/", "block") and verdict[10][2] is None and verdict[5] == ("", "", None, "allow")


def test_propagation_solves_the_linear_system(spark):
    rng = np.random.default_rng(0)
    links = [(f"h{a}", f"h{b}", int(n)) for a, b, n in rng.integers(0, 12, (40, 3)) + np.array([0, 0, 1]) if a != b]
    seeds = {"h0": 1.0, "h3": 2.0}
    merged = {}
    for a, b, n in links:
        merged[a, b] = merged.get((a, b), 0) + n
    names = sorted({h for pair in merged for h in pair} | set(seeds))
    shares = np.zeros((len(names), len(names)))
    for (a, b), n in merged.items():
        shares[names.index(b), names.index(a)] = n / sum(m for (x, _), m in merged.items() if x == a)
    want = np.linalg.solve(np.eye(len(names)) - 0.85 * shares, [seeds.get(n, 0.0) for n in names])
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in merged.items()], "source string, target string, n bigint")
    start = spark.createDataFrame(list(seeds.items()), "host string, seed double")
    found = {r["host"]: r["value"] for r in urls.propagate(frame, start, tolerance=1e-10).collect()}
    assert all(abs(found.get(n, 0.0) - w) < 1e-8 for n, w in zip(names, want))


def test_no_rows(spark):
    assert urls.judge(graph(spark).limit(0)).count() == 0
    assert cases.as_rows(urls.judge(graph(spark)).select("page_id")) == cases.as_rows(graph(spark).select("page_id"))


def test_no_python_in_the_plan(spark, folder):
    plan = queries.op7_url_filter(spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
