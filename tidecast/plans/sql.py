"""Shared SQL text of the DuckDB twins: the common table expressions they start from."""

from __future__ import annotations

TICKETS = """
tickets AS (
  SELECT l_orderkey AS sr_number, CAST(l_shipdate AS DATE) AS sys_created_date,
         r_name AS level1, n_name AS level2, c_mktsegment AS organization_flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

FIRST_TOUCH = (
    TICKETS
    + """,
first_touch AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY sr_number
      ORDER BY sys_created_date, level1, level2, organization_flag) AS rn
    FROM (SELECT DISTINCT * FROM tickets
          WHERE sys_created_date >= DATE '1995-01-01' AND sys_created_date < DATE '2001-06-01'))
  WHERE rn = 1)"""
)

DAILY = (
    FIRST_TOUCH
    + """,
daily AS (
  SELECT sys_created_date, level1, level2, organization_flag, CAST(count(*) AS BIGINT) AS unique_tickets
  FROM first_touch GROUP BY ALL)"""
)

# The request export: every order counts on its day at its customer's place, same columns as ``daily``.
REQUEST_DAILY = """
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS sys_created_date, r_name AS level1, n_name AS level2, c_mktsegment AS organization_flag,
         CAST(count(*) AS BIGINT) AS unique_tickets
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '2001-06-01' GROUP BY ALL)"""

DAY_EXPORT = (
    DAILY
    + """,
day_export AS (
  SELECT dayname(sys_created_date) AS day_name, CAST(year(sys_created_date) AS INTEGER) AS created_year,
         CAST(month(sys_created_date) AS INTEGER) AS created_month, level1, level2,
         CAST(sum(unique_tickets) AS BIGINT) AS unique_tickets
  FROM daily GROUP BY ALL)"""
)

SEGMENTS = (
    DAILY
    + """,
segments(segment, level1, level2, not_level2, org) AS (VALUES
  ('emea_uk', NULL, 'NATION_3', NULL, NULL), ('north_us', NULL, 'NATION_1', NULL, NULL),
  ('north_no_us', NULL, 'NATION_6', NULL, NULL), ('apac_china', NULL, 'NATION_2', NULL, NULL),
  ('apac_no_china', 'ASIA', NULL, 'NATION_2', NULL), ('emea_no_uk', 'EUROPE', NULL, 'NATION_3', NULL),
  ('brazil', NULL, 'NATION_0', NULL, NULL), ('latam_no_brazil', 'AFRICA', NULL, 'NATION_0', NULL),
  ('netherlands', NULL, 'NATION_8', NULL, NULL), ('org_a', NULL, NULL, NULL, 'BUILDING'),
  ('org_a_apac', 'ASIA', NULL, NULL, NULL), ('org_a_emea', 'EUROPE', NULL, NULL, 'BUILDING'),
  ('org_a_latam', 'AFRICA', NULL, NULL, NULL), ('org_a_north', 'AMERICA', NULL, NULL, 'BUILDING'),
  ('org_b', NULL, NULL, NULL, 'MACHINERY'), ('org_b_emea', 'EUROPE', NULL, NULL, 'MACHINERY'),
  ('org_b_north', 'AMERICA', NULL, NULL, 'MACHINERY')),
member AS (
  SELECT s.segment, d.* FROM daily d JOIN segments s
  ON (s.level1 IS NULL OR d.level1 = s.level1) AND (s.level2 IS NULL OR d.level2 = s.level2)
  AND (s.not_level2 IS NULL OR d.level2 IS DISTINCT FROM s.not_level2)
  AND (s.org IS NULL OR d.organization_flag = s.org)),
series AS (
  SELECT segment, sys_created_date AS ds, CAST(sum(unique_tickets) AS DOUBLE) AS y
  FROM member GROUP BY ALL)"""
)

ORG_SERIES = (
    DAILY
    + """,
org_series AS (
  SELECT organization_flag AS series, sys_created_date AS ds, CAST(sum(unique_tickets) AS DOUBLE) AS y
  FROM daily GROUP BY ALL)"""
)

EXPORTED = (
    "('emea_uk', 'north_us', 'north_no_us', 'apac_china', 'apac_no_china', 'emea_no_uk', 'brazil', "
    "'latam_no_brazil', 'netherlands')"
)


def query(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{body.strip()}"


def rnd(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"
