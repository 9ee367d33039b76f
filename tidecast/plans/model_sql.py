"""DuckDB twin of the decomposable model: regressors, normal equations and elimination in SQL.

The text is put together from small pieces because a fit is a chain of solves. ``gid`` names a
segment and cutoff, ``sid`` a setting of it. The lasso over the trend changes is followed event by event until the
path has come down to the setting's penalty.
"""

from __future__ import annotations

from tidecast.plans.modelling import COUNTRY_OF, HOLIDAYS, OBSERVED
from tidecast.sources.registry import SEGMENTS

BAND = "CAST(1.2815515655446004 AS DOUBLE)"

TUNED = "(VALUES " + ", ".join(
    f"('{s.name}', CAST({s.cps} AS DOUBLE), CAST({s.sps} AS DOUBLE), '{s.mode}')" for s in SEGMENTS
) + ") t(segment, cps, sps, mode)"

_WAVES = ", ".join(
    f"{f}(2 * pi() * {k} * (CAST(ds - DATE '1970-01-01' AS DOUBLE) / {length}))"
    for order, length in ((3, "7"), (10, "CAST(365.25 AS DOUBLE)"))
    for k in range(1, order + 1)
    for f in ("sin", "cos")
)


def _eliminate(name: str, key: str) -> str:
    """Gauss-Jordan elimination of the augmented matrices whose lines ``{name}_m`` holds.

    Step k clears the first column with line k and drops it, so the last column is what remains.
    """
    return f""",
{name}_steps AS (
  SELECT {key}, i, len(line) - 1 AS n, 1 AS k, line FROM {name}_m
  UNION ALL
  SELECT s.{key}, s.i, s.n, s.k + 1, CASE WHEN s.i = s.k THEN p
      ELSE list_transform(s.line[2:], lambda v, j: v - s.line[1] * p[j]) END
  FROM {name}_steps s JOIN (SELECT {key}, list_transform(line[2:], lambda v: v / line[1]) AS p FROM {name}_steps WHERE i = k) u
    ON u.{key} = s.{key} WHERE s.k <= s.n),
{name} AS MATERIALIZED (SELECT {key}, list(line[1] ORDER BY i) AS b FROM {name}_steps WHERE k = n + 1 GROUP BY {key})"""


def _products(name: str, rows: str, key: str, x: str, weight: str, target: str) -> str:
    """Both triangles of X'WX and the moments as last column, in long form, with the jitter."""
    return f""",
{name}_half AS MATERIALIZED (
  SELECT {key}, i, j, any_value(pairs.size) AS size, sum({weight} * {x}[i] * {x}[j]) AS v
  FROM {rows} JOIN pairs ON pairs.size = len({x}) GROUP BY {key}, i, j),
{name}_moment AS (
  SELECT {key}, i, any_value(pairs.size) + 1 AS j, any_value(pairs.size) AS size, sum({target} * {x}[i]) AS v
  FROM {rows} JOIN pairs ON pairs.size = len({x}) AND i = j GROUP BY {key}, i),
{name}_all AS (
  SELECT {key}, i, j, size, v FROM {name}_half UNION ALL SELECT {key}, j, i, size, v FROM {name}_half WHERE i < j
  UNION ALL SELECT {key}, i, j, size, v FROM {name}_moment),
{name} AS MATERIALIZED (
  SELECT c.*, d.jitter FROM {name}_all c
  JOIN (SELECT {key}, avg(v) * 1e-10 AS jitter FROM {name}_half WHERE i = j GROUP BY {key}) d USING ({key}))"""


_SEASON_BOTH = (
    "CASE WHEN i <= q + 26 THEN variance / (sps * sps) ELSE variance / 100 END"
)
_SEASON_ONLY = (
    "CASE WHEN i <= 26 THEN variance / (sps * sps) ELSE variance / 100 END"
)


def model(
    groups: str, params: str, frame: str, holidays: bool = True, modes=("additive", "multiplicative"), cutoffs: str = ""
) -> str:
    """All expressions up to ``predicted`` and ``scored``.

    ``groups``: gid, segment, cutoff, country. ``params``: sid, gid, param_id, cps, sps, mode.
    ``frame``: gid, ds to forecast. ``observed`` and the holiday rules are part of the result;
    ``cutoffs`` is text that defines the table of that name when ``groups`` reads it.
    """
    flags = (
        "list_transform(all_names, lambda h: CASE WHEN list_contains(coalesce(day_names, CAST([] AS VARCHAR[])), h) "
        "THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
        if holidays
        else "CAST([] AS DOUBLE[])"
    )
    text = f"""
groups AS MATERIALIZED ({groups}),
params AS MATERIALIZED ({params}),
pairs AS MATERIALIZED (SELECT size, i, j FROM range(1, 80) s(size), range(1, 80) a(i), range(1, 80) b(j) WHERE i <= j AND j <= size),
country_names AS (SELECT country, list_sort(list(DISTINCT holiday)) AS all_names FROM rules GROUP BY country),
country_days AS (SELECT country, ds, list(DISTINCT holiday) AS day_names FROM holidays GROUP BY ALL),
per_day AS (SELECT segment, ds, count(*) AS n, sum(y) AS sy, sum(y * y) AS sq, max(abs(y)) AS my FROM observed GROUP BY ALL),
train AS MATERIALIZED (SELECT gid, ds, CAST(n AS DOUBLE) AS n, sy, sq, my FROM per_day JOIN groups USING (segment) WHERE ds <= cutoff),
span AS MATERIALIZED (SELECT gid, min(ds) AS lo, greatest(max(ds) - min(ds), 1) AS days, sum(n) AS n_rows, max(my) AS scale,
           sum(sq) / (max(my) * max(my)) AS squares FROM train GROUP BY gid HAVING sum(n) >= 2),
numbered AS (SELECT segment, ds, row_number() OVER (PARTITION BY segment ORDER BY ds) - 1 AS row FROM observed),
head AS (SELECT gid, CAST(floor(n_rows * CAST(0.8 AS DOUBLE)) AS BIGINT) AS head FROM span),
wanted AS (SELECT gid, CAST(round_even(CAST(i * (head - 1) AS DOUBLE) / n, 0) AS BIGINT) AS row
           FROM (SELECT gid, head, least(25, head - 1) AS n, unnest(range(1, least(25, head - 1) + 1)) AS i FROM head)),
points AS (SELECT gid, list_sort(list(DISTINCT ds)) AS points FROM wanted JOIN groups USING (gid) JOIN numbered USING (segment, row) GROUP BY gid),
frame AS ({frame}),
dates AS (SELECT gid, ds FROM train UNION SELECT gid, ds FROM frame),
placed AS (SELECT d.gid, d.ds, country, CAST(d.ds - lo AS DOUBLE) / days AS t,
             list_transform(coalesce(points, CAST([] AS DATE[])), lambda p: CAST(p - lo AS DOUBLE) / days) AS points
           FROM dates d JOIN groups USING (gid) JOIN span USING (gid) LEFT JOIN points USING (gid)),
features AS MATERIALIZED (
  SELECT gid, p.ds, list_concat([CAST(1 AS DOUBLE), t], list_transform(points, lambda s: greatest(t - s, CAST(0 AS DOUBLE)))) AS tx,
    list_concat([{_WAVES.replace('ds -', 'p.ds -')}], {flags}) AS sx
  FROM placed p JOIN country_names USING (country) LEFT JOIN country_days c ON c.country = p.country AND c.ds = p.ds),
fitting AS MATERIALIZED (
  SELECT gid, ds, n, sy / n / scale AS y, tx, sx, list_concat(tx, sx) AS x FROM train JOIN features USING (gid, ds) JOIN span USING (gid))"""
    text += _products("joint", "fitting", "gid", "x", "n", "n * y")
    text += """,
free_cells AS (
  SELECT gid, i, j, v, jitter0 AS jitter FROM joint
  JOIN (SELECT gid, avg(v) * 1e-10 AS jitter0 FROM joint WHERE i = j AND i <= 2 GROUP BY gid) USING (gid)
  WHERE i <= 2 AND (j <= 2 OR j = size + 1))"""
    text += """,
free_m AS MATERIALIZED (
  SELECT gid, i, list(v + CASE WHEN i = j THEN jitter ELSE 0.0 END ORDER BY j) AS line
  FROM free_cells GROUP BY gid, i)""" + _eliminate("free", "gid")
    text += """,
noise AS MATERIALIZED (
  SELECT gid, greatest((any_value(squares) - 2 * sum(CASE WHEN j = size + 1 THEN b[i] * v ELSE 0 END)
      + sum(CASE WHEN j <= len(b) THEN b[i] * b[j] * v ELSE 0 END)) / greatest(any_value(n_rows) - any_value(len(b)), 1),
    CAST(1e-8 AS DOUBLE)) AS variance
  FROM joint JOIN free USING (gid) JOIN span USING (gid) WHERE i <= len(b) AND (j <= len(b) OR j = size + 1) GROUP BY gid),
settings AS MATERIALIZED (
  SELECT sid, gid, param_id, mode, cps, sps, variance, (SELECT 2 + coalesce(len(points), 0) FROM span s LEFT JOIN points USING (gid) WHERE s.gid = p.gid) AS q
  FROM params p JOIN noise USING (gid))"""
    results = []
    if "additive" in modes:
        text += """,
add_cells AS (SELECT sid, i, j, size, v, jitter FROM joint JOIN settings USING (gid) WHERE mode = 'additive')"""
        text += _penalised("add", _SEASON_BOTH)
        results.append(
            "SELECT sid, gid, param_id, mode, b[1:q] AS a, b[q + 1:len(b)] AS b FROM add JOIN settings USING (sid)"
        )
    if "multiplicative" in modes:
        text += """,
mul0 AS MATERIALIZED (SELECT sid, ds, n, y, tx, sx, CAST(1 AS DOUBLE) AS f FROM fitting JOIN settings USING (gid) WHERE mode = 'multiplicative')"""
        for turn in (1, 2):
            rows = f"mul{turn - 1}"
            text += _products(f"level{turn}_p", rows, "sid", "tx", "n * f * f", "n * y * f")
            text += f",\nlevel{turn}_cells AS (SELECT sid, i, j, size, v, jitter FROM level{turn}_p)"
            text += _penalised(f"level{turn}", "0.0")
            text += f""",
swing{turn}_rows AS MATERIALIZED (SELECT sid, n, y, sx, list_inner_product(b, tx) AS g FROM {rows} JOIN level{turn} USING (sid))"""
            text += _products(f"swing{turn}_p", f"swing{turn}_rows", "sid", "sx", "n * g * g", "n * g * (y - g)")
            text += _one(f"swing{turn}", f"swing{turn}_p", _SEASON_ONLY)
            text += f""",
mul{turn} AS MATERIALIZED (SELECT sid, ds, n, y, tx, sx, 1 + list_inner_product(b, sx) AS f FROM {rows} JOIN swing{turn} USING (sid))"""
        results.append(
            "SELECT sid, gid, param_id, mode, l.b AS a, s.b AS b FROM level2 l JOIN swing2 s USING (sid) JOIN settings USING (sid)"
        )
    text += f""",
coefficients AS MATERIALIZED ({' UNION ALL '.join(results)}),
fitted AS (SELECT sid, n, y, CASE WHEN mode = 'multiplicative' THEN list_inner_product(a, tx) * (1 + list_inner_product(b, sx))
             ELSE list_inner_product(a, tx) + list_inner_product(b, sx) END AS fit FROM fitting JOIN coefficients USING (gid)),
spread AS (SELECT sid, sum(-2 * n * y * fit + n * fit * fit) AS s FROM fitted GROUP BY sid),
fits AS MATERIALIZED (
  SELECT c.*, segment, cutoff, scale, sqrt(greatest((squares + s) / n_rows, CAST(1e-8 AS DOUBLE))) * scale AS sigma,
    list_transform(a, lambda v: v * scale) AS trend_beta,
    list_transform(b, lambda v: CASE WHEN mode = 'multiplicative' THEN v ELSE v * scale END) AS season_beta
  FROM coefficients c JOIN spread USING (sid) JOIN span USING (gid) JOIN groups USING (gid)),
parts AS (SELECT segment, cutoff, param_id, ds, mode, sigma, list_inner_product(trend_beta, tx) AS trend,
            list_inner_product(season_beta[1:6], sx[1:6]) AS weekly, list_inner_product(season_beta[7:26], sx[7:26]) AS yearly,
            CASE WHEN len(sx) > 26 THEN list_inner_product(season_beta[27:len(sx)], sx[27:len(sx)]) ELSE 0.0 END AS holidays
          FROM fits JOIN frame USING (gid) JOIN features USING (gid, ds)),
predicted AS MATERIALIZED (SELECT *, CASE WHEN mode = 'multiplicative' THEN trend * (1 + weekly + yearly + holidays)
                ELSE trend + weekly + yearly + holidays END AS yhat FROM parts)"""
    return OBSERVED + cutoffs + "," + HOLIDAYS + "," + text


def _one(name: str, cells: str, penalty: str) -> str:
    """One penalised solve per setting."""
    return f""",
{name}_m AS MATERIALIZED (
  SELECT sid, i, list(v + CASE WHEN i = j THEN {penalty} + jitter ELSE 0.0 END ORDER BY j) AS line
  FROM {cells} JOIN settings USING (sid) GROUP BY sid, i)""" + _eliminate(name, "sid")


def _moved(x: str) -> str:
    """Places with the trend changes after all others; the moments stay last."""
    return f"CASE WHEN {x} <= 2 OR {x} > size THEN {x} WHEN {x} > q THEN {x} - q + 2 ELSE size - q + {x} END"


def _penalised(name: str, season: str) -> str:
    """The exact solution for the cells ``{name}_cells`` and the settings' penalties.

    Elimination stops when only the trend changes are left: their lines are a lasso, the others say how
    the rest follows from them. ``{name}_path`` holds a table, signs and the penalty reached; each step finds the next event, the
    largest penalty below at which a change enters (its line is the correlation) or leaves (its line is the value), and
    pivots on it.
    """
    return f""",
{name}_m AS MATERIALIZED (
  SELECT sid, row_at AS i, any_value(size) - any_value(q) + 2 AS f, list(v ORDER BY column_at) AS line FROM (
    SELECT sid, size, q, {_moved('i')} AS row_at, {_moved('j')} AS column_at,
      v + CASE WHEN i = j THEN (CASE WHEN i <= q THEN 0.0 ELSE {season} END) + jitter ELSE 0.0 END AS v
    FROM {name}_cells JOIN settings USING (sid)) GROUP BY sid, row_at),
{name}_steps AS (
  SELECT sid, i, f, 1 AS k, line FROM {name}_m
  UNION ALL
  SELECT s.sid, s.i, s.f, s.k + 1, CASE WHEN s.i = s.k THEN p
      ELSE list_transform(s.line[2:], lambda v, j: v - s.line[1] * p[j]) END
  FROM {name}_steps s JOIN (SELECT sid, list_transform(line[2:], lambda v: v / line[1]) AS p FROM {name}_steps WHERE i = k) u
    ON u.sid = s.sid WHERE s.k <= s.f),
{name}_left AS MATERIALIZED (SELECT sid, i, f, line FROM {name}_steps WHERE k = f + 1),
{name}_path AS (
  SELECT sid, any_value(variance) / any_value(cps) AS lam, list(line ORDER BY i) AS m, list(CAST(0 AS DOUBLE)) AS s,
    CAST(1e300 AS DOUBLE) AS here, CAST(0 AS BIGINT) AS last, CAST(0 AS DOUBLE) AS side, CAST(NULL AS DOUBLE[]) AS d
  FROM {name}_left JOIN settings USING (sid) WHERE i > f GROUP BY sid
  UNION ALL
  SELECT sid, lam, CASE WHEN stop THEN m ELSE list_transform(m, lambda r, i: CASE
        WHEN i = j THEN list_transform(r, lambda v, c: CASE WHEN c = j THEN 1 ELSE v END / m[j][j])
        ELSE list_transform(r, lambda v, c: CASE WHEN c = j THEN -v / m[j][j] ELSE v - r[j] * (m[j][c] / m[j][j]) END) END) END,
    list_transform(s, lambda v, k: CASE WHEN k <> j THEN v WHEN v <> 0 THEN 0 WHEN a[j] > there * b[j] THEN 1 ELSE -1 END),
    there, j, s[j], CASE WHEN stop THEN list_transform(s, lambda v, k: CASE WHEN v <> 0 THEN a[k] - lam * b[k] ELSE 0 END) END
  FROM (SELECT *, coalesce(lam > there, true) AS stop, list_position(events, best) AS j FROM (
    SELECT *, list_max(events) AS best, least(list_max(events), here) AS there FROM (
      SELECT *, list_transform(s, lambda v, k: list_max(list_filter([
          CASE WHEN k = last AND side >= 0 THEN NULL WHEN v <> 0 THEN a[k] / nullif(b[k], 0) ELSE a[k] / nullif(1 + b[k], 0) END,
          CASE WHEN v <> 0 OR k = last AND side < 0 THEN NULL ELSE a[k] / nullif(b[k] - 1, 0) END],
        lambda e: e > 0 AND e <= here * (1 + CAST(1e-9 AS DOUBLE))))) AS events FROM (
        SELECT *, list_transform(m, lambda r: r[len(r)]) AS a, list_transform(m, lambda r: list_inner_product(r[1:len(r) - 1], s)) AS b
        FROM {name}_path WHERE d IS NULL))))),
{name}_changes AS MATERIALIZED (SELECT sid, d FROM {name}_path WHERE d IS NOT NULL),
{name} AS MATERIALIZED (
  SELECT sid, list(v ORDER BY place) AS b FROM (
    SELECT sid, CASE WHEN i <= 2 THEN i ELSE i + len(line) - 1 END AS place,
      line[len(line)] - coalesce(list_inner_product(line[1:len(line) - 1], d), 0) AS v
    FROM {name}_left LEFT JOIN {name}_changes USING (sid) WHERE i <= f
    UNION ALL SELECT sid, 2 + unnest(range(1, len(d) + 1)), unnest(d) FROM {name}_changes) GROUP BY sid)"""


WHOLE_GROUPS = f"""SELECT segment AS gid, segment, cutoff, country FROM (SELECT segment, max(ds) AS cutoff FROM observed GROUP BY 1)
  JOIN {COUNTRY_OF} USING (segment)"""
WHOLE_PARAMS = f"SELECT gid AS sid, gid, 0 AS param_id, cps, sps, mode FROM groups JOIN {TUNED} USING (segment)"
FUTURE = """SELECT gid, ds FROM train UNION ALL
  SELECT gid, CAST(cutoff + CAST(i AS INTEGER) AS DATE) FROM groups, range(1, 181) r(i)"""


def whole() -> str:
    """Fit on the whole history with each segment's own setting, 180 days ahead."""
    return model(WHOLE_GROUPS, WHOLE_PARAMS, FUTURE)
