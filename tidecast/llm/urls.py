"""URL filters by link-graph propagation. DataFrame functions only.

Rules decide the pages whose host and path they fit. For the others the host decides: trust starts at the
hosts that the rules mostly allow and follows the links (personalised PageRank); distrust starts at the hosts
that the rules mostly block and follows the links backwards, as who links to bad hosts is suspect. A host
is blocked when its distrust is larger than its trust by the margin. Both vectors are solved without
normalising: a seed has at least 1, and what a host without outgoing links would pass on is left out, which
changes a personalised PageRank by a common factor only.

Links are counted per pair of hosts before anything is shuffled further, so a host with a third of all pages
is one row per partner. Every round is a written table; rounds go on until no value moves by more than
TOLERANCE, which damping guarantees.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.session import discard, settle

#: (rule, verdict): a rule is a host and, from its first slash on, a beginning of the path.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
DAMPING, TOLERANCE, MARGIN = 0.85, 1e-6, 0.0

_FROM, _TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _FROM, _TO)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, NULL if none does. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def judged_by_rules(pages: DataFrame, rules: Iterable[tuple[str, str]], page_id: str, url: str) -> DataFrame:
    named = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), list(rules))
    return named.withColumns({"rule": rule, "by_rule": verdict})


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (source, target, n): links between different hosts. Relative links stay in their host and do not count."""
    own = host_of(F.col(url))
    hrefs = F.regexp_extract_all(
        F.coalesce(F.col(html), F.lit("")),
        F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), 1,
    )
    found = pages.select(own.alias("source"), F.explode(hrefs).alias("href"))
    target = host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href")))
    pairs = found.select("source", target.alias("target")).where("source != target and source != '' and target != ''")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows (host, value): value = seed + damping * sum over links to the host of value(source) * share of the link.

    ``links`` has (source, target, n), ``seeds`` one row (host, seed) per seed. The shares of a source sum to 1, so the sum
    of all changes shrinks by the damping in every round.
    """
    totals = links.groupBy("source").agg(F.sum("n").alias("total"))
    shares = settle(links.join(totals, "source").select("source", "target", (F.col("n") / F.col("total")).alias("share")))
    current = settle(seeds.select("host", F.col("seed").cast("double").alias("value")))
    moved = 1.0
    while moved > tolerance:
        passed = shares.join(current.withColumnRenamed("host", "source"), "source").groupBy(F.col("target").alias("host")).agg(
            (damping * F.sum(F.col("share") * F.col("value"))).alias("passed")
        )
        both = seeds.select("host", "seed").join(passed, "host", "full").join(
            current.withColumnRenamed("value", "before"), "host", "left"
        )
        value = F.coalesce(F.col("seed"), F.lit(0.0)) + F.coalesce(F.col("passed"), F.lit(0.0))
        following = settle(both.select("host", value.alias("value"), F.coalesce("before", F.lit(0.0)).alias("before")))
        moved = following.agg(F.sum(F.abs(F.col("value") - F.col("before")))).first()[0] or 0.0
        discard(current)
        current = following.select("host", "value")
        current.settled_path = following.settled_path
    discard(shares)
    return current


def host_verdicts(judged: DataFrame, links: DataFrame, margin: float = MARGIN, damping: float = DAMPING) -> DataFrame:
    """Rows (host, trust, distrust, host_verdict) for all hosts with trust or distrust."""
    allow, block = F.col("by_rule") == "allow", F.col("by_rule") == "block"
    counted = settle(judged.where("host != ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(allow).alias("allowed"), F.count_if(block).alias("blocked")
    ))
    links = settle(links)
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")
    trusted = counted.where("2 * allowed > n").select("host", F.lit(1.0).alias("seed"))
    blocked = counted.where("2 * blocked > n").select("host", F.lit(1.0).alias("seed"))
    trust = propagate(links, trusted, damping).withColumnRenamed("value", "trust")
    distrust = propagate(back, blocked, damping).withColumnRenamed("value", "distrust")
    both = trust.join(distrust, "host", "full").select(
        "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
    verdict = F.when(F.col("distrust") > F.col("trust") + margin, "block").otherwise("allow")
    return both.withColumn("host_verdict", verdict)


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url",
          html: str = "html", margin: float = MARGIN, damping: float = DAMPING) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    ``verdict`` is that of the longest rule that fits, else the host's; a host that neither trust nor
    distrust reaches, and a NULL url or one without ``://``, is allowed. Repeated rows give repeated rows.
    """
    judged = judged_by_rules(pages, rules, page_id, url)
    hosts = settle(host_verdicts(judged, host_links(pages, url, html), margin, damping))
    return judged.join(hosts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


#: The same in DuckDB; as many rounds as bring the change below the tolerance.
ORACLE_JUDGE = f"""
WITH RECURSIVE split AS (
  SELECT page_id, html,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_FROM}', '{_TO}') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), rules(rule, domain, start, verdict) AS (
  VALUES {", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES)}
), judged AS (
  SELECT s.*, (
    SELECT max_by({{'rule': rule, 'verdict': verdict}}, length(rule)) FROM rules
    WHERE (s.host = domain OR ends_with(s.host, '.' || domain)) AND starts_with(s.path, start)
  ) AS hit FROM split s
), found AS (
  SELECT host AS source, unnest(regexp_extract_all(coalesce(html, ''),
    '<a\\b[^>]*?\\bhref\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1, 'si')) AS href FROM split
), links AS (
  SELECT source, target, count(*) AS n FROM (
    SELECT source, translate(regexp_extract(href, '^.*?//([^/?#]*)', 1), '{_FROM}', '{_TO}') AS target FROM found
  ) WHERE source <> target AND source <> '' AND target <> '' GROUP BY ALL
), counted AS (
  SELECT host, count(*) AS n, count(*) FILTER (hit.verdict = 'allow') AS a, count(*) FILTER (hit.verdict = 'block') AS b
  FROM judged WHERE host <> '' GROUP BY host
), hops AS (
  SELECT 'trust' AS kind, source, target, n / sum(n) OVER (PARTITION BY source) AS share FROM links
  UNION ALL
  SELECT 'distrust', target, source, n / sum(n) OVER (PARTITION BY target) FROM links
), seeds AS (
  SELECT 'trust' AS kind, host, 1.0::DOUBLE AS value FROM counted WHERE 2 * a > n
  UNION ALL
  SELECT 'distrust', host, 1.0::DOUBLE FROM counted WHERE 2 * b > n
), walk AS (
  SELECT 0 AS round, kind, host, value FROM seeds
  UNION ALL
  SELECT w.round + 1, h.kind, h.target, {DAMPING} * sum(w.value * h.share)
  FROM walk w JOIN hops h ON h.kind = w.kind AND h.source = w.host WHERE w.round < 150
  GROUP BY w.round, h.kind, h.target
), sums AS (
  SELECT host, coalesce(sum(value) FILTER (kind = 'trust'), 0) AS trust,
    coalesce(sum(value) FILTER (kind = 'distrust'), 0) AS distrust
  FROM walk GROUP BY host
)
SELECT page_id, host, path, hit.rule AS rule,
  coalesce(hit.verdict, CASE WHEN distrust > trust + {MARGIN} THEN 'block' END, 'allow') AS verdict,
  round(coalesce(trust, 0), 4) AS trust, round(coalesce(distrust, 0), 4) AS distrust
FROM judged LEFT JOIN sums USING (host)
"""
