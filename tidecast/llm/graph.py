"""Connected components of a graph that is given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.session import discard, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.where("v > u").join(least, "u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.count_distinct("u")
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node that has an edge; root is the smallest node of its component.

    ``edges`` has two BIGINT columns ``u`` and ``v``. Loops, repeated edges and edges in both
    directions are fine; edges with a NULL end are ignored; without edges the result is empty. The
    method is that of alternating large and small stars (Kiveris et al., 2014): after a number of
    rounds that is logarithmic in practice every component is a star around its smallest node. Each
    round is a written table, so that a lost executor costs a part of one round. The joins of a hub
    are inner joins against one row per node, which the adaptive skew join can split.
    """
    start = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = settle(start.where("u != v").distinct())
    seen = _digest(current)
    while seen[0]:
        following = settle(_small_star(_large_star(current)))
        discard(current)
        current, last, seen = following, seen, _digest(following)
        if seen == last:
            break
    roots = current.groupBy("v").agg(F.count("*").alias("n")).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
