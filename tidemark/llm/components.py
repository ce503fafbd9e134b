"""Connected components by alternating stars, as aggregations and joins.

Every node learns the least node that it can reach.  A hub is never gathered:
its neighbours' minimum is a partial aggregate, and the join that hands it out
is one that the planner can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialize


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (u, v) that isn't the least of its component; both are longs, self loops are ignored."""
    now = materialize(edges.filter("u != v").select("u", "v").distinct(), "cc")
    mark = _mark(now)
    while True:
        after = materialize(_small(_large(now)), "cc")
        new = _mark(after)
        delete(now)
        now = after
        if new == mark:
            out = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
            out._tables = now._tables
            return out
        mark = new
