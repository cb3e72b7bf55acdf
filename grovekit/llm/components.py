"""Connected components by alternating large-star and small-star steps, DataFrame functions only.

Each step replaces every edge by one to the least known neighbour, so the edge
table never grows, and the number of rounds is logarithmic in practice.  The
table is written to the shared folder after each round, which cuts lineage and
survives lost executors.  A hub is never gathered: minima are aggregated before
the shuffle, and the join back on the hub is one whose skew Spark splits, or
one with broadcast minima while edges are few.  The rounds end when every edge
leads to a least node: no further round is run to see that nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm import scratch
from grovekit.llm.dealing import FEW, listed


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(listed(least, few), "u").where("v > u and v <> m").select(F.col("m").alias("u"), "v")


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Here u < v on every edge: each v sends its smaller neighbours to the least of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(listed(least, few), "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("m").alias("u"), "v"))


def _state(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether they are stars: each v has one u, which is no v."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("below")).unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("below")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    seen = nodes.agg(F.sum("below").alias("n"), F.bool_or(F.expr("below > 1 or below = 1 and least = 0")).alias("more")).first()
    return seen["n"] or 0, not seen["more"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the least node.

    Nulls and loops are ignored.  The ids may be of any ordered type.
    """
    return stored_components(edges, max_rounds)[0]


def stored_components(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, str]:
    """``components`` with the path of the working table that it is read from."""
    spark = edges.sparkSession
    start = edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    now, path = scratch.settle(start, "edges")
    for _ in range(max_rounds):
        n, stars = _state(now)
        if stars:
            break
        after, new_path = scratch.settle(_small_star(_large_star(now, n <= FEW), n <= FEW).distinct(), "edges")
        scratch.drop(spark, path)
        now, path = after, new_path
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
    return found, path
