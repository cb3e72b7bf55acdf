"""Insertion of whole batches into a stored tree, by rounds of joins; no task holds the tree.

In a round every point that waits finds its spot as one-at-a-time insertion
does: its nearest leaf, and from there up while the parent's two children are
nearer to each other than the point is to the node reached (*rotate*).  Points
with different spots don't hinder each other: of those that want one spot the
least by hash gets it, all winners are spliced in with one join, and the others
look again in the tree that results.  As a spot's winner adds two more, the
rounds are logarithmic in the batch.  A batch of one is a plain insertion.

With ``graft`` each round ends in one bulk round of grafts (see ``moves``) of the
new leaves with their nearest neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.functions import vectors as V
from grovekit.operators import contraction, graph, knn, moves, tree
from grovekit.plans.session import checkpointed


def _nearest_leaf(waiting: DataFrame, leaves: DataFrame, linkage: str, options: graph.SearchOptions | None) -> DataFrame:
    """(id, spot): by the linkage of single points; with ``options`` by graph search, else exactly."""
    similarity = {"cosine": "cosine", "average": "negative_sql2"}[linkage]
    points = leaves.select(F.col("node").alias("id"), "vec")
    if options is None:
        found = knn.exact(waiting, points, 1, similarity)
    else:
        links = checkpointed(graph.navigable(graph.descend(points, options), points, options.max_degree, options.similarity))
        found = graph.beam(waiting, points, links, 1, options)
    return found.select(F.col("query").alias("id"), F.col("neighbour").alias("spot"))


def spots(nodes: DataFrame, leaves: DataFrame, waiting: DataFrame, linkage: str = "cosine", rotate: bool = True, options: graph.SearchOptions | None = None, seed: int = 3) -> DataFrame:
    """(id, spot): where each of ``waiting(id, vec)`` is to be joined to the tree over ``leaves(node, vec)``.

    All points climb together, a level in each step, until none has to go on.
    Links and scores are compared to nine decimals.
    """
    at = _nearest_leaf(waiting, leaves, linkage, options)
    if not rotate:
        return at
    stats = checkpointed(contraction.stats(nodes, leaves))
    held = tree.node_scores(nodes, stats, linkage).select(F.col("node").alias("up"), "score")
    table = checkpointed(stats.join(nodes.select("node", F.col("parent").alias("up")), "node").join(held, "up").select(F.col("node").alias("spot"), "up", "n", "sum", "sumsq", "score"))
    vec = waiting.select("id", V.wide("vec").alias("vec"))
    done, walk = None, checkpointed(at.withColumn("on", F.lit(True)))
    while True:
        seen = walk.where("on").join(table, "spot", "left").join(vec, "id")
        one, node = {"n": F.lit(1), "sum": F.col("vec"), "sumsq": V.dot(F.col("vec"), F.col("vec"))}, {c: F.col(c) for c in ("n", "sum", "sumsq")}
        climbs = F.coalesce(F.round(tree.link(linkage, one, node), 9) < F.round("score", 9), F.lit(False))
        step = checkpointed(seen.select("id", F.when(climbs, F.col("up")).otherwise(F.col("spot")).alias("spot"), climbs.alias("on")))
        stay = step.where("not on").select("id", "spot")
        done = stay if done is None else done.unionByName(stay)
        walk = step
        if not walk.where("on").limit(1).count():
            return done


def splice(nodes: DataFrame, won: DataFrame, stride: int) -> DataFrame:
    """The tree with each of ``won(id, spot)`` beside its spot, under a new node ``id + stride``."""
    above = nodes.select(F.col("node").alias("spot"), F.col("parent").alias("above"))
    made = won.join(above, "spot")
    fresh = F.col("id") + F.lit(stride)
    pointers = won.select(F.col("spot").alias("node"), fresh.alias("to"))
    kept = nodes.select("node", "parent").join(pointers, "node", "left").select("node", F.coalesce("to", "parent").alias("parent"))
    return kept.unionByName(made.select(F.inline(F.array(F.struct(F.col("id").alias("node"), fresh.alias("parent")), F.struct(fresh.alias("node"), F.col("above").alias("parent"))))))


def insert(
    nodes: DataFrame, leaves: DataFrame, arrived: DataFrame, stride: int, linkage: str = "cosine", rotate: bool = True, graft: bool = False,
    options: graph.SearchOptions | None = None, seed: int = 3, max_rounds: int = 200,
) -> DataFrame:
    """``nodes(node, parent)`` with all of ``arrived(id, vec)`` inserted.

    ``leaves(node, vec)`` are the tree's; new leaves keep their id, which is not
    yet a node, and inner nodes are called ``id + stride``: choose a stride above
    all ids.  An empty tree begins with the arrived point of the least hash.
    """
    if linkage not in ("cosine", "average"):
        raise ValueError(f"unknown linkage {linkage!r}")
    nodes = nodes.select("node", "parent")
    leaves = leaves.select("node", V.wide("vec").alias("vec"))
    waiting = checkpointed(arrived.select("id", V.wide("vec").alias("vec")))
    if not nodes.limit(1).count():
        first = waiting.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "id")), "id").limit(1)
        nodes = checkpointed(first.select(F.col("id").cast("long").alias("node"), F.lit(None).cast("long").alias("parent")))
        leaves = checkpointed(leaves.unionByName(first.select(F.col("id").alias("node"), "vec")))
        waiting = checkpointed(waiting.join(first.select("id"), "id", "left_anti"))
    for _ in range(max_rounds):
        if not waiting.limit(1).count():
            return nodes
        won = checkpointed(moves.spots_by_priority(spots(nodes, leaves, waiting, linkage, rotate, options), seed))
        nodes = checkpointed(splice(nodes, won, stride))
        leaves = checkpointed(leaves.unionByName(waiting.join(won.select("id"), "id").select(F.col("id").alias("node"), "vec")))
        waiting = checkpointed(waiting.join(won.select("id"), "id", "left_anti"))
        if graft:
            new = leaves.join(won.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("node").alias("id"), "vec")
            near = knn.exact(new, leaves.select(F.col("node").alias("id"), "vec"), 2, {"cosine": "cosine", "average": "negative_sql2"}[linkage])
            nodes = checkpointed(moves.graft_round(nodes, leaves, near.select(F.col("query").alias("a"), F.col("neighbour").alias("b")), linkage)[0])
    raise RuntimeError(f"points were left after {max_rounds} rounds")
