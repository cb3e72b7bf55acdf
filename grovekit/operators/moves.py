"""Rearranging a stored tree by many moves at once.

A *move* cuts out a subtree with its parent and puts it beside another node; a
*swap* exchanges two subtrees.  Moves that touch no common part of the tree don't
depend on each other's order, so a set of such moves is chosen and applied in one
pass of joins.  What a move touches (its *claims*): the paths of both its nodes
up to and with their lowest common ancestor, and the moved node's sibling and
grandparent.  With disjoint claims no node gets two parents and no cycle arises:
a cycle would need a target inside another moved subtree and the reverse, and
then one's path holds the other's node.

The choice is by priority: a move is taken if it is the best on everything it
claims (score, compared to nine decimals, then least ids), so it needs one
aggregate over claims and one join, and a repeated call takes the rest.

Trees are ``nodes(node, parent, ...)``, binary; node ids stay, as the moved
node's parent goes along and becomes the new pair's parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovekit.operators import contraction, tree
from grovekit.plans.session import checkpointed


def _around(nodes: DataFrame) -> DataFrame:
    """(node, up, sib, grand) for every node that has a sibling; grand is null below the root."""
    kin = tree.siblings(nodes).select("node", F.col("sibling").alias("sib"))
    own = nodes.select("node", F.col("parent").alias("up"))
    grand = nodes.select(F.col("node").alias("up"), F.col("parent").alias("grand"))
    return own.join(kin, "node").join(grand, "up").select("node", "up", "sib", "grand")


def claims(moves: DataFrame, nodes: DataFrame, anc: DataFrame, kin: bool = True) -> DataFrame:
    """(x, y, claim): what each of ``moves(x, y)`` touches; moves without a sense are left out.

    Left out are moves of a root, beside the node's own sibling or parent, or
    into its own subtree (with ``kin=False``, for swaps: of nodes one of which is
    within the other, or of siblings).
    """
    met = tree.lca(moves.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), anc).select(F.col("a").alias("x"), F.col("b").alias("y"), "lca", "dist_a", "dist_b")
    # a swap needs both below their common ancestor and not both right below it; a move may go beside an ancestor of its parent
    met = met.where("dist_a > 0 and dist_b > 0 and not (dist_a = 1 and dist_b = 1)") if not kin else met.where("dist_a > 0 and not (dist_a = 1 and dist_b <= 1)")
    path = lambda end, dist: met.join(anc.select(F.col("node").alias(end), F.col("ancestor").alias("claim"), "dist"), end).where(F.col("dist") <= F.col(dist)).select("x", "y", "claim")
    found = path("x", "dist_a").unionByName(path("y", "dist_b"))
    if kin:
        near = met.select("x", "y").join(_around(nodes).withColumnRenamed("node", "x"), "x")
        found = found.unionByName(near.select("x", "y", F.explode(F.array("sib", "grand")).alias("claim")).where("claim is not null"))
    return found.distinct()


def independent(moves: DataFrame, nodes: DataFrame, anc: DataFrame, kin: bool = True) -> DataFrame:
    """(x, y, score): those of ``moves(x, y, score)`` that are the best on all they claim."""
    best = moves.groupBy("x", "y").agg(F.max(F.round("score", 9)).alias("score"))
    claimed = checkpointed(claims(best, nodes, anc, kin).join(best, ["x", "y"]))
    order = F.struct((-F.col("score")).alias("down"), "x", "y")
    first = claimed.groupBy("claim").agg(F.min(order).alias("f"))
    lost = claimed.join(first, "claim").where("x <> f.x or y <> f.y").select("x", "y").distinct()
    return claimed.select("x", "y", "score").distinct().join(lost, ["x", "y"], "left_anti")


def apply_moves(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """The tree after independent ``moves(x, y)``: each x, with its parent, stands beside y."""
    placed = nodes.select(F.col("node").alias("y"), F.col("parent").alias("above"))
    known = moves.select("x", "y").join(_around(nodes).withColumnRenamed("node", "x"), "x").join(placed, "y")
    # where y hangs on x's sibling or grandparent, that parent keeps its name; where y's parent is x's own parent there is no move
    pointers = known.select(F.inline(F.array(
        F.struct(F.col("sib").alias("node"), F.col("grand").alias("to")),
        F.struct(F.col("up").alias("node"), F.col("above").alias("to")),
        F.struct(F.col("y").alias("node"), F.col("up").alias("to")),
    ))).withColumn("changed", F.lit(True))
    return _pointed(nodes, pointers)


def apply_swaps(nodes: DataFrame, swaps: DataFrame) -> DataFrame:
    """The tree after independent ``swaps(x, y)``: the subtrees x and y have exchanged places."""
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("parent").alias(f"above_{c}"))
    known = swaps.select("x", "y").join(at("x"), "x").join(at("y"), "y")
    pointers = known.select(F.inline(F.array(F.struct(F.col("x").alias("node"), F.col("above_y").alias("to")), F.struct(F.col("y").alias("node"), F.col("above_x").alias("to"))))).withColumn("changed", F.lit(True))
    return _pointed(nodes, pointers)


def _pointed(nodes: DataFrame, pointers: DataFrame) -> DataFrame:
    parent = F.when(F.col("changed"), F.col("to")).otherwise(F.col("parent"))
    return nodes.join(pointers, "node", "left").select(*[parent.cast(nodes.schema["parent"].dataType).alias(c) if c == "parent" else F.col(c) for c in nodes.columns])


def graft_round(nodes: DataFrame, points: DataFrame, pairs: DataFrame, linkage: str = "cosine") -> tuple[DataFrame, DataFrame]:
    """The tree after the independent ones of the best grafts of ``pairs(a, b)`` of leaves, and these moves (x, y, score)."""
    anc = tree.closure(nodes)
    stats = checkpointed(contraction.stats(nodes, points))
    best = tree.best_graft(tree.graft_grid(pairs, nodes, anc, stats, linkage))
    taken = checkpointed(independent(best.select("x", "y", "score"), nodes, anc))
    return apply_moves(nodes, taken), taken


def worst_cherries(nodes: DataFrame, scores: DataFrame, bound: int, order: str = "lowest") -> DataFrame:
    """(node): as many nodes of two leaves as the tree has leaves above ``bound``, those of the lowest (``highest``) score.

    Ties go to the smaller id.  They have no node in common, so all collapse at once.
    """
    found = tree.collapsible(nodes).join(scores, "node")
    over = contraction.n_leaves(nodes) - bound
    down = F.col("score") if order == "lowest" else -F.col("score")
    return found.withColumn("key", F.round(down, 9)).orderBy("key", "node").limit(max(0, over)).select("node")


def collapse(nodes: DataFrame, members: DataFrame, picked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree without the leaves below the ``picked(node)``, which become leaves, and ``members(node, id)`` with what they held."""
    up = nodes.join(picked.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.col("parent").alias("to"))
    left = nodes.join(up.select("node"), "node", "left_anti")
    moved = members.join(up, "node", "left").select(F.coalesce("to", "node").alias("node"), "id")
    return left, moved


def collapse_to(nodes: DataFrame, points: DataFrame, bound: int, linkage: str = "cosine", order: str = "lowest") -> tuple[DataFrame, DataFrame]:
    """The tree with ``bound`` leaves at most, and ``members(node, id)``: the points of ``points(node, vec)`` that each leaf stands for.

    Each round collapses the worst pairs of leaves, as many as are needed, and
    scores what has become a pair of leaves.
    """
    if bound < 1:
        raise ValueError("a tree has one leaf at least")
    members = points.select("node", F.col("node").alias("id"))
    while contraction.n_leaves(nodes) > bound:
        held = checkpointed(contraction.stats(nodes, members.join(points.withColumnRenamed("node", "id"), "id").select("node", "vec")))
        picked = checkpointed(worst_cherries(nodes, tree.node_scores(nodes, held, linkage), bound, order))
        nodes, members = (checkpointed(x) for x in collapse(nodes, members, picked))
    return nodes, members


def spots_by_priority(wanted: DataFrame, seed: int) -> DataFrame:
    """(id, spot): of the points that want a spot, the least by hash (MD5 of seed and id) gets it."""
    place = F.row_number().over(W.partitionBy("spot").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "id")), "id"))
    return wanted.withColumn("place", place).where("place = 1").select("id", "spot")
