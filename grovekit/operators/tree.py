"""Trees as tables ``nodes(node, parent, label)``; the root's parent is null.

Ancestor relations are one table, ``closure``, built by pointer doubling: the
number of joins is logarithmic in the height, and every (node, ancestor) pair is
made once.  What needs a walk elsewhere is a join with it here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovekit.functions import vectors as V
from grovekit.plans.session import checkpointed

#: Positions of a vector that are summed as columns.
WIDE = 256
NODES = T.StructType([T.StructField("node", T.LongType()), T.StructField("parent", T.LongType()), T.StructField("label", T.StringType())])


def closure(nodes: DataFrame, strict: bool = False) -> DataFrame:
    """(node, ancestor, dist): every node with itself (unless ``strict``) and its ancestors."""
    jump = nodes.where("parent is not null").select("node", F.col("parent").alias("ancestor"))
    known = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("dist"))
    step = 1
    while True:
        # each round is materialised once: the next reads it twice, and the plan stays as deep as one round
        jump = checkpointed(jump)
        if jump.isEmpty():
            break
        far = known.select(F.col("node").alias("mid"), F.col("ancestor").alias("top"), "dist")
        known = checkpointed(known.unionByName(jump.join(far, jump["ancestor"] == far["mid"]).select("node", F.col("top").alias("ancestor"), (F.col("dist") + step).alias("dist"))))
        again = jump.select(F.col("node").alias("mid"), F.col("ancestor").alias("top"))
        jump = jump.join(again, jump["ancestor"] == again["mid"]).select("node", F.col("top").alias("ancestor"))
        step *= 2
    return known.where("dist > 0") if strict else known


def with_leaf_flag(nodes: DataFrame) -> DataFrame:
    parents = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct().withColumn("__inner", F.lit(True))
    return nodes.join(parents, "node", "left").withColumn("is_leaf", F.col("__inner").isNull()).drop("__inner")


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent").alias("node")), "node", "left_anti")


def root(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent is null")


def siblings(nodes: DataFrame) -> DataFrame:
    """(node, sibling)."""
    other = nodes.select("parent", F.col("node").alias("sibling"))
    return nodes.select("node", "parent").join(other, "parent").where("node <> sibling").select("node", "sibling")


def aunts(nodes: DataFrame) -> DataFrame:
    """(node, aunt): the siblings of the node's parent."""
    of_parent = siblings(nodes).select(F.col("node").alias("parent"), F.col("sibling").alias("aunt"))
    return nodes.select("node", "parent").join(of_parent, "parent").select("node", "aunt")


def lca(pairs: DataFrame, anc: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with their lowest common ancestor and its distance to each."""
    one = anc.select(F.col("node").alias("a"), "ancestor", F.col("dist").alias("dist_a"))
    two = anc.select(F.col("node").alias("b"), "ancestor", F.col("dist").alias("dist_b"))
    met = pairs.select("a", "b").join(one, "a").join(two, ["b", "ancestor"])
    best = met.groupBy("a", "b").agg(F.min(F.struct("dist_a", "ancestor", "dist_b")).alias("m"))
    return best.select("a", "b", F.col("m.ancestor").alias("lca"), F.col("m.dist_a").alias("dist_a"), F.col("m.dist_b").alias("dist_b"))


def descendants(anc: DataFrame, node: int) -> DataFrame:
    return anc.where(F.col("ancestor") == node).select("node", "dist")


def height(anc: DataFrame) -> DataFrame:
    return anc.agg(F.max("dist").alias("height"))


def class_counts(anc: DataFrame, leaf_labels: DataFrame) -> DataFrame:
    """(node, label, n): labelled leaves below each node, by class."""
    named = leaf_labels.where("label is not null").select("node", "label")
    return anc.join(named, "node").groupBy(F.col("ancestor").alias("node"), "label").agg(F.count("*").alias("n"))


def collapsible(nodes: DataFrame) -> DataFrame:
    """(node): the inner nodes all of whose children are leaves."""
    kids = with_leaf_flag(nodes).where("parent is not null").groupBy(F.col("parent").alias("node"))
    return kids.agg(F.every("is_leaf").alias("flat")).where("flat").select("node")


def leaf_counts(anc: DataFrame, leaf_nodes: DataFrame) -> DataFrame:
    return anc.join(leaf_nodes.select("node"), "node", "left_semi").groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_leaves"))


def stats(anc: DataFrame, points: DataFrame) -> DataFrame:
    """(node, n, sum, sumsq) of the leaf vectors ``points(node, vec)`` below each node.

    Sums are partial aggregates, one row for each node and task, so a node may
    have any number of leaves.  Vectors of up to ``WIDE`` positions are summed as
    that many columns, longer ones by position.
    """
    vec = points.select("node", V.wide("vec").alias("vec"))
    widest = points.agg(F.max(F.size("vec"))).first()[0] or 0
    if widest <= WIDE:
        sums = [F.sum(F.col("vec")[i]) for i in range(widest)]
        found = anc.join(vec, "node").groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n"), F.array(*sums).cast("array<double>").alias("sum"), F.sum(V.dot(F.col("vec"), F.col("vec"))).alias("sumsq"))
        return found.select("node", "n", "sum", "sumsq")
    size = anc.join(vec.select("node", V.dot(F.col("vec"), F.col("vec")).alias("sq")), "node").groupBy("ancestor").agg(F.count("*").alias("n"), F.sum("sq").alias("sumsq"))
    parts = anc.join(vec.select("node", F.posexplode("vec").alias("pos", "x")), "node").groupBy("ancestor", "pos").agg(F.sum("x").alias("x"))
    sums = parts.groupBy("ancestor").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("sum"))
    return size.join(sums, "ancestor").select(F.col("ancestor").alias("node"), "n", "sum", "sumsq")


def link(linkage: str, a: dict[str, Column], b: dict[str, Column], centroid: str = "l2", similarity: str = "dot") -> Column:
    """Linkage of two clusters with columns n, sum and sumsq: ``average``, ``cosine`` or ``centroid`` (of a kind and similarity)."""
    if linkage == "average":
        return V.average_link(a["n"], a["sum"], a["sumsq"], b["n"], b["sum"], b["sumsq"])
    if linkage == "cosine":
        return V.cosine_link(a["sum"], b["sum"])
    if linkage == "centroid":
        return V.centroid_link(a["n"], a["sum"], b["n"], b["sum"], centroid, similarity)
    raise ValueError(f"unknown linkage {linkage!r}")


def node_scores(nodes: DataFrame, node_stats: DataFrame, linkage: str = "average", centroid: str = "l2", similarity: str = "dot") -> DataFrame:
    """(node, score): the linkage of a binary node's two children."""
    kids = nodes.where("parent is not null").join(node_stats, "node")
    pair = kids.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("node", "n", "sum", "sumsq"))).alias("k")).where(F.size("k") == 2)
    a, b = ({c: F.col("k")[i][c] for c in ("n", "sum", "sumsq")} for i in (0, 1))
    return pair.select(F.col("parent").alias("node"), link(linkage, a, b, centroid, similarity).alias("score"))


def graft_grid(pairs: DataFrame, nodes: DataFrame, anc: DataFrame, node_stats: DataFrame, linkage: str = "cosine", centroid: str = "l2", similarity: str = "dot") -> DataFrame:
    """(a, b, x, y, score, x_likes, y_likes) for pairs(a, b) of leaves: the cells of their paths below the common ancestor.

    x lies on a's path and y on b's; a side likes the cell if its link is above
    the score of the side's parent.  Scores are compared to nine decimals.
    """
    scores = node_scores(nodes, node_stats, linkage, centroid, similarity).select(F.col("node").alias("parent"), F.round("score", 9).alias("held"))
    own = node_stats.join(nodes.select("node", "parent"), "node").join(scores, "parent")
    side = lambda c: own.select(F.col("node").alias(c), *[F.col(s).alias(f"{c}_{s}") for s in ("n", "sum", "sumsq", "held")])
    grid = paths_below_lca(pairs, anc).join(side("x"), "x").join(side("y"), "y")
    a, b = ({s: F.col(f"{c}_{s}") for s in ("n", "sum", "sumsq")} for c in "xy")
    scored = grid.withColumn("score", link(linkage, a, b, centroid, similarity))
    likes = lambda c: F.round("score", 9) > F.col(f"{c}_held")
    return scored.select("a", "b", "x", "y", "score", likes("x").alias("x_likes"), likes("y").alias("y_likes"))


def best_graft(grid: DataFrame) -> DataFrame:
    """(a, b, x, y, score): each pair's cell of the highest link that both sides like, ties to the least x, then y; pairs without one are left out."""
    both = grid.where("x_likes and y_likes").groupBy("a", "b").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "x", "y", "score")).alias("m"))
    return both.select("a", "b", "m.x", "m.y", "m.score")


def swap(nodes: DataFrame, a: int, b: int) -> DataFrame:
    """Exchanges the places of two subtrees, neither within the other."""
    parents = {r["node"]: r["parent"] for r in nodes.where(F.col("node").isin(a, b)).collect()}  # two rows
    moved = F.when(F.col("node") == a, F.lit(parents[b])).when(F.col("node") == b, F.lit(parents[a])).otherwise(F.col("parent"))
    return nodes.withColumn("parent", moved.cast(nodes.schema["parent"].dataType))


def make_sibling(nodes: DataFrame, node: int, moved: int, new_parent: int) -> DataFrame:
    """Puts ``moved`` beside ``node`` under ``new_parent``; moved's old sibling takes its old parent's place."""
    rows = {r["node"]: r for r in nodes.where((F.col("node") == node) | (F.col("node") == moved)).collect()}  # two rows
    old = rows[moved]["parent"]
    out = nodes
    if old is not None:
        grand = nodes.where(F.col("node") == old).first()["parent"]
        out = out.withColumn("parent", F.when((F.col("parent") == old) & (F.col("node") != moved), F.lit(grand)).otherwise(F.col("parent"))).where(F.col("node") != old)
    above = out.where(F.col("node") == node).first()["parent"]
    out = out.withColumn("parent", F.when(F.col("node").isin(node, moved), F.lit(new_parent)).otherwise(F.col("parent")))
    made = nodes.sparkSession.createDataFrame([(new_parent, above, None)], "node long, parent long, label string")
    return out.unionByName(made.select(*[F.col(c).cast(nodes.schema[c].dataType) for c in nodes.columns]))


def problems(nodes: DataFrame) -> DataFrame:
    """(problem, node): what keeps the table from being one binary tree; empty if nothing does."""
    named = lambda df, what, c="node": df.select(F.lit(what).alias("problem"), F.col(c).alias("node"))
    twice = nodes.groupBy("node").count().where("count > 1")
    lost = nodes.where("parent is not null").join(nodes.select(F.col("node").alias("parent")), "parent", "left_anti")
    odd = nodes.where("parent is not null").groupBy("parent").count().where("count <> 2")
    roots = root(nodes).agg(F.count("*").alias("n")).where("n <> 1").select(F.lit(None).cast("long").alias("node"))
    return named(twice, "repeated").unionByName(named(lost, "unknown parent")).unionByName(named(odd, "not two children", "parent")).unionByName(named(roots, "not one root"))


def paths_below_lca(pair: DataFrame, anc: DataFrame) -> DataFrame:
    """(a, b, x, y) for pairs(a, b): x on a's path and y on b's, both strictly below the pair's LCA."""
    met = lca(pair, anc)
    xs = anc.select(F.col("node").alias("a"), F.col("ancestor").alias("x"), F.col("dist").alias("dx"))
    ys = anc.select(F.col("node").alias("b"), F.col("ancestor").alias("y"), F.col("dist").alias("dy"))
    return met.join(xs, "a").where("dx < dist_a").join(ys, "b").where("dy < dist_b").select("a", "b", "x", "y")


def label_of_pairs(column: Column) -> Column:
    """``none`` and ``null`` in any case are no label."""
    return F.when(F.lower(column).isin("none", "null"), F.lit(None)).otherwise(column)
