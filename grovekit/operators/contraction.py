"""Roll-ups and ancestors of trees of any shape, without the table of all (node, ancestor) pairs.

``rollup`` gives every node the total of the values below it by contraction.  A
round *rakes* the leaves into their parents and, where many nodes have a single
child left, *compresses* their chains by pointer doubling; what was compressed is
filled in afterwards, last round first.  After a rake without long chains at
least three eighths of the nodes are gone, so the rounds are logarithmic in the
number of nodes, for a chain as for a star, and each handles what is left: about
``2 * n`` rows in all, where the closure has ``n * height``.

``jumps`` is a table of each node's ancestors at distances 1, 2, 4, ..., with
which ``lca`` finds common ancestors in a logarithmic number of joins.

Nodes are ``nodes(node, parent)``; roots' parents are null, and there may be
several.  A parent that isn't a node counts as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.functions import vectors as V
from grovekit.operators import tree
from grovekit.plans.session import checkpointed

#: Chains are compressed when more than one node in so many has a single child.
CHAINED = 8
#: How two values and a column of them are combined; greatest and least pass over nulls, as sums do once nulls are zeros.
_FOLD = {"sum": (lambda a, b: a + b, F.sum), "max": (F.greatest, F.max), "min": (F.least, F.min)}


def rollup(nodes: DataFrame, values: DataFrame, how: str = "sum") -> DataFrame:
    """(node, value columns): the sum (``max``, ``min``) of ``values(node, ...)`` over each node and all below it.

    The columns are numbers, of which nulls count nothing; a node with no value
    of a column at or below it has null.  Rows that repeat a node count each.
    """
    plus, fold = _FOLD[how]
    names = [c for c in values.columns if c != "node"]
    given = values.groupBy("node").agg(*[fold(c).alias(c) for c in names])
    if how == "sum":  # nulls are zeros on the way, and where all were null is counted beside
        blank = [c for c in names if values.schema[c].nullable]
        given = given.select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], F.lit(1).cast("long").alias("_rows"), *[F.col(c).isNotNull().cast("long").alias(f"_rows_{c}") for c in blank])
        total = _rolled(nodes, given, given.columns[1:], plus, fold, 0)
        held = lambda c: F.col(f"_rows_{c}") if c in blank else F.col("_rows")
        return total.select("node", *[F.when(held(c) > 0, F.col(c)).alias(c) for c in names])
    return _rolled(nodes, given, names, plus, fold, None)


def _rolled(nodes: DataFrame, given: DataFrame, names: list[str], plus, fold, nothing) -> DataFrame:
    edges = _edges(nodes)
    kids = edges.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("open"))
    none = {c: F.lit(nothing).cast(given.schema[c].dataType) for c in names}
    live = edges.join(given, "node", "left").join(kids, "node", "left").select("node", "parent", F.coalesce("open", F.lit(0)).alias("open"), *[F.coalesce(c, none[c]).alias(c) for c in names])
    live = checkpointed(live)
    done, cut, owing = [], [], []  # finished totals; (node, below, value columns) of chain nodes by round; columns owed to the parent for chain nodes cut out between
    while True:
        size = live.agg(F.count("*").alias("n"), F.count(F.when((F.col("open") == 1) & F.col("parent").isNotNull(), 1)).alias("chained")).first()
        if not size["n"]:
            break
        if size["chained"] * CHAINED > size["n"]:
            if not owing:
                owing = [f"off_{c}" for c in names]
                live = live.select("*", *[none[c].alias(f"off_{c}") for c in names])
            live, spliced = _compress(live, names, plus)
            cut.append(spliced)
        leaf = live.where("open = 0")
        done.append(leaf.select("node", *names))
        due = {c: plus(F.col(c), F.col(f"off_{c}")) if owing else F.col(c) for c in names}
        paid = leaf.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("gone"), *[fold(due[c]).alias(f"in_{c}") for c in names])
        rest = live.where("open > 0").join(paid, "node", "left")
        live = checkpointed(rest.select("node", "parent", (F.col("open") - F.coalesce("gone", F.lit(0))).alias("open"), *[plus(F.col(c), F.coalesce(f"in_{c}", none[c])).alias(c) for c in names], *owing))
    out = done[0] if done else edges.join(given, "node").select("node", *names)
    for part in done[1:]:
        out = out.unionByName(part)
    for spliced in reversed(cut):  # what stands at a chain's end was finished later
        end = out.select(F.col("node").alias("below"), *[F.col(c).alias(f"at_{c}") for c in names])
        filled = checkpointed(spliced.join(end, "below").select("node", *[plus(F.col(c), F.col(f"at_{c}")).alias(c) for c in names]))
        out = out.unionByName(filled)
    return out


def _compress(live: DataFrame, names: list[str], plus) -> tuple[DataFrame, DataFrame]:
    """Live nodes without those of a single child, and these with the node below their chain and what the chain adds to it."""
    alone = live.where("open = 1 and parent is not null").select("node", "parent", *names, *[f"off_{c}" for c in names])
    below = live.select(F.col("parent").alias("node"), F.col("node").alias("below"), *[F.col(f"off_{c}").alias(f"owed_{c}") for c in names])
    # a chain node's total is that of ``below`` and what was collected on the way down
    walk = checkpointed(alone.join(below, "node").select("node", "parent", "below", *[plus(F.col(c), F.col(f"owed_{c}")).alias(c) for c in names], *[F.col(f"off_{c}").alias(f"own_off_{c}") for c in names]))
    top = walk.select("node", "parent", *[f"own_off_{c}" for c in names])
    while True:
        onward = walk.select(F.col("node").alias("below"), F.col("below").alias("further"), *[F.col(c).alias(f"more_{c}") for c in names], *[F.col(f"own_off_{c}").alias(f"step_{c}") for c in names])
        joined = walk.join(onward, "below", "left")
        moves = F.col("further").isNotNull()
        jumped = checkpointed(joined.select("node", "parent", F.coalesce("further", "below").alias("below"), *[F.when(moves, plus(F.col(c), F.col(f"more_{c}"))).otherwise(F.col(c)).alias(c) for c in names], *[f"own_off_{c}" for c in names], moves.alias("moved")))
        walk = jumped.drop("moved")
        if not jumped.where("moved").limit(1).count():
            break
    # the node below each chain hangs on the parent of the chain's top, and owes what the whole chain collected
    tops = walk.join(top.select(F.col("node").alias("parent")), "parent", "left_anti")
    over = tops.select(F.col("below").alias("node"), F.col("parent").alias("up"), *[plus(F.col(c), F.col(f"own_off_{c}")).alias(f"due_{c}") for c in names])
    left = live.where("not (open = 1 and parent is not null)").join(over, "node", "left")
    hung = F.col("up").isNotNull()
    rest = left.select("node", F.when(hung, F.col("up")).otherwise(F.col("parent")).alias("parent"), "open", *names, *[F.when(hung, F.col(f"due_{c}")).otherwise(F.col(f"off_{c}")).alias(f"off_{c}") for c in names])
    return checkpointed(rest), walk.select("node", "below", *names)


def n_leaves(nodes: DataFrame) -> int:
    return nodes.count() - nodes.where("parent is not null").select("parent").distinct().count()


def leaf_counts(nodes: DataFrame) -> DataFrame:
    """(node, n_leaves)."""
    return rollup(nodes, tree.leaves(nodes).select("node", F.lit(1).cast("long").alias("n_leaves")))


def stats(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(node, n, sum, sumsq) of the leaf vectors ``points(node, vec)`` below each node that has any."""
    vec = points.select("node", V.wide("vec").alias("vec"))
    widest = points.agg(F.max(F.size("vec"))).first()[0] or 0
    cells = [F.col("vec")[i] for i in range(widest)]
    zero = F.lit(0.0)
    parts = vec.where("vec is not null").select("node", F.lit(1).cast("long").alias("n"), F.coalesce(V.dot(F.col("vec"), F.col("vec")), zero).alias("sumsq"), *[F.coalesce(c, zero).alias(f"x{i}") for i, c in enumerate(cells)])
    total = rollup(nodes, parts).where("n > 0")
    return total.select("node", "n", F.array(*[f"x{i}" for i in range(widest)]).cast("array<double>").alias("sum"), "sumsq")


def class_counts(nodes: DataFrame, leaf_labels: DataFrame) -> DataFrame:
    """(node, label, n): labelled leaves below each node, by class.

    Up to ``tree.WIDE`` labels are rolled up as columns; more of them as rows of
    the closure.
    """
    named = leaf_labels.where("label is not null").select("node", "label")
    labels = [r[0] for r in named.select("label").distinct().limit(tree.WIDE + 1).collect()]
    if len(labels) > tree.WIDE:
        return tree.class_counts(tree.closure(nodes), leaf_labels)
    if not labels:
        return named.select("node", "label", F.lit(0).cast("long").alias("n"))
    counts = named.groupBy("node").agg(*[F.count(F.when(F.col("label") == x, 1)).alias(f"c{i}") for i, x in enumerate(labels)])
    cells = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"c{i}").alias("n")) for i, x in enumerate(labels)])
    return rollup(nodes, counts).select("node", F.inline(cells)).where("n > 0")


def depths(nodes: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(node, depth): edges up to the root, by pointer doubling; ``steps`` is a table of ``jumps`` that is there already."""
    if steps is not None:
        return _depths_from(nodes, steps)
    known = checkpointed(_edges(nodes).select("node", F.col("parent").alias("at"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while known.where("at is not null").limit(1).count():
        on = known.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"))
        known = checkpointed(known.join(on, "at", "left").select("node", F.col("further").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return known.select("node", "depth")


def heights(nodes: DataFrame) -> DataFrame:
    """(node, height): the longest way down to a leaf."""
    deep = depths(nodes)
    lowest = rollup(nodes, deep.select("node", F.col("depth").alias("low")), "max")
    return lowest.join(deep, "node").select("node", (F.col("low") - F.col("depth")).alias("height"))


def _edges(nodes: DataFrame) -> DataFrame:
    real = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("real"))
    return nodes.select("node", "parent").join(real, "parent", "left").select("node", F.when(F.col("real"), F.col("parent")).alias("parent"))


def jumps(nodes: DataFrame) -> DataFrame:
    """(node, level, ancestor): the ancestor at distance ``2 ** level``, where there is one."""
    step = checkpointed(_edges(nodes).where("parent is not null").select("node", F.col("parent").alias("ancestor")))
    made, level = step.withColumn("level", F.lit(0)), 0
    while True:
        on = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"))
        step = checkpointed(step.join(on, "ancestor").select("node", F.col("further").alias("ancestor")))
        if not step.limit(1).count():
            return made.select("node", "level", "ancestor")
        level += 1
        made = made.unionByName(step.withColumn("level", F.lit(level)))


def _levels(steps: DataFrame) -> int:
    return 1 + (steps.agg(F.max("level")).first()[0] if steps.limit(1).count() else -1)


def _depths_from(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """Depths bit by bit: a node at depth d has the jump of d's highest bit, and goes on from there."""
    walk = nodes.select("node", F.col("node").alias("at"), F.lit(0).cast("long").alias("depth"))
    for level in reversed(range(_levels(steps))):
        on = steps.where(F.col("level") == level).select(F.col("node").alias("at"), F.col("ancestor").alias("further"))
        walk = walk.join(on, "at", "left").select("node", F.coalesce("further", "at").alias("at"), (F.col("depth") + F.when(F.col("further").isNull(), 0).otherwise(1 << level)).alias("depth"))
    return walk.select("node", "depth")


def lca(pairs: DataFrame, nodes: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """``pairs(a, b)`` with their lowest common ancestor and its distance to each; pairs of different trees are left out.

    The deeper end is lifted to the other's depth bit by bit, then both go up by
    ever smaller jumps as long as they stay apart.
    """
    steps = jumps(nodes) if steps is None else steps
    deep = checkpointed(depths(nodes, steps))
    side = lambda c: deep.select(F.col("node").alias(c), F.col("depth").alias(f"depth_{c}"))
    walk = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").withColumns({"x": F.col("a"), "y": F.col("b")})
    levels = _levels(steps)

    def up(level: int, end: str) -> DataFrame:
        return steps.where(F.col("level") == level).select(F.col("node").alias(end), F.col("ancestor").alias(f"up_{end}"))

    for level in range(levels):
        gap = F.col("depth_a") - F.col("depth_b")
        lift = lambda c, of: F.when((of > 0) & (of.bitwiseAND(F.lit(1 << level)) != 0), F.col(f"up_{c}")).otherwise(F.col(c))  # noqa: B023, E731
        joined = walk.join(up(level, "x"), "x", "left").join(up(level, "y"), "y", "left")
        walk = joined.select("a", "b", "depth_a", "depth_b", lift("x", gap).alias("x"), lift("y", -gap).alias("y"))
        walk = checkpointed(walk) if level % 4 == 3 else walk
    for level in reversed(range(levels)):
        joined = walk.join(up(level, "x"), "x", "left").join(up(level, "y"), "y", "left")
        apart = (F.col("x") != F.col("y")) & (F.col("up_x") != F.col("up_y"))
        walk = joined.select("a", "b", "depth_a", "depth_b", *[F.when(apart, F.col(f"up_{c}")).otherwise(F.col(c)).alias(c) for c in "xy"])
        walk = checkpointed(walk) if level % 4 == 0 else walk
    met = walk.join(up(0, "x"), "x", "left").join(up(0, "y"), "y", "left")
    found = met.withColumn("lca", F.when(F.col("x") == F.col("y"), F.col("x")).when(F.col("up_x") == F.col("up_y"), F.col("up_x"))).where("lca is not null")
    of = deep.select(F.col("node").alias("lca"), "depth")
    dist = lambda c: (F.col(f"depth_{c}") - F.col("depth")).cast("int").alias(f"dist_{c}")
    return found.join(of, "lca").select("a", "b", "lca", dist("a"), dist("b"))
