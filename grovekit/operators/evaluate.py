"""Scores of trees and clusterings against gold labels, without forming pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.operators import tree


def _choose_two(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def purity_from(counts: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(node, purity) from ``counts(node, label, n)``: the most frequent class's share of the labelled leaves, or of ``sizes(node, n_leaves)``."""
    found = counts.groupBy("node").agg(F.max("n").alias("top"), F.sum("n").alias("labelled"))
    if sizes is None:
        return found.select("node", (F.col("top") / F.col("labelled")).alias("purity"))
    return found.join(sizes, "node").select("node", (F.col("top") / F.col("n_leaves")).alias("purity"))


def node_purity(anc: DataFrame, leaf_labels: DataFrame, strict: bool = False) -> DataFrame:
    """(node, purity): share of the most frequent class among the labelled leaves below (``strict``: among all leaves)."""
    return purity_from(tree.class_counts(anc, leaf_labels), tree.leaf_counts(anc, leaf_labels) if strict else None)


def class_purity_from(counts: DataFrame) -> DataFrame:
    """(node, label, purity): share of each class among the labelled leaves below, from ``counts(node, label, n)``."""
    totals = counts.groupBy("node").agg(F.sum("n").alias("labelled"))
    return counts.join(totals, "node").select("node", "label", (F.col("n") / F.col("labelled")).alias("purity"))


def class_purity(anc: DataFrame, leaf_labels: DataFrame) -> DataFrame:
    return class_purity_from(tree.class_counts(anc, leaf_labels))


def class_top_from(counts: DataFrame, k: int = 10) -> DataFrame:
    """(node, label, n, place): the most frequent classes below each node."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("n"), "label"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def class_top(anc: DataFrame, leaf_labels: DataFrame, k: int = 10) -> DataFrame:
    return class_top_from(tree.class_counts(anc, leaf_labels), k)


def dendrogram_purity(nodes: DataFrame, anc: DataFrame, leaf_labels: DataFrame, strict: bool = False, only: DataFrame | None = None) -> DataFrame:
    """One row ``purity``: mean over same-class leaf pairs of the class's share below their lowest common ancestor.

    ``only(node)`` restricts the pairs, not the shares.  Null if there are no pairs.
    """
    every = tree.class_counts(anc, leaf_labels)
    paired = every if only is None else tree.class_counts(anc, leaf_labels.join(only.select("node"), "node", "left_semi"))
    return dendrogram_purity_from(nodes, every, paired, tree.leaf_counts(anc, leaf_labels) if strict else None)


def dendrogram_purity_from(nodes: DataFrame, every: DataFrame, paired: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``dendrogram_purity`` from class counts ``every(node, label, n)``, those of the leaves whose pairs count, and ``sizes(node, n_leaves)`` if strict.

    With n(v, c) leaves of class c below v, the pairs that meet at v number
    C(n(v, c), 2) minus the same of v's children.
    """
    up = nodes.where("parent is not null").select("node", "parent")
    met = (every if paired is None else paired).select("node", "label", _choose_two(F.col("n")).alias("p"))
    below = met.join(up, "node").select(F.col("parent").alias("node"), "label", (-F.col("p")).alias("p"))
    pairs = met.unionByName(below).groupBy("node", "label").agg(F.sum("p").alias("p")).where("p <> 0")
    size = sizes.select("node", F.col("n_leaves").alias("all")) if sizes is not None else every.groupBy("node").agg(F.sum("n").alias("all"))
    return pairs.join(every, ["node", "label"]).join(size, "node").agg((F.sum(F.col("p") * F.col("n") / F.col("all")) / F.sum("p")).alias("purity"))


def pairwise_counts(table: DataFrame, predicted: str = "predicted", gold: str = "gold", by: list[str] | None = None) -> DataFrame:
    """true_pos, false_pos, false_neg over unordered pairs, from the contingency table (for each group ``by``)."""
    by = by or []
    cells = table.groupBy(*by, predicted, gold).agg(F.count("*").alias("n"))
    rows = cells.groupBy(*by, predicted).agg(F.sum("n").alias("n"))
    cols = cells.groupBy(*by, gold).agg(F.sum("n").alias("n"))
    part = lambda df, name: df.select(*by, F.lit(name).alias("part"), _choose_two(F.col("n")).alias("pairs"))
    every = part(cells, "both").unionByName(part(rows, "predicted")).unionByName(part(cols, "gold"))
    total = lambda name: F.coalesce(F.sum(F.when(F.col("part") == name, F.col("pairs"))), F.lit(0.0))
    agg = every.groupBy(*by).agg(total("both").alias("tp"), total("predicted").alias("pp"), total("gold").alias("gp"))
    return agg.select(*by, F.col("tp").cast("long").alias("true_pos"), (F.col("pp") - F.col("tp")).cast("long").alias("false_pos"), (F.col("gp") - F.col("tp")).cast("long").alias("false_neg"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def pairwise_f1(table: DataFrame, predicted: str = "predicted", gold: str = "gold", by: list[str] | None = None) -> DataFrame:
    """Pairwise counts with precision, recall and f1 (0 where undefined)."""
    tp, fp, fn = F.col("true_pos"), F.col("false_pos"), F.col("false_neg")
    scored = pairwise_counts(table, predicted, gold, by).withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    return scored.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(table: DataFrame, by: str, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """Means over groups of precision and recall, and the f1 of the means."""
    means = pairwise_f1(table, predicted, gold, [by]).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))
    return means.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _contingency(table: DataFrame, predicted: str, gold: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = table.groupBy(predicted, gold).agg(F.count("*").alias("n"))
    return cells, cells.groupBy(predicted).agg(F.sum("n").alias("r")), cells.groupBy(gold).agg(F.sum("n").alias("c"))


def adjusted_rand(table: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """One row ``ari``; 1 where both clusterings are trivial in the same way."""
    cells, rows, cols = _contingency(table, predicted, gold)
    a = cells.agg(F.sum(_choose_two(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    b, c = rows.agg(F.sum(_choose_two(F.col("r"))).alias("pred")), cols.agg(F.sum(_choose_two(F.col("c"))).alias("true"))
    one = a.crossJoin(b).crossJoin(c)  # one row each
    expected = F.col("pred") * F.col("true") / _choose_two(F.col("n"))
    most = (F.col("pred") + F.col("true")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def normalised_information(table: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """One row ``nmi``: mutual information over the mean of the entropies (1 where both are one cluster)."""
    cells, rows, cols = _contingency(table, predicted, gold)
    total = cells.agg(F.sum("n").alias("t"))
    joint = cells.join(rows, predicted).join(cols, gold).crossJoin(F.broadcast(total))  # the total is one row
    mi = joint.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("r") * F.col("c")))).alias("mi"))
    entropy = lambda df, n, name: df.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(n) / F.col("t") * F.log(F.col(n) / F.col("t")))).alias(name))
    one = mi.crossJoin(entropy(rows, "r", "hr")).crossJoin(entropy(cols, "c", "hc"))
    return one.select(F.when(F.col("hr") + F.col("hc") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("hr") + F.col("hc"))).alias("nmi"))


def unlabelled_out(table: DataFrame, gold: str = "gold", missing: str = "-1") -> DataFrame:
    return table.where(F.col(gold).isNotNull() & (F.col(gold).cast("string") != missing))
