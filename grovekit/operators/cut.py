"""Flat clusterings of a tree."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most runs of scores that thresholds are clustered from.
CELLS = 4096


def by_similarity(anc: DataFrame, leaf_nodes: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """(node, cluster): from the root down, nodes with score below the threshold are opened; the first others are clusters.

    A leaf's cluster is its highest ancestor all of whose own ancestors are
    opened; leaves that nothing stops are clusters of their own.
    """
    stops = scores.where(F.col("score") >= threshold).select(F.col("node").alias("ancestor"))
    path = anc.join(leaf_nodes.select("node"), "node", "left_semi")
    top = path.join(stops, "ancestor").groupBy("node").agg(F.max(F.struct("dist", "ancestor")).alias("m")).select("node", F.col("m.ancestor").alias("stop"))
    return leaf_nodes.select("node").join(top, "node", "left").select("node", F.coalesce("stop", "node").alias("cluster"))


def by_distance(anc: DataFrame, leaf_nodes: DataFrame, heights: DataFrame, threshold: float) -> DataFrame:
    """(node, cluster): a leaf's highest ancestor whose height is at most the threshold (heights rise towards the root)."""
    low = heights.where(F.col("height") <= threshold).select(F.col("node").alias("ancestor"))
    path = anc.join(leaf_nodes.select("node"), "node", "left_semi")
    top = path.join(low, "ancestor").groupBy("node").agg(F.max(F.struct("dist", "ancestor")).alias("m")).select("node", F.col("m.ancestor").alias("top"))
    return leaf_nodes.select("node").join(top, "node", "left").select("node", F.coalesce("top", "node").alias("cluster"))


def sweep(anc: DataFrame, leaf_nodes: DataFrame, scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(threshold, node, cluster) for every threshold, in one query; ``thresholds(threshold)`` is a short list."""
    stops = sorted({float(r[0]) for r in thresholds.select("threshold").collect()})  # the stated list
    path = anc.join(leaf_nodes.select("node"), "node", "left_semi")
    scored = path.join(scores.select(F.col("node").alias("ancestor"), "score"), "ancestor")
    # one pass: each leaf's highest ancestor at or above each threshold
    tops = [F.max(F.when(F.col("score") >= t, F.struct("dist", "ancestor"))).alias(f"m{i}") for i, t in enumerate(stops)]
    best = scored.groupBy("node").agg(*tops) if stops else scored.select("node").where("false")
    cuts = F.array(*[F.struct(F.lit(t).alias("threshold"), F.coalesce(F.col(f"m{i}.ancestor"), F.col("node")).alias("cluster")) for i, t in enumerate(stops)])
    every = leaf_nodes.select("node").join(best, "node", "left")
    return every.select("node", F.explode(cuts).alias("c")).select("c.threshold", "node", "c.cluster") if stops else every.select(F.lit(0.0).alias("threshold"), "node", F.col("node").alias("cluster")).where("false")


def candidate_thresholds(scores: DataFrame, n: int) -> DataFrame:
    """(threshold): quantiles of the scores, evenly spaced; each is a score, the least that so great a share doesn't exceed."""
    points = [i / (n + 1) for i in range(1, n + 1)]
    # a sketch with a relative error of one in a million in rank: exact up to that many scores, bounded beyond
    return scores.agg(F.percentile_approx("score", points, 1_000_000).alias("q")).select(F.explode("q").alias("threshold")).distinct()


def _cells(scores: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and weights of at most ``CELLS`` runs of the sorted scores: the distinct ones, or runs of equal share where they are more."""
    x = scores.where("score is not null and not isnan(score)").select(F.col("score").cast("double").alias("x"))
    few = x.groupBy("x").agg(F.count("*").alias("w")).limit(CELLS + 1).toPandas()
    if len(few) <= CELLS:
        few = few.sort_values("x")
        return few["x"].to_numpy(), few["w"].to_numpy(float)
    cuts = x.agg(F.percentile_approx("x", [i / CELLS for i in range(1, CELLS)], 100 * CELLS).alias("q")).first()["q"]
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    binned = Bucketizer(splits=splits, inputCol="x", outputCol="bin").transform(x)
    runs = binned.groupBy("bin").agg(F.avg("x").alias("m"), F.count("*").alias("w")).toPandas().sort_values("bin")  # CELLS rows at most
    return runs["m"].to_numpy(), runs["w"].to_numpy(float)


def best_runs(x: np.ndarray, w: np.ndarray, k: int) -> list[int]:
    """Where ``k`` runs of the sorted values begin so that the squared errors about their weighted means are least; ties to the earliest cuts."""
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (w, w * (x - x.mean()), w * (x - x.mean()) ** 2)]

    def error(i: np.ndarray, j: int) -> np.ndarray:
        n, s, q = (t[j] - t[i] for t in sums)
        return np.maximum(q - s * s / np.where(n > 0, n, 1.0), 0.0)

    n = len(x)
    best = np.array([0.0, *(error(np.array([0]), j)[0] for j in range(1, n + 1))])
    came = []
    for turn in range(2, k + 1):
        new, at = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(turn, n + 1):
            i = np.arange(turn - 1, j)
            total = best[i] + error(i, j)
            at[j] = i[np.argmin(total)]
            new[j] = total.min()
        best = new
        came.append(at)
    starts, j = [], n
    for at in reversed(came):
        j = int(at[j])
        starts.append(j)
    return [0, *reversed(starts)]


def clustered_thresholds(scores: DataFrame, n: int) -> DataFrame:
    """(threshold): the means of the scores' ``n`` clusters of least squared error (k-means, which in one dimension a dynamic program solves exactly).

    Up to ``CELLS`` distinct scores are taken as they are, more of them in so many
    runs of equal share; nulls are left out, and fewer distinct scores than ``n``
    give one threshold each.
    """
    x, w = _cells(scores)
    starts = best_runs(x, w, min(n, len(x))) if len(x) and n > 0 else []
    means = [float(np.average(x[a:b], weights=w[a:b])) for a, b in itertools.pairwise([*starts, len(x)])]
    return scores.sparkSession.createDataFrame([(m,) for m in means], "threshold double")
