"""Learning feature weights from triplets with a margin loss, and choosing a cut on development data."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovekit.functions.features import FeatureSpec, FeatureWeights
from grovekit.functions import vectors as V
from grovekit.operators import cut, evaluate, hac
from grovekit.plans.session import checkpointed


def sample_triplets(points: DataFrame, per_cluster: int, seed: int = 1) -> DataFrame:
    """(anchor, positive, negative): pairs within clusters of more than two members, with a member of another.

    Members are ordered by a hash of (seed, id): neighbours in that order are the
    positive pairs, and the negative is the member at the same place of the next
    cluster by hash, so a draw is reproducible and no cluster meets all others.
    """
    order = F.xxhash64(F.lit(seed), F.col("id"))
    placed = points.where("cluster is not null").withColumn("place", F.row_number().over(W.partitionBy("cluster").orderBy(order, "id")))
    sizes = points.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 2 and cluster is not null")
    ranked = sizes.withColumn("turn", F.row_number().over(W.orderBy(F.xxhash64(F.lit(seed), F.col("cluster")), "cluster")))  # one row for each cluster
    n_clusters = ranked.agg(F.count("*")).first()[0]
    ring = ranked.select("cluster", "n", (F.col("turn") % F.lit(max(1, n_clusters)) + 1).alias("next"))
    nxt = ranked.select(F.col("turn").alias("next"), F.col("cluster").alias("other"), F.col("n").alias("m"))
    first = placed.select("cluster", F.col("id").alias("anchor"), "place").where(F.col("place") <= per_cluster)
    second = placed.select("cluster", F.col("id").alias("positive"), (F.col("place") - 1).alias("place"))
    pairs = first.join(second, ["cluster", "place"]).join(ring, "cluster").join(nxt, "next").where("other <> cluster")
    negatives = placed.select(F.col("cluster").alias("other"), F.col("id").alias("negative"), F.col("place").alias("at"))
    spot = pairs.withColumn("at", ((F.col("place") - 1) % F.col("m") + 1).cast("int"))
    return spot.join(negatives, ["other", "at"]).select("anchor", "positive", "negative")


def margin_loss(positive: Column, negative: Column, margin: float = 1.0) -> Column:
    """softplus(-(positive - negative - margin)): the logistic loss of a pair that should win by ``margin``."""
    z = -(positive - negative - F.lit(margin))
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def feature_differences(triplets: DataFrame, points: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    """(d_<feature>...): comparison of anchor and positive minus that of anchor and negative."""
    names = [s.name for s in specs]
    side = lambda c, p: points.select(F.col("id").alias(c), *[F.col(n).alias(f"{p}_{n}") for n in names])
    rows = triplets.join(side("anchor", "a"), "anchor").join(side("positive", "p"), "positive").join(side("negative", "n"), "negative")
    d = lambda s: s.compare(F.col(f"a_{s.name}"), F.col(f"p_{s.name}")) - s.compare(F.col(f"a_{s.name}"), F.col(f"n_{s.name}"))
    return rows.select(*[d(s).alias(f"d_{s.name}") for s in specs])


@dataclass
class Fit:
    weights: FeatureWeights
    losses: list[float]


def fit_weights(triplets: DataFrame, points: DataFrame, specs: list[FeatureSpec], margin: float = 1.0, steps: int = 50, rate: float = 0.05, decay: float = 0.0) -> Fit:
    """Adam on the mean margin loss; each step is one aggregation over all triplets.

    A bias cancels between positive and negative, so only weights move.
    """
    rows = feature_differences(triplets, points, specs).persist()
    w = {s.name: 1.0 for s in specs}
    m, v, losses = dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0), []
    for t in range(1, steps + 1):
        z = sum((F.col(f"d_{n}") * F.lit(x) for n, x in w.items()), F.lit(0.0)) - F.lit(margin)
        pull = -1 / (1 + F.exp(z))
        got = rows.agg(F.avg(margin_loss(z + F.lit(margin), F.lit(0.0), margin)).alias("loss"), *[F.avg(pull * F.col(f"d_{n}")).alias(f"g_{n}") for n in w]).first()
        if got["loss"] is None:
            break
        losses.append(got["loss"])
        for n in w:
            g = got[f"g_{n}"] + decay * w[n]
            m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.999 * v[n] + 0.001 * g * g
            w[n] -= rate * (m[n] / (1 - 0.9**t)) / (math.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)
    rows.unpersist()
    return Fit(FeatureWeights({n: (x, 0.0) for n, x in w.items()}), losses)


def save_weights(weights: FeatureWeights, spark: SparkSession, path: str, threshold: float | None = None) -> None:
    """Writes a learned model as a small table: a row for each feature or rule, and one for the threshold."""
    rows = [(n, "learned", w, b) for n, (w, b) in weights.learned.items()] + [(n, "rule", w, None) for n, w in weights.rules.items()]
    rows += [("threshold", "cut", float(threshold), None)] if threshold is not None else []
    spark.createDataFrame(rows, "feature string, kind string, weight double, bias double").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> tuple[FeatureWeights, float | None]:
    rows = spark.read.parquet(path).collect()  # a row for each feature
    cut = [r["weight"] for r in rows if r["kind"] == "cut"]
    return FeatureWeights({r["feature"]: (r["weight"], r["bias"]) for r in rows if r["kind"] == "learned"}, {r["feature"]: r["weight"] for r in rows if r["kind"] == "rule"}), cut[0] if cut else None


def dev_blocks(points: DataFrame, block: str, gold: str, below: int = 5000, most: int = 50) -> DataFrame:
    """(block, n, labelled): of the blocks of fewer than ``below`` rows, the ``most`` with the most labelled rows (gold not null or '-1')."""
    known = F.col(gold).isNotNull() & (F.col(gold).cast("string") != "-1")
    sizes = points.groupBy(F.col(block).alias("block")).agg(F.count("*").alias("n"), F.count(F.when(known, 1)).alias("labelled"))
    return sizes.where(F.col("n") < below).orderBy(F.desc("labelled"), "block").limit(most)


def dev_evaluation(points: DataFrame, block: str, thresholds: int = 10) -> DataFrame:
    """``best_threshold`` over thresholds taken from the trees: the centres of all merges' distances in ``thresholds`` clusters."""
    merges = checkpointed(hac.within_blocks(points, block))
    if not merges.limit(1).count():
        return best_threshold(points, block, [0.0], merges)
    found = cut.clustered_thresholds(merges.select(F.col("distance").alias("score")), thresholds).collect()  # so many numbers
    return best_threshold(points, block, sorted({r["threshold"] for r in found}), merges)


def best_threshold(points: DataFrame, block: str, thresholds: list[float], merges: DataFrame | None = None) -> DataFrame:
    """(threshold, precision, recall, f1, best): pairwise scores of cutting each block's average-linkage tree at each distance.

    ``points(block, id, vec, gold)``; rows with gold null or '-1' aren't scored.
    The trees are made once, or are the given ``merges`` (``hac.within_blocks``).
    """
    if merges is None:
        merges = checkpointed(hac.within_blocks(points, block))
    spark = points.sparkSession
    order = points.select(F.col(block).alias("block"), "id", "gold", (F.row_number().over(W.partitionBy(block).orderBy("id")) - 1).cast("long").alias("leaf"))
    sizes = order.groupBy("block").agg(F.count("*").alias("n_leaves"))
    cuts = spark.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    made = merges.join(sizes, "block").withColumn("node", F.col("n_leaves") + F.col("step"))
    edges = made.select("block", F.explode(F.array("left", "right")).alias("child"), F.col("node").alias("parent"), "distance")

    # a leaf's cluster at t is its highest ancestor of distance <= t; distances rise upwards
    top = order.select("block", "leaf", F.col("leaf").alias("at")).crossJoin(cuts).withColumn("cluster", F.col("at"))
    spread = _climb(edges, order, cuts) if edges.limit(1).count() else top.select("block", "leaf", "threshold", "cluster")
    scored = spread.join(order, ["block", "leaf"]).where("gold is not null and cast(gold as string) <> '-1'")
    table = scored.select("threshold", F.concat_ws("/", F.col("block").cast("string"), F.col("cluster").cast("string")).alias("predicted"), F.col("gold").cast("string").alias("gold"))
    f1 = evaluate.pairwise_f1(table, by=["threshold"])
    best = f1.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("m")).select((-F.col("m.t")).alias("best_at"))
    return f1.crossJoin(F.broadcast(best)).select("threshold", "precision", "recall", "f1", (F.col("threshold") == F.col("best_at")).alias("best"))


def _climb(edges: DataFrame, leaves: DataFrame, cuts: DataFrame) -> DataFrame:
    """(block, leaf, threshold, cluster) by pointer doubling over the edges that each threshold allows."""
    allowed = edges.crossJoin(cuts).where("distance <= threshold").select("threshold", "block", F.col("child").alias("node"), "parent")
    now = leaves.select("block", "leaf").crossJoin(cuts).select("threshold", "block", "leaf", F.col("leaf").alias("at"))
    jump = allowed
    while True:
        now = checkpointed(now.join(jump.select("threshold", "block", F.col("node").alias("at"), "parent"), ["threshold", "block", "at"], "left").select("threshold", "block", "leaf", F.coalesce("parent", "at").alias("at")))
        again = jump.select("threshold", "block", F.col("node").alias("parent"), F.col("parent").alias("top"))
        further = jump.join(again, ["threshold", "block", "parent"]).select("threshold", "block", "node", F.col("top").alias("parent"))
        if further.isEmpty():
            break
        kept = jump.join(further.select("threshold", "block", "node"), ["threshold", "block", "node"], "left_anti")
        jump = checkpointed(further.unionByName(kept))
        if now.join(jump, (now["threshold"] == jump["threshold"]) & (now["block"] == jump["block"]) & (now["at"] == jump["node"]), "left_semi").isEmpty():
            break
    return now.select("block", "leaf", "threshold", F.col("at").alias("cluster"))


