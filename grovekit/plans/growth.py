"""Queries that grow, rearrange and search trees and graphs in bulk, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions import vectors as V
from grovekit.operators import batchwise, contraction, cut, graph, knn, moves, tree
from grovekit.plans.catalogue import _COS, _E, _HEAP_STATS, _SCORE_COS, _grid, _grid_sql, _points, _r, _read, heap, query

# one round of bulk moves over the heap tree

_CLAIMS = """ml AS (SELECT * FROM (SELECT mv.x, mv.y, s, p.dist AS da, q.dist AS db, row_number() OVER (PARTITION BY mv.x, mv.y ORDER BY p.dist) AS r
  FROM mv JOIN anc p ON p.node = mv.x JOIN anc q ON q.node = mv.y AND q.ancestor = p.ancestor) WHERE r = 1 AND {allowed}),
kin AS (SELECT n.node AS x, n.parent AS up, o.node AS sib, g.parent AS grand FROM nodes n JOIN nodes o ON o.parent = n.parent AND o.node <> n.node JOIN nodes g ON g.node = n.parent),
cl AS (SELECT x, y, s, ancestor AS claim FROM ml JOIN anc ON anc.node = x AND dist <= da UNION SELECT x, y, s, ancestor FROM ml JOIN anc ON anc.node = y AND dist <= db {more}),
fst AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY s DESC, x, y) AS r FROM cl), taken AS (SELECT x, y FROM fst GROUP BY x, y HAVING max(r) = 1),
ptr AS ({pointers})
SELECT nodes.node, CASE WHEN ptr.node IS NOT NULL THEN ptr.p ELSE parent END AS parent FROM nodes LEFT JOIN ptr ON ptr.node = nodes.node"""
_MOVED = _CLAIMS.format(
    allowed="da > 0 AND NOT (da = 1 AND db <= 1)",
    more="UNION SELECT ml.x, y, s, sib FROM ml JOIN kin ON kin.x = ml.x UNION SELECT ml.x, y, s, grand FROM ml JOIN kin ON kin.x = ml.x WHERE grand IS NOT NULL",
    pointers="SELECT sib AS node, grand AS p FROM taken JOIN kin USING (x) UNION ALL SELECT up, t.parent FROM taken JOIN kin USING (x) JOIN nodes t ON t.node = y UNION ALL SELECT y, up FROM taken JOIN kin USING (x)",
)
_SWAPPED = _CLAIMS.format(
    allowed="da > 0 AND db > 0 AND NOT (da = 1 AND db = 1)", more="",
    pointers="SELECT x AS node, t.parent AS p FROM taken JOIN nodes t ON t.node = y UNION ALL SELECT y, t.parent FROM taken JOIN nodes t ON t.node = x",
)


@query(_grid_sql(_COS, _SCORE_COS, """, w AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(score, 9) DESC, x, y) AS r FROM c WHERE x_likes AND y_likes),
mv AS (SELECT x, y, max(round(score, 9)) AS s FROM w WHERE r = 1 GROUP BY x, y), """ + _MOVED))
def graft_round(spark, d):
    """The heap tree after one round of grafts: of the best grafts of leaves half the points apart, those that touch no common part."""
    h = heap(spark, d)
    best = tree.best_graft(_grid(spark, d, "cosine")).select("x", "y", "score")
    return moves.apply_moves(h, moves.independent(best, h, tree.closure(h))).select("node", "parent")


@query(f"""WITH RECURSIVE {_HEAP_STATS}, {_SCORE_COS}, o AS (SELECT z.node AS leaf, z.parent AS up, c.node AS y, round({_COS}, 9) AS s
  FROM leaf z JOIN anc x ON x.node = z.node AND x.dist > 0 JOIN nodes n ON n.node = x.ancestor JOIN nodes c ON c.parent = n.parent AND c.node <> n.node JOIN st a ON a.node = z.node JOIN st b ON b.node = c.node),
bst AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY leaf ORDER BY s DESC, y) AS r FROM o JOIN sc ON sc.node = o.up WHERE s > round(sc.score, 9)) WHERE r = 1),
mv AS (SELECT q.node AS x, y, max(s) AS s FROM bst JOIN nodes q ON q.parent = up AND q.node <> leaf GROUP BY ALL), """ + _SWAPPED)
def restructure_round(spark, d):
    """The heap tree after one round of swaps: each leaf's sibling for the nearest of its ancestors' siblings, where that is nearer; those that touch no common part."""
    h = heap(spark, d)
    anc = tree.closure(h)
    n = _read(spark, d, "embeddings").count()
    stats = contraction.stats(h, _read(spark, d, "embeddings").select((F.col("vec_id") + n).alias("node"), F.col("embedding").alias("vec")))
    scores = tree.node_scores(h, stats, "cosine").select(F.col("node").alias("up"), F.round("score", 9).alias("held"))
    kin = tree.siblings(h)
    leaf = tree.leaves(h).select(F.col("node").alias("leaf"), F.col("parent").alias("up")).join(kin.select(F.col("node").alias("leaf"), F.col("sibling").alias("x")), "leaf")
    outer = leaf.join(anc.where("dist > 0").select(F.col("node").alias("leaf"), F.col("ancestor").alias("node")), "leaf").join(kin, "node").withColumnRenamed("sibling", "y")
    side = lambda c: stats.select(F.col("node").alias(c), F.col("sum").alias(f"s_{c}"))
    seen = outer.join(side("leaf"), "leaf").join(side("y"), "y").join(scores, "up").withColumn("score", F.round(V.cosine(F.col("s_leaf"), F.col("s_y")), 9)).where("score > held")
    best = knn.top_k(seen.select("leaf", "x", "y", "score"), 1, "leaf", "score", "y").select("x", "y", "score")
    return moves.apply_swaps(h, moves.independent(best, h, anc, kin=False)).select("node", "parent")


@query(f"""WITH RECURSIVE {_HEAP_STATS}, {_SCORE_COS}, pick AS (SELECT sc.node FROM sc, k WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent = sc.node AND c.node NOT IN (SELECT node FROM leaf))
  ORDER BY round(score, 9), sc.node LIMIT (SELECT n - (n - n // 4) FROM k))
SELECT node AS leaf, parent AS node FROM nodes WHERE parent IN (SELECT node FROM pick) UNION ALL SELECT node, node FROM leaf WHERE parent NOT IN (SELECT node FROM pick)""")
def tree_collapsed(spark, d):
    """The heap tree's leaves after its worst pairs were collapsed, all at once, so that three quarters are left, and what each holds."""
    h = heap(spark, d)
    e = _read(spark, d, "embeddings")
    n = e.count()
    _, members = moves.collapse_to(h, e.select((F.col("vec_id") + n).alias("node"), F.col("embedding").alias("vec")), n - n // 4)
    return members.select(F.col("id").alias("leaf"), "node")


@query(f"""WITH RECURSIVE {_HEAP_STATS}, {_SCORE_COS}, x AS (SELECT round(score, 9) AS x, row_number() OVER (ORDER BY round(score, 9)) AS i FROM sc),
p AS (SELECT i, sum(x) OVER (ORDER BY i) AS s, sum(x * x) OVER (ORDER BY i) AS q FROM x), z AS (SELECT count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM x),
c AS (SELECT p.s / i AS low, (z.s - p.s) / (n - i) AS high, p.q - p.s * p.s / i + (z.q - p.q) - (z.s - p.s) * (z.s - p.s) / (n - i) AS error FROM p, z WHERE i < n),
b AS (SELECT * FROM c ORDER BY error LIMIT 1) SELECT round(low, 6) + 0.0 AS threshold FROM b UNION ALL SELECT round(high, 6) + 0.0 FROM b""")
def clustered_thresholds(spark, d):
    """The means of the two clusters that the heap tree's scores fall into with the least squared error."""
    h = heap(spark, d)
    e = _read(spark, d, "embeddings")
    n = e.count()
    scores = tree.node_scores(h, contraction.stats(h, e.select((F.col("vec_id") + n).alias("node"), F.col("embedding").alias("vec"))), "cosine")
    return cut.clustered_thresholds(scores.select(F.round("score", 9).alias("score")), 2).select(_r("threshold").alias("threshold"))


# insertion of batches

_HALF = "half AS (SELECT * FROM embeddings WHERE vec_id < (SELECT count(*) // 2 FROM embeddings))"
_HALF_STATS = _HEAP_STATS.replace("embeddings", "half")


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """A heap tree over the first half of the embeddings, its leaves, the other half as arrivals, and a stride above all ids."""
    e = _read(spark, d, "embeddings")
    n = e.count()
    m = n // 2
    up = lambda c: F.when(c > 1, F.floor(c / 2)).cast("long")
    first = e.where(F.col("vec_id") < m).select((F.col("vec_id") + m).alias("node"), F.col("embedding").alias("vec"))
    nodes = spark.range(1, m).select(F.col("id").alias("node"), up(F.col("id")).alias("parent")).unionByName(first.select("node", up(F.col("node")).alias("parent")))
    return nodes, first, e.where(F.col("vec_id") >= m).select((F.col("vec_id") + 10 * n).alias("id"), F.col("embedding").alias("vec")), 100 * n


@query(f"""WITH RECURSIVE {_HALF}, {_HALF_STATS}, {_SCORE_COS}, z AS (SELECT count(*) AS n FROM embeddings), {_E}, q AS (SELECT e.id + 10 * z.n AS id, v FROM e, z WHERE e.id >= z.n // 2),
near AS (SELECT * FROM (SELECT a.id, b.node AS leaf, row_number() OVER (PARTITION BY a.id ORDER BY round({_COS}, 9) DESC, b.node) AS r FROM q a, pt b) WHERE r = 1),
path AS (SELECT id, ancestor, dist FROM anc JOIN near ON anc.node = leaf),
walk AS (SELECT path.id, path.dist, round({_COS}, 9) < round(sc.score, 9) AS up FROM path JOIN q a ON a.id = path.id JOIN st b ON b.node = path.ancestor JOIN nodes m ON m.node = path.ancestor JOIN sc ON sc.node = m.parent),
stop AS (SELECT path.id, coalesce(min(path.dist) FILTER (WHERE NOT walk.up), max(path.dist)) AS dist FROM path LEFT JOIN walk ON walk.id = path.id AND walk.dist = path.dist GROUP BY path.id),
spot AS (SELECT path.id, path.ancestor AS spot FROM path JOIN stop ON stop.id = path.id AND stop.dist = path.dist),
won AS (SELECT id, spot FROM (SELECT *, row_number() OVER (PARTITION BY spot ORDER BY md5('3|' || id), id) AS r FROM spot) WHERE r = 1)
SELECT nodes.node, coalesce(won.id + 100 * z.n, parent) AS parent FROM nodes LEFT JOIN won ON won.spot = nodes.node, z UNION ALL SELECT id, id + 100 * z.n FROM won, z UNION ALL SELECT won.id + 100 * z.n, parent FROM won JOIN nodes ON node = spot, z""")
def batch_round(spark, d):
    """A stored heap tree after one round of a batch: each spot's winner is spliced in."""
    nodes, leaves, arrived, stride = _stored(spark, d)
    return batchwise.splice(nodes, moves.spots_by_priority(batchwise.spots(nodes, leaves, arrived), 3), stride)


# neighbour graphs


@query()
def knn_descent_top5(spark, d):
    """Nearest neighbours by neighbours of neighbours, from random links."""
    p = _points(spark, d)
    near = knn.top_k(graph.descend(p), 5, "src", "score", "dst")
    return near.select(F.col("src").alias("query"), F.col("dst").alias("neighbour"), _r("score").alias("score"), "rank")


@query()
def knn_graph_climb(spark, d):
    """Nearest neighbours by a beam over a navigable graph, which is built without exact search."""
    p = _points(spark, d)
    return graph.search(p, p, 5).select("query", "neighbour", _r("score").alias("score"), "rank")
