"""Named queries over the test tables, each with its DuckDB counterpart where SQL can express it.

Trees that SQL can define stand in for learned ones:

* *heap*: leaf = vec_id + N over N embeddings, parent = node div 2, root 1;
* *geo*: world, regions, nations, customers, labelled by market segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions import features as FE
from grovekit.functions import vectors as V
from grovekit.operators import contraction, cut, evaluate, graph, hac, knn, online, search, train, tree
from grovekit.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _r(c: Column | str, n: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_COS = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"
_SQ = "list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


# nearest neighbours


def _knn_sql(score: str, k: int, where: str = "true") -> str:
    return f"""WITH {_E}, s AS (SELECT a.id AS query, b.id AS neighbour, {score} AS score FROM e a JOIN e b ON a.id <> b.id AND {where}),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, neighbour) AS rank FROM s)
SELECT query, neighbour, round(score, 6) + 0.0 AS score, rank::INTEGER AS rank FROM t WHERE rank <= {k}"""


def _searched(spark: SparkSession, d: str, k: int, similarity: str) -> DataFrame:
    p = _points(spark, d)
    return knn.exact(p, p, k, similarity).select("query", "neighbour", _r("score").alias("score"), "rank")


@query(f"""WITH {_E}, s AS (SELECT a.id AS vec_id, b.id AS neighbour, {_COS} AS score, a.label = b.label AS agrees FROM e a JOIN e b ON a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, neighbour) AS rank FROM s)
SELECT vec_id, neighbour, round(score, 6) + 0.0 AS score, agrees FROM t WHERE rank = 1""")
def knn_label_agreement(spark, d):
    p = _points(spark, d)
    best = knn.exact(p, p, 1)
    of = lambda c: p.select(F.col("id").alias(c), F.col("label").alias(f"label_{c}"))
    named = best.join(of("query"), "query").join(of("neighbour"), "neighbour")
    return named.select(F.col("query").alias("vec_id"), "neighbour", _r("score").alias("score"), (F.col("label_query") == F.col("label_neighbour")).alias("agrees"))


@query(_knn_sql(_COS, 5))
def knn_cosine_top5(spark, d):
    return _searched(spark, d, 5, "cosine")


@query(_knn_sql("list_inner_product(a.v, b.v)", 3))
def knn_dot_top3(spark, d):
    return _searched(spark, d, 3, "dot")


@query(_knn_sql(f"1 / (1 + {_SQ})", 5))
def knn_sql2_top5(spark, d):
    return _searched(spark, d, 5, "sql2")


@query(_knn_sql(f"1 / (1 + sqrt({_SQ}))", 5))
def knn_l2_top5(spark, d):
    return _searched(spark, d, 5, "l2")


@query(_knn_sql(_COS, 3, "a.label <> b.label"))
def nn_offlimits_same_label(spark, d):
    p = _points(spark, d)
    return search.by_features(p, p, [FE.FeatureSpec("vec", "cosine")], 3, differ="label").withColumn("score", _r("score"))


@query(f"""WITH {_E}, s AS (SELECT a.id AS query, b.id AS neighbour, {_COS} AS score FROM e a JOIN e b ON a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, neighbour) AS rank FROM s),
l AS (SELECT query AS src, neighbour AS dst, round(score, 9) AS score FROM t WHERE rank <= 5 UNION SELECT neighbour, query, round(score, 9) FROM t WHERE rank <= 5),
g AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS place FROM l)
SELECT src, dst, round(score, 6) + 0.0 AS score FROM g WHERE place <= 4""")
def graph_links_capped(spark, d):
    p = _points(spark, d)
    near = knn.exact(p, p, 5).withColumn("score", F.round("score", 9))
    return knn.graph_links(near, 4).select("src", "dst", _r("score").alias("score"))


@query()
def knn_lsh_top5(spark, d):
    p = _points(spark, d)
    return knn.approximate(p, p, 5).select("query", "neighbour", _r("score").alias("score"), "rank")


@query()
def graph_improved(spark, d):
    p = _points(spark, d)
    rough = knn.graph_links(knn.approximate(p, p, 3), 6)
    near = knn.top_k(graph.descend(p, start=rough), 5, "src", "score", "dst")
    return near.select("src", "dst", _r("score").alias("score"))


# vectors


@query(f"""WITH {_E} SELECT a.id AS a, b.id AS b, round({_COS}, 6) + 0.0 AS cosine, round(list_inner_product(a.v, b.v), 6) + 0.0 AS dot,
round(1 / (1 + sqrt({_SQ})), 6) AS l2, round(1 / (1 + {_SQ}), 6) AS sql2, round(-({_SQ}), 6) AS negative_sql2,
round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: abs(x[1] - x[2]))), 6) AS l1 FROM e a JOIN e b ON b.id = a.id + 1""")
def pair_similarities(spark, d):
    p = _points(spark, d).select("id", V.wide("vec").alias("v"))
    x, y = p.select(F.col("id").alias("a"), F.col("v").alias("x")), p.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("v").alias("y"))
    u, v = F.col("x"), F.col("y")
    named = {n: _r(f(u, v)).alias(n) for n, f in V.SIMILARITIES.items()}
    return x.join(y, "a").select("a", "b", *named.values(), _r(V.l1_distance(u, v)).alias("l1"))


_SUMS = f"""{_E}, c AS (SELECT label, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM e),
p AS (SELECT label, pos, sum(x) AS x, count(*) AS n FROM c GROUP BY ALL),
q AS (SELECT label, sum(list_inner_product(v, v)) AS sq FROM e GROUP BY ALL),
s AS (SELECT label, any_value(n) AS n, list(x ORDER BY pos) AS v, any_value(sq) AS sq FROM p JOIN q USING (label) GROUP BY label)"""


def _label_stats(spark: SparkSession, d: str) -> DataFrame:
    """(node, n, sum, sumsq) by label: clusters as nodes over their points."""
    p = _points(spark, d)
    anc = p.select(F.col("id").alias("node"), F.col("label").cast("long").alias("ancestor"))
    return tree.stats(anc, p.select(F.col("id").alias("node"), "vec"))


@query(f"""WITH {_SUMS}, m AS (SELECT *, list_transform(v, lambda x: x / n) AS c FROM s)
SELECT label::BIGINT AS label, n, round(sqrt(list_inner_product(v, v)), 4) AS sum_norm, round(sq, 4) AS sumsq,
round(c[1] / sqrt(list_inner_product(c, c)), 5) + 0.0 AS l2_first, round(c[1], 6) + 0.0 AS none_first,
round(c[1] / list_max(list_transform(c, lambda x: abs(x))), 5) + 0.0 AS l_inf_first, len(list_filter(c, lambda x: x > 0))::DOUBLE AS binary_sum FROM m""")
def cluster_stats(spark, d):
    s, n = F.col("sum"), F.col("n")
    first = lambda kind: V.centroid(s, n, kind)[0]
    return _label_stats(spark, d).select(
        F.col("node").alias("label"), "n", _r(V.norm(s), 4).alias("sum_norm"), _r("sumsq", 4).alias("sumsq"), _r(first("l2"), 5).alias("l2_first"),
        _r(first("none")).alias("none_first"), _r(first("l_inf"), 5).alias("l_inf_first"), V.total(V.centroid(s, n, "binary")).alias("binary_sum"),
    )


def _label_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = _label_stats(spark, d)
    side = lambda p: s.select(*[F.col(c).alias(p + c) for c in s.columns])
    return side("a_").join(side("b_"), F.col("a_node") < F.col("b_node"))


@query(f"WITH {_E} SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round(avg(-({_SQ})), 6) AS score FROM e a JOIN e b ON a.label < b.label GROUP BY ALL")
def linkage_average_by_label(spark, d):
    c = F.col
    score = V.average_link(c("a_n"), c("a_sum"), c("a_sumsq"), c("b_n"), c("b_sum"), c("b_sumsq"))
    return _label_pairs(spark, d).select(c("a_node").alias("a"), c("b_node").alias("b"), _r(score).alias("score"))


@query(f"WITH {_SUMS} SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round({_COS}, 6) + 0.0 AS score FROM s a JOIN s b ON a.label < b.label")
def linkage_cosine_by_label(spark, d):
    return _label_pairs(spark, d).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), _r(V.cosine_link(F.col("a_sum"), F.col("b_sum"))).alias("score"))


# trees

_HEAP = """k AS (SELECT count(*) AS n FROM embeddings),
nodes AS (SELECT i AS node, CASE WHEN i > 1 THEN i // 2 END AS parent, NULL::INTEGER AS label FROM k, range(1, (SELECT n FROM k)) t(i)
  UNION ALL SELECT vec_id + n, CASE WHEN vec_id + n > 1 THEN (vec_id + n) // 2 END, label FROM embeddings, k)"""
_GEO = """nodes AS (SELECT 0::BIGINT AS node, NULL::BIGINT AS parent, NULL::VARCHAR AS label UNION ALL SELECT 1 + r_regionkey, 0, NULL FROM region
  UNION ALL SELECT 1000 + n_nationkey, 1 + n_regionkey, NULL FROM nation UNION ALL SELECT 1000000 + c_custkey, 1000 + c_nationkey, c_mktsegment FROM customer)"""
_ANC = "anc AS (SELECT node, node AS ancestor, 0 AS dist, parent AS up FROM nodes UNION ALL SELECT a.node, n.node, a.dist + 1, n.parent FROM anc a JOIN nodes n ON a.up = n.node)"
_LEAF = "leaf AS (SELECT * FROM nodes WHERE node NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL))"
_COUNTS = "cnt AS (SELECT ancestor AS node, label, count(*) AS n FROM anc JOIN leaf USING (node) WHERE label IS NOT NULL GROUP BY ALL), tot AS (SELECT node, sum(n) AS n FROM cnt GROUP BY node)"
_STRICT = "every AS (SELECT ancestor AS node, count(*) AS n FROM anc JOIN leaf USING (node) GROUP BY ALL)"
HEAP, GEO = f"WITH RECURSIVE {_HEAP}, {_ANC}, {_LEAF}", f"WITH RECURSIVE {_GEO}, {_ANC}, {_LEAF}"


def heap(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings").select("vec_id", "label")
    n = e.count()
    up = lambda c: F.when(c > 1, F.floor(c / 2)).cast("long")
    leaf = F.col("vec_id") + n
    inner = spark.range(1, n).select(F.col("id").alias("node"), up(F.col("id")).alias("parent"), F.lit(None).cast("string").alias("label"))
    return inner.unionByName(e.select(leaf.alias("node"), up(leaf).alias("parent"), F.col("label").cast("string").alias("label")))


def geo(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string").alias("label")
    top = spark.range(1).select(F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"), none)
    regions = _read(spark, d, "region").select((1 + F.col("r_regionkey")).cast("long").alias("node"), F.lit(0).cast("long").alias("parent"), none)
    nations = _read(spark, d, "nation").select((1000 + F.col("n_nationkey")).cast("long").alias("node"), (1 + F.col("n_regionkey")).cast("long").alias("parent"), none)
    people = _read(spark, d, "customer").select((1000000 + F.col("c_custkey")).cast("long").alias("node"), (1000 + F.col("c_nationkey")).cast("long").alias("parent"), F.col("c_mktsegment").alias("label"))
    return top.unionByName(regions).unionByName(nations).unionByName(people)


def _heap_stats(spark: SparkSession, d: str, nodes: DataFrame, anc: DataFrame) -> DataFrame:
    e = _read(spark, d, "embeddings")
    n = e.count()
    return tree.stats(anc, e.select((F.col("vec_id") + n).alias("node"), F.col("embedding").alias("vec")))


@query(HEAP + " SELECT node, ancestor, dist FROM anc")
def tree_ancestors(spark, d):
    return tree.closure(heap(spark, d))


@query(GEO + " SELECT node, max(dist) AS depth FROM anc GROUP BY node")
def tree_depth(spark, d):
    return contraction.depths(geo(spark, d)).select("node", F.col("depth").cast("int").alias("depth"))


@query(GEO + " SELECT ancestor AS node, count(*) AS n_leaves FROM anc JOIN leaf USING (node) GROUP BY ALL")
def tree_leaf_counts(spark, d):
    return contraction.leaf_counts(geo(spark, d))


@query(HEAP + " SELECT a.node, b.node AS sibling FROM nodes a JOIN nodes b ON a.parent = b.parent AND a.node <> b.node")
def tree_siblings(spark, d):
    return tree.siblings(heap(spark, d))


@query(HEAP + " SELECT a.node, b.node AS aunt FROM nodes a JOIN nodes p ON a.parent = p.node JOIN nodes b ON p.parent = b.parent AND b.node <> p.node")
def tree_aunts(spark, d):
    return tree.aunts(heap(spark, d))


@query(HEAP + " SELECT max(dist) AS height FROM anc")
def tree_height(spark, d):
    return contraction.heights(heap(spark, d)).agg(F.max("height").cast("int").alias("height"))


@query(HEAP + " SELECT node, dist FROM anc WHERE ancestor = 5")
def tree_descendants(spark, d):
    return tree.descendants(tree.closure(heap(spark, d)), 5)


@query(HEAP + """, p AS (SELECT x.node AS a, y.node AS b FROM leaf x JOIN leaf y ON y.node = x.node + 7),
m AS (SELECT a, b, x.ancestor AS lca, x.dist AS dist_a, y.dist AS dist_b, row_number() OVER (PARTITION BY a, b ORDER BY x.dist) AS r
  FROM p JOIN anc x ON x.node = a JOIN anc y ON y.node = b AND y.ancestor = x.ancestor)
SELECT a, b, lca, dist_a, dist_b FROM m WHERE r = 1""")
def tree_lca_pairs(spark, d):
    h = heap(spark, d)
    leaf = tree.leaves(h).select("node")
    pairs = leaf.select(F.col("node").alias("a")).join(leaf.select((F.col("node") - 7).alias("a"), F.col("node").alias("b")), "a")
    return contraction.lca(pairs, h)


@query(HEAP + f", {_COUNTS} SELECT node, list_sort(list(DISTINCT label::VARCHAR)) AS labels FROM cnt GROUP BY node")
def tree_leaf_labels(spark, d):
    h = heap(spark, d)
    counts = contraction.class_counts(h, tree.leaves(h))
    return counts.groupBy("node").agg(F.sort_array(F.collect_set("label")).alias("labels"))


@query(HEAP + """ SELECT node, CASE WHEN node = 6 THEN (SELECT parent FROM nodes WHERE node = 9) WHEN node = 9 THEN (SELECT parent FROM nodes WHERE node = 6) ELSE parent END AS parent FROM nodes""")
def tree_swapped(spark, d):
    return tree.swap(heap(spark, d), 6, 9).select("node", "parent")


@query(HEAP + """ SELECT node, CASE WHEN node = 8 THEN 2 WHEN node IN (12, 9) THEN -1 ELSE parent END AS parent FROM nodes WHERE node <> 4 UNION ALL SELECT -1, 6""")
def tree_spliced(spark, d):
    return tree.make_sibling(heap(spark, d), 12, 9, -1).select("node", "parent")


@query(GEO + """ SELECT 'not two children' AS problem, parent AS node FROM nodes WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) <> 2
UNION ALL SELECT 'unknown parent', node FROM nodes WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM nodes)
UNION ALL SELECT 'repeated', node FROM nodes GROUP BY node HAVING count(*) > 1""")
def tree_problems(spark, d):
    """What keeps the geographical tree from being binary."""
    return tree.problems(geo(spark, d))


# tree scores


@query(GEO + f", {_COUNTS} SELECT node, round(max(cnt.n) / any_value(tot.n), 9) AS purity FROM cnt JOIN tot USING (node) GROUP BY node")
def node_purity(spark, d):
    g = geo(spark, d)
    return evaluate.purity_from(contraction.class_counts(g, tree.leaves(g))).select("node", _r("purity", 9).alias("purity"))


@query(GEO + f", {_COUNTS}, {_STRICT} SELECT node, round(max(cnt.n) / any_value(every.n), 9) AS purity FROM cnt JOIN every USING (node) GROUP BY node")
def node_purity_strict(spark, d):
    g = geo(spark, d)
    return evaluate.purity_from(contraction.class_counts(g, tree.leaves(g)), contraction.leaf_counts(g)).select("node", _r("purity", 9).alias("purity"))


@query(HEAP + f", {_COUNTS} SELECT cnt.node, label::VARCHAR AS label, round(cnt.n / tot.n, 9) AS purity FROM cnt JOIN tot USING (node)")
def class_purity(spark, d):
    h = heap(spark, d)
    return evaluate.class_purity_from(contraction.class_counts(h, tree.leaves(h))).select("node", "label", _r("purity", 9).alias("purity"))


@query(HEAP + f", {_COUNTS}, t AS (SELECT node, label::VARCHAR AS label, n, row_number() OVER (PARTITION BY node ORDER BY n DESC, label::VARCHAR) AS place FROM cnt) SELECT node, label, n, place::INTEGER AS place FROM t WHERE place <= 3")
def class_top3(spark, d):
    h = heap(spark, d)
    return evaluate.class_top_from(contraction.class_counts(h, tree.leaves(h)), 3)


def _purity_sql(head: str, size: str, only: str = "true") -> str:
    """All same-class pairs, one by one."""
    return head + f""", {_COUNTS}, {_STRICT}, p AS (SELECT x.node AS a, y.node AS b, x.label FROM leaf x JOIN leaf y ON x.label = y.label AND x.node < y.node WHERE {only}),
m AS (SELECT a, b, p.label, x.ancestor AS lca, row_number() OVER (PARTITION BY a, b ORDER BY x.dist) AS r FROM p JOIN anc x ON x.node = a JOIN anc y ON y.node = b AND y.ancestor = x.ancestor)
SELECT round(avg(cnt.n / {size}.n), 9) AS purity FROM m JOIN cnt ON cnt.node = lca AND cnt.label = m.label JOIN {size} ON {size}.node = lca WHERE r = 1"""


@query(_purity_sql(HEAP, "tot"))
def dendrogram_purity(spark, d):
    h = heap(spark, d)
    return evaluate.dendrogram_purity_from(h, contraction.class_counts(h, tree.leaves(h))).select(_r("purity", 9).alias("purity"))


@query(_purity_sql(HEAP, "every"))
def dendrogram_purity_strict(spark, d):
    h = heap(spark, d)
    return evaluate.dendrogram_purity_from(h, contraction.class_counts(h, tree.leaves(h)), sizes=contraction.leaf_counts(h)).select(_r("purity", 9).alias("purity"))


@query(_purity_sql(HEAP, "tot", "x.node IN (SELECT vec_id + n FROM embeddings, k WHERE label <= 4) AND y.node IN (SELECT vec_id + n FROM embeddings, k WHERE label <= 4)"))
def expected_dendrogram_purity(spark, d):
    h = heap(spark, d)
    leaf = tree.leaves(h)
    ids = leaf.where(F.col("label").cast("int") <= 4)
    paired = contraction.class_counts(h, leaf.join(ids.select("node"), "node", "left_semi"))
    return evaluate.dendrogram_purity_from(h, contraction.class_counts(h, leaf), paired).select(_r("purity", 9).alias("purity"))


_HEAP_STATS = f"""{_HEAP}, {_ANC}, {_LEAF}, pt AS (SELECT vec_id + n AS node, embedding::DOUBLE[] AS v FROM embeddings, k),
cell AS (SELECT ancestor AS node, pos, sum(x) AS x FROM (SELECT node, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM pt) JOIN anc USING (node) GROUP BY ALL),
sz AS (SELECT ancestor AS node, count(*) AS n, sum(list_inner_product(v, v)) AS sq FROM pt JOIN anc USING (node) GROUP BY ALL),
st AS (SELECT node, any_value(sz.n) AS n, any_value(sq) AS sq, list(x ORDER BY pos) AS v FROM cell JOIN sz USING (node) GROUP BY node)"""
_AVG = "-(a.sq / a.n + b.sq / b.n - 2 * list_inner_product(list_transform(a.v, lambda x: x / a.n), list_transform(b.v, lambda x: x / b.n)))"
_SCORE_AVG = f"sc AS (SELECT a.node // 2 AS node, {_AVG} AS score FROM st a JOIN st b ON b.node = a.node + 1 AND a.node % 2 = 0)"
_SCORE_COS = f"sc AS (SELECT a.node // 2 AS node, {_COS} AS score FROM st a JOIN st b ON b.node = a.node + 1 AND a.node % 2 = 0)"


@query(f"WITH RECURSIVE {_HEAP_STATS} SELECT node, n, round(sqrt(list_inner_product(v, v)), 4) AS sum_norm, round(sq, 4) AS sumsq FROM st")
def node_stats(spark, d):
    h = heap(spark, d)
    return _heap_stats(spark, d, h, tree.closure(h)).select("node", "n", _r(V.norm(F.col("sum")), 4).alias("sum_norm"), _r("sumsq", 4).alias("sumsq"))


@query(f"WITH RECURSIVE {_HEAP_STATS}, {_SCORE_AVG} SELECT node, round(score, 6) + 0.0 AS score FROM sc")
def node_score_average(spark, d):
    h = heap(spark, d)
    return tree.node_scores(h, _heap_stats(spark, d, h, tree.closure(h)), "average").select("node", _r("score").alias("score"))


@query(f"WITH RECURSIVE {_HEAP_STATS}, {_SCORE_COS} SELECT node, round(score, 6) + 0.0 AS score FROM sc")
def node_score_cosine(spark, d):
    h = heap(spark, d)
    return tree.node_scores(h, _heap_stats(spark, d, h, tree.closure(h)), "cosine").select("node", _r("score").alias("score"))


# cuts

_CUT = "SELECT leaf.node, coalesce(max_by(ancestor, dist), leaf.node) AS cluster FROM leaf LEFT JOIN (SELECT anc.* FROM anc JOIN sc ON sc.node = ancestor WHERE round(score, 9) >= {t}) x USING (node) GROUP BY leaf.node"


def _heap_scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    h = heap(spark, d)
    anc = tree.closure(h)
    return anc, tree.leaves(h), tree.node_scores(h, _heap_stats(spark, d, h, anc), "cosine").withColumn("score", F.round("score", 9))


@query(f"WITH RECURSIVE {_HEAP_STATS}, {_SCORE_COS} " + _CUT.format(t=0.1))
def flat_cut_similarity(spark, d):
    return cut.by_similarity(*_heap_scores(spark, d), 0.1)


@query(f"""WITH RECURSIVE {_HEAP_STATS}, {_SCORE_COS}, th AS (SELECT unnest([-0.2, 0.0, 0.2, 0.4])::DOUBLE AS threshold),
hit AS (SELECT threshold, anc.node, max_by(ancestor, dist) AS cluster FROM anc JOIN leaf USING (node) JOIN sc ON sc.node = ancestor JOIN th ON round(score, 9) >= threshold GROUP BY ALL)
SELECT th.threshold, leaf.node, coalesce(cluster, leaf.node) AS cluster FROM leaf CROSS JOIN th LEFT JOIN hit ON hit.node = leaf.node AND hit.threshold = th.threshold""")
def flat_cut_sweep(spark, d):
    cuts = spark.createDataFrame([(-0.2,), (0.0,), (0.2,), (0.4,)], "threshold double")
    return cut.sweep(*_heap_scores(spark, d), cuts)


@query(HEAP + """, ht AS (SELECT ancestor AS node, max(dist) AS height FROM anc GROUP BY ALL)
SELECT leaf.node, max_by(anc.ancestor, anc.dist) AS cluster FROM leaf JOIN anc ON anc.node = leaf.node JOIN ht ON ht.node = anc.ancestor AND height <= 3 GROUP BY leaf.node""")
def flat_cut_distance(spark, d):
    h = heap(spark, d)
    anc = tree.closure(h)
    heights = anc.groupBy(F.col("ancestor").alias("node")).agg(F.max("dist").alias("height"))
    return cut.by_distance(anc, tree.leaves(h), heights, 3)


@query(f"""WITH RECURSIVE {_HEAP_STATS}, {_SCORE_COS}, th AS (SELECT unnest(quantile_disc(round(score, 9), [0.25, 0.5, 0.75])) AS t FROM sc) SELECT round(t, 6) + 0.0 AS threshold FROM th""")
def candidate_thresholds(spark, d):
    _, _, scores = _heap_scores(spark, d)
    return cut.candidate_thresholds(scores, 3).select(_r("threshold").alias("threshold"))


# rearrangements of a given tree


@query(f"""WITH RECURSIVE {_HEAP_STATS}, {_SCORE_COS}, {_E},
near AS (SELECT q, leaf FROM (SELECT a.id AS q, b.id + n AS leaf, row_number() OVER (PARTITION BY a.id ORDER BY round({_COS}, 9) DESC, b.id) AS r FROM e a, e b, k WHERE b.id <> a.id) WHERE r = 1),
path AS (SELECT q, ancestor, dist FROM anc JOIN near ON anc.node = leaf),
walk AS (SELECT path.q, path.dist, round({_COS}, 9) < round(sc.score, 9) AS up FROM path JOIN e a ON a.id = path.q JOIN st b ON b.node = path.ancestor JOIN nodes m ON m.node = path.ancestor JOIN sc ON sc.node = m.parent),
stop AS (SELECT path.q, coalesce(min(path.dist) FILTER (WHERE NOT walk.up), max(path.dist)) AS dist FROM path LEFT JOIN walk ON walk.q = path.q AND walk.dist = path.dist GROUP BY path.q)
SELECT path.q AS vec_id, path.ancestor AS spot, path.dist::INTEGER AS climbed FROM path JOIN stop ON stop.q = path.q AND stop.dist = path.dist""")
def rotate_position(spark, d):
    """Where rotation puts each embedding: from its nearest other leaf up to the first ancestor that isn't passed."""
    p = _points(spark, d)
    h = heap(spark, d)
    n = p.count()
    anc = tree.closure(h)
    stats = _heap_stats(spark, d, h, anc)
    scores = tree.node_scores(h, stats, "cosine").select(F.col("node").alias("parent"), "score")
    near = knn.exact(p.withColumn("vec", V.wide("vec")), p, 1).select(F.col("query").alias("vec_id"), (F.col("neighbour") + n).alias("node"))
    path = near.join(anc, "node").select("vec_id", F.col("ancestor").alias("node"), "dist")
    seen = path.join(stats.select("node", "sum"), "node").join(h.select("node", "parent"), "node").join(scores, "parent", "left").join(p.select(F.col("id").alias("vec_id"), V.wide("vec").alias("q")), "vec_id")
    passes = F.round(V.cosine(F.col("q"), F.col("sum")), 9) < F.round("score", 9)
    marked = seen.select("vec_id", "node", "dist", F.coalesce(passes, F.lit(False)).alias("up"))
    return marked.where("not up").groupBy("vec_id").agg(F.min(F.struct("dist", "node")).alias("m")).select("vec_id", F.col("m.node").alias("spot"), F.col("m.dist").alias("climbed"))


def _grid_sql(score: str, sc: str, then: str) -> str:
    """The grids of all pairs of leaves n // 2 apart, cell by cell."""
    return f"""WITH RECURSIVE {_HEAP_STATS}, {sc}, pr AS (SELECT x.node AS a, x.node + n // 2 AS b FROM leaf x, k WHERE x.node + n // 2 IN (SELECT node FROM leaf)),
m AS (SELECT * FROM (SELECT a, b, x.dist AS da, y.dist AS db, row_number() OVER (PARTITION BY a, b ORDER BY x.dist) AS r FROM pr JOIN anc x ON x.node = a JOIN anc y ON y.node = b AND y.ancestor = x.ancestor) WHERE r = 1),
g AS (SELECT m.a AS pa, m.b AS pb, x.ancestor AS x, y.ancestor AS y FROM m JOIN anc x ON x.node = m.a AND x.dist < da JOIN anc y ON y.node = m.b AND y.dist < db),
f AS (SELECT pa, pb, g.x, g.y, {score} AS score, sx.score AS px, sy.score AS py FROM g JOIN st a ON a.node = g.x JOIN st b ON b.node = g.y
  JOIN nodes nx ON nx.node = g.x JOIN nodes ny ON ny.node = g.y JOIN sc sx ON sx.node = nx.parent JOIN sc sy ON sy.node = ny.parent),
c AS (SELECT pa AS a, pb AS b, x, y, score, round(score, 9) > round(px, 9) AS x_likes, round(score, 9) > round(py, 9) AS y_likes FROM f) {then}"""


_BEST = """, w AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(score, 9) DESC, x, y) AS r FROM c WHERE x_likes AND y_likes) SELECT a, b, x, y, round(score, 6) + 0.0 AS score FROM w WHERE r = 1"""


def _grid(spark: SparkSession, d: str, linkage: str, similarity: str = "dot") -> DataFrame:
    h = heap(spark, d)
    n = _read(spark, d, "embeddings").count()
    anc = tree.closure(h)
    leaf = tree.leaves(h).select("node")
    pairs = leaf.select(F.col("node").alias("a")).join(leaf.select((F.col("node") - n // 2).alias("a"), F.col("node").alias("b")), "a")
    return tree.graft_grid(pairs, h, anc, _heap_stats(spark, d, h, anc), linkage, "l2", similarity)


@query(_grid_sql(_COS, _SCORE_COS, "SELECT a, b, x, y, round(score, 6) + 0.0 AS score, x_likes, y_likes FROM c"))
def graft_candidates(spark, d):
    """The grids of paths below the common ancestors of all pairs of leaves half the points apart: link of each cell, and who prefers it."""
    return _grid(spark, d, "cosine").withColumn("score", _r("score"))


@query(_grid_sql(_COS, _SCORE_COS, _BEST))
def graft_best(spark, d):
    """The best cell of each grid that both sides prefer."""
    return tree.best_graft(_grid(spark, d, "cosine")).withColumn("score", _r("score"))


@query(f"""WITH RECURSIVE {_HEAP_STATS} SELECT z.node AS leaf, c.node AS candidate, round({_COS}, 6) + 0.0 AS score
FROM leaf z JOIN anc x ON x.node = z.node AND x.dist > 0 JOIN nodes n ON n.node = x.ancestor JOIN nodes c ON c.parent = n.parent AND c.node <> n.node JOIN st a ON a.node = z.node JOIN st b ON b.node = c.node""")
def restructure_candidates(spark, d):
    """Siblings of each leaf's ancestors, with their link to the leaf."""
    h = heap(spark, d)
    anc = tree.closure(h)
    stats = _heap_stats(spark, d, h, anc)
    outer = anc.where("dist > 0").join(tree.leaves(h).select("node"), "node", "left_semi").select(F.col("node").alias("leaf"), F.col("ancestor").alias("node")).join(tree.siblings(h), "node").select("leaf", F.col("sibling").alias("candidate"))
    side = lambda c: stats.select(F.col("node").alias(c), F.col("sum").alias(f"s_{c}"))
    return outer.join(side("leaf"), "leaf").join(side("candidate"), "candidate").select("leaf", "candidate", _r(V.cosine(F.col("s_leaf"), F.col("s_candidate"))).alias("score"))


# clustering scores

_T = "t AS (SELECT quality AS predicted, toxic AS gold FROM labels)"


def _clusterings(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "labels").select(F.col("quality").alias("predicted"), F.col("toxic").alias("gold"), "doc_id")


_PAIRS = "count(*) FILTER (WHERE p AND g) AS true_pos, count(*) FILTER (WHERE p AND NOT g) AS false_pos, count(*) FILTER (WHERE NOT p AND g) AS false_neg"
_F1 = "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1"
_PR = "CASE WHEN true_pos + false_pos > 0 THEN true_pos / (true_pos + false_pos) ELSE 0 END AS precision, CASE WHEN true_pos + false_neg > 0 THEN true_pos / (true_pos + false_neg) ELSE 0 END AS recall"


@query(f"""WITH t AS (SELECT doc_id, quality AS predicted, toxic AS gold FROM labels), x AS (SELECT a.predicted IS NOT DISTINCT FROM b.predicted AS p, a.gold IS NOT DISTINCT FROM b.gold AS g FROM t a JOIN t b ON a.doc_id < b.doc_id),
c AS (SELECT {_PAIRS} FROM x), r AS (SELECT *, {_PR} FROM c), f AS ({_F1} FROM r)
SELECT true_pos, false_pos, false_neg, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f""")
def pairwise_f1(spark, d):
    f = evaluate.pairwise_f1(_clusterings(spark, d))
    return f.select("true_pos", "false_pos", "false_neg", *[_r(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH t AS (SELECT l.doc_id, quality AS predicted, toxic AS gold, source FROM labels l JOIN documents USING (doc_id)),
x AS (SELECT a.source, a.predicted = b.predicted AS p, a.gold = b.gold AS g FROM t a JOIN t b ON a.source = b.source AND a.doc_id < b.doc_id),
c AS (SELECT s.source, coalesce(true_pos, 0) AS true_pos, coalesce(false_pos, 0) AS false_pos, coalesce(false_neg, 0) AS false_neg FROM (SELECT DISTINCT source FROM t) s LEFT JOIN (SELECT source, {_PAIRS} FROM x GROUP BY source) USING (source)),
r AS (SELECT avg(precision) AS precision, avg(recall) AS recall FROM (SELECT {_PR} FROM c)), f AS ({_F1} FROM r)
SELECT round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM f""")
def macro_pairwise_f1(spark, d):
    table = _clusterings(spark, d).join(_read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return evaluate.macro_f1(table, "source").select(*[_r(c, 9).alias(c) for c in ("precision", "recall", "f1")])


_CELLS = f"{_T}, n AS (SELECT predicted, gold, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT predicted, sum(n) AS n FROM n GROUP BY ALL), c AS (SELECT gold, sum(n) AS n FROM n GROUP BY ALL), z AS (SELECT sum(n) AS n FROM n)"


@query(f"""WITH {_CELLS}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS shared, (SELECT sum(n * (n - 1) / 2) FROM r) AS pred, (SELECT sum(n * (n - 1) / 2) FROM c) AS gold, (SELECT n * (n - 1) / 2 FROM z) AS every)
SELECT round((shared - pred * gold / every) / ((pred + gold) / 2 - pred * gold / every), 9) AS ari FROM s""")
def adjusted_rand(spark, d):
    return evaluate.adjusted_rand(_clusterings(spark, d)).select(_r("ari", 9).alias("ari"))


@query(f"""WITH {_CELLS}, mi AS (SELECT sum(n.n / z.n * ln(n.n * z.n / (r.n * c.n))) AS v FROM n JOIN r USING (predicted) JOIN c USING (gold), z),
h AS (SELECT (SELECT -sum(r.n / z.n * ln(r.n / z.n)) FROM r, z) + (SELECT -sum(c.n / z.n * ln(c.n / z.n)) FROM c, z) AS v)
SELECT round(2 * mi.v / h.v, 9) AS nmi FROM mi, h""")
def normalised_information(spark, d):
    return evaluate.normalised_information(_clusterings(spark, d)).select(_r("nmi", 9).alias("nmi"))


# features


@query("SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN a.lang <> b.lang THEN 1.0 ELSE 0.0 END::DOUBLE AS lang_differs, CASE WHEN a.source <> b.source THEN 1.0 ELSE 0.0 END::DOUBLE AS source_differs FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def feature_no_match(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "lang", "source")
    other = docs.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("lang").alias("lang_b"), F.col("source").alias("source_b"))
    both = docs.withColumnRenamed("doc_id", "a").join(other, "a")
    return both.select("a", "b", FE.no_match(F.col("lang"), F.col("lang_b")).alias("lang_differs"), FE.no_match(F.col("source"), F.col("source_b")).alias("source_differs"))


@query(f"WITH {_E} SELECT a.id AS a, b.id AS b, CASE WHEN round({_SQ}, 9) > 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS far FROM e a JOIN e b ON b.id = a.id + 3")
def feature_l2_gt_one(spark, d):
    p = _points(spark, d)
    both = p.select(F.col("id").alias("a"), F.col("vec").alias("x")).join(p.select((F.col("id") - 3).alias("a"), F.col("id").alias("b"), F.col("vec").alias("y")), "a")
    return both.select("a", "b", FE.FeatureSpec("vec", "l2_gt_one").compare(F.col("x"), F.col("y")).alias("far"))


@query(f"""WITH {_E} SELECT a.id AS a, b.id AS b, round(0.7 * list_inner_product(a.v, b.v) + 0.1 + -0.2 * ({_SQ}) + 0.05 + CASE WHEN a.label <> b.label THEN -20000.0 ELSE 0.0 END, 6) + 0.0 AS score
FROM e a JOIN e b ON b.id = a.id + 1""")
def weighted_similarity(spark, d):
    p = _points(spark, d)
    side = lambda s, shift: p.select((F.col("id") - shift).alias("a"), F.col("id").alias(f"id{s}"), F.col("vec").alias(f"v{s}"), F.col("label").alias(f"l{s}"))
    both = side("x", 0).join(side("y", 1), "a")
    specs = [FE.FeatureSpec("dot"), FE.FeatureSpec("l2", "l2"), FE.FeatureSpec("label", "no_match")]
    weights = FE.FeatureWeights({"dot": (0.7, 0.1), "l2": (-0.2, 0.05)}, {"label": FE.MUST_NOT_LINK})
    at = lambda s: {"dot": F.col(f"v{s}"), "l2": F.col(f"v{s}"), "label": F.col(f"l{s}")}
    return both.select("a", F.col("idy").alias("b"), _r(FE.similarity(specs, at("x"), at("y"), weights)).alias("score"))


@query(f"""WITH {_E}, s AS (SELECT a.id AS a, b.id AS b, {_COS} AS s FROM e a JOIN e b ON b.id BETWEEN a.id + 1 AND a.id + 5), m AS (SELECT min(s) AS lo, max(s) AS hi FROM s)
SELECT a, b, round(1 / (1 + greatest(s, lo) - least(0.0, lo)), 6) AS distance, round(hi - s, 6) + 0.0 AS below, round(s, 6) + 0.0 AS back FROM s, m""")
def similarity_to_distance(spark, d):
    """Similarities of points up to five places apart, as distances by two rules, and back."""
    p = _points(spark, d).select("id", V.wide("vec").alias("v"))
    near = p.select(F.col("id").alias("a"), F.col("v").alias("x"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 5)).alias("b"))
    pairs = near.join(p.select(F.col("id").alias("b"), F.col("v").alias("y")), "b").select("a", "b", V.cosine(F.col("x"), F.col("y")).alias("s"))
    ends = pairs.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    dist = FE.distance_from_similarity(F.col("s"), F.col("lo"))
    return pairs.crossJoin(F.broadcast(ends)).select("a", "b", _r(dist).alias("distance"), _r(FE.distance_below_largest(F.col("s"), F.col("hi"))).alias("below"), _r(FE.similarity_from_distance(dist, F.col("lo"))).alias("back"))


_STOP = ", ".join(f"'{w}'" for w in FE.STOP_WORDS)


@query(f"""WITH w AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[/.\\-'']', ' \\0 ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '\\s+') AS w FROM documents),
k AS (SELECT doc_id, list_filter(w, lambda x: x <> '' AND x NOT IN ({_STOP})) AS w FROM w)
SELECT doc_id, len(w)::INTEGER AS n_words, len(list_distinct(w))::INTEGER AS n_distinct, coalesce(w[1], '') AS first_word, coalesce(w[-1], '') AS last_word FROM k""")
def text_words(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", FE.words(F.col("text")).alias("w"))
    at = lambda i: F.coalesce(F.try_element_at("w", F.lit(i)), F.lit(""))
    return docs.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"), at(1).alias("first_word"), at(-1).alias("last_word"))


_WORDS = f"""w AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[/.\\-'']', ' \\0 ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ({_STOP})) AS w FROM conversations)"""
_BUCKET = "(('0x' || substr(md5({0}), 1, 8))::BIGINT // 2)"


@query(f"""WITH {_WORDS}, b AS (SELECT *, list_transform(w, lambda x: {_BUCKET.format('x')} % 16384) AS b FROM w)
SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN -1 ELSE {_BUCKET.format("array_to_string(w, ' ')")} % 1048576 END::INTEGER AS bucket, len(list_distinct(b))::INTEGER AS n_buckets,
len(w)::INTEGER AS n_words, coalesce(list_max(list_transform(list_distinct(b), lambda y: len(list_filter(b, lambda z: z = y)))), 0)::DOUBLE AS most FROM b""")
def text_hashed_features(spark, d):
    docs = _read(spark, d, "conversations").select("conv_id", "turn", FE.words(F.col("text")).alias("w"))
    counts = FE.hashed_counts(F.col("w"), 1 << 14, FE.md5_hash)
    made = docs.select("conv_id", "turn", "w", counts.alias("c"))
    return made.select(
        "conv_id", "turn", FE.single_bucket(F.col("w"), hashed=FE.md5_hash).alias("bucket"), F.size("c").alias("n_buckets"), F.size("w").alias("n_words"),
        F.coalesce(F.array_max(F.map_values("c")), F.lit(0.0)).alias("most"),
    )


# reshaping


@query("WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS col, unnest(embedding) AS x FROM embeddings) SELECT col::INTEGER AS col, count(*)::INTEGER AS n, round(sum(x::DOUBLE), 4) + 0.0 AS total, round(min_by(x, vec_id)::DOUBLE, 6) + 0.0 AS first FROM c GROUP BY col")
def reshape_transpose(spark, d):
    t = files.transpose(_points(spark, d).select(F.col("id").alias("row"), V.wide("vec").alias("vec")))
    return t.select("col", F.size("vec").alias("n"), _r(V.total(F.col("vec")), 4).alias("total"), _r(F.col("vec")[0]).alias("first"))


@query("SELECT doc_id::VARCHAR AS pid, quality::VARCHAR AS label, n_chars FROM documents JOIN labels USING (doc_id)")
def join_point_cluster(spark, d):
    matrix = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pid"), F.array(F.col("n_chars").cast("float")).alias("vec"), F.col("doc_id").alias("seq"), "n_chars")
    clusters = _read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("pid"), F.col("quality").cast("string").alias("label"))
    return files.join_clusters(matrix, clusters).join(matrix.select("pid", "n_chars"), "pid").select("pid", "label", "n_chars")


@query("SELECT doc_id, md5('34|' || doc_id) AS shuffle_key FROM documents")
def deterministic_shuffle(spark, d):
    """Documents in the order of their hash with a seed, by which they are range-partitioned."""
    return files.shuffled(_read(spark, d, "documents").select("doc_id"), 1, "doc_id")


@query("SELECT vec_id, md5('node-' || vec_id) AS name, regexp_replace(coalesce(label::VARCHAR, 'None'), '[^\\w .:-]', '_', 'g') AS clean FROM embeddings")
def node_names(spark, d):
    e = _read(spark, d, "embeddings")
    return e.select("vec_id", FE.node_name(F.col("vec_id")).alias("name"), FE.clean_label(F.col("label").cast("string")).alias("clean"))


@query(f"""WITH {_E}, k AS (SELECT count(*) AS n FROM e), x AS (SELECT a.id, list_inner_product(a.v, b.v) - list_inner_product(a.v, c.v) AS z FROM k, e a JOIN e b ON b.id = (a.id + 1) % (SELECT n FROM k) JOIN e c ON c.id = (a.id + 7) % (SELECT n FROM k))
SELECT count(*) AS n, round(avg(ln(1 + exp(-(z - 1.0)))), 6) AS loss FROM x""")
def triplet_loss(spark, d):
    p = _points(spark, d).select("id", V.wide("vec").alias("v"))
    n = p.count()
    side = lambda c, s: p.select(F.pmod(F.col("id") - s, F.lit(n)).alias("id"), F.col("v").alias(c))
    rows = side("a", 0).join(side("p", 1), "id").join(side("n", 7), "id")
    loss = train.margin_loss(V.dot(F.col("a"), F.col("p")), V.dot(F.col("a"), F.col("n")))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(loss), 6).alias("loss"))


@query("WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY ALL), f AS (SELECT * FROM s WHERE n <= 50) SELECT conv_id, n FROM f ORDER BY n DESC, conv_id LIMIT 50")
def dev_blocks(spark, d):
    """The largest 50 blocks of at most 50 rows."""
    sizes = _read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return sizes.where("n <= 50").orderBy(F.desc("n"), "conv_id").limit(50)


@query("WITH c AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, pos::INTEGER AS pos, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(sum(x), 5) + 0.0 AS total, round(var_pop(x), 8) AS variance FROM c GROUP BY label, pos")
def value_moments(spark, d):
    x = F.col("x").cast("double")
    return _read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.count("*").alias("n"), _r(F.avg(x)).alias("mean"), _r(F.sum(x), 5).alias("total"), F.round(F.var_pop(x), 8).alias("variance"))


# learned trees: no SQL form; tests compare them with plain versions


@query()
def hac_rounds(spark, d):
    return hac.rounds(_points(spark, d).select("id", "vec")).select("node", "parent", _r("height").alias("height"), "size")


@query()
def hac_by_block(spark, d):
    return hac.within_blocks(_points(spark, d), "label").select("block", "step", "left", "right", _r("distance").alias("distance"), "size")


def _online_points(spark: SparkSession, d: str) -> DataFrame:
    # no column of the table is a canopy: one tree over all points
    return _points(spark, d).select(F.col("id").cast("string").alias("pid"), F.col("label").cast("string").alias("label"), "vec", F.col("id").alias("seq"))


@query()
def online_tree(spark, d):
    return online.build(_online_points(spark, d), online.ClusterConfig())


@query()
def online_tree_average(spark, d):
    return online.build(_online_points(spark, d), online.ClusterConfig(linkage="average", rotate_cap=100, graft_cap=100, restructure_cap=100, single_search=True, single_elimination=True))


@query()
def online_tree_collapsed(spark, d):
    return online.build(_online_points(spark, d), online.ClusterConfig(max_leaves=40))


@query()
def online_after_batch(spark, d):
    """A batch tree of the first 50 points, extended one by one."""
    return online.build(_online_points(spark, d), online.ClusterConfig(batch=50))


@query()
def online_statistics(spark, d):
    return online.run_statistics(_online_points(spark, d), online.ClusterConfig())


@query()
def learned_weights(spark, d):
    p = _points(spark, d).select("id", "vec", F.col("label").alias("kind"), F.col("label").alias("cluster"))
    specs = [FE.FeatureSpec("vec"), FE.FeatureSpec("kind", "no_match")]
    fit = train.fit_weights(train.sample_triplets(p, 30), p, specs, steps=10)
    return spark.createDataFrame([(n, w, b) for n, (w, b) in sorted(fit.weights.learned.items())], "feature string, weight double, bias double")


@query()
def dev_threshold(spark, d):
    p = _points(spark, d).select("id", "vec", F.col("label").alias("gold"), F.lit(0).alias("block"))
    return train.best_threshold(p, "block", [0.5, 0.8, 1.1, 1.4, 1.7, 2.0])


_COLOURS = ", ".join(f"'{c}'" for c in files.COLOURS)


@query(HEAP + f""", {_COUNTS}, {_STRICT}, t AS (SELECT node, label::VARCHAR AS label, n, row_number() OVER (PARTITION BY node ORDER BY n DESC, label::VARCHAR) AS place FROM cnt),
c AS (SELECT node, string_agg(label || '=' || n, '\\n' ORDER BY place) AS classes, count(*) AS kinds, min(label) AS one FROM t WHERE place <= 10 GROUP BY node),
p AS (SELECT cnt.node, round(max(cnt.n) / any_value(tot.n), 3) AS purity FROM cnt JOIN tot USING (node) GROUP BY cnt.node)
SELECT 'digraph tree {{' AS line UNION ALL SELECT '}}' UNION ALL SELECT '"' || parent || '" -> "' || node || '";' FROM nodes WHERE parent IS NOT NULL
UNION ALL SELECT '"' || node || '" [style=filled,fillcolor=' || CASE WHEN kinds = 1 THEN [{_COLOURS}][{_BUCKET.format("one")} % {len(files.COLOURS)} + 1] ELSE 'grey' END || CASE WHEN parent IS NULL THEN ',shape=star' ELSE '' END
  || ',label="' || node || '\\n' || every.n || ' leaves\\npurity ' || coalesce(purity::VARCHAR, '-') || '\\n' || coalesce(classes, '') || '"];' FROM nodes JOIN every USING (node) LEFT JOIN p USING (node) LEFT JOIN c USING (node)""")
def tree_dot(spark, d):
    return files.dot_lines(heap(spark, d))
