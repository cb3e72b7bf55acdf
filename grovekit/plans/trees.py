"""Queries on linkages, features and rearrangements beyond the basic ones, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovekit.functions import features as FE
from grovekit.functions import vectors as V
from grovekit.operators import knn, online, search, train, tree
from grovekit.plans.catalogue import _BEST, _E, _HEAP_STATS, _SCORE_COS, _SQ, _SUMS, _grid, _grid_sql, _heap_stats, _label_pairs, _online_points, _points, _r, _read, heap, query

# linkage of centroids

_UNIT = "list_transform({0}.v, lambda x: x / sqrt(list_inner_product({0}.v, {0}.v)))"
_MEAN = "list_transform({0}.v, lambda x: x / {0}.n)"
_DOT_UNIT = f"list_inner_product({_UNIT.format('a')}, {_UNIT.format('b')})"
_FAR = f"list_sum(list_transform(list_zip({_MEAN.format('a')}, {_MEAN.format('b')}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_TOP = "list_transform({0}.v, lambda x: x / list_max(list_transform({0}.v, lambda y: abs(y))))"


@query(f"""WITH {_SUMS} SELECT a.label::BIGINT AS a, b.label::BIGINT AS b, round({_DOT_UNIT}, 6) + 0.0 AS unit_dot, round(list_inner_product({_MEAN.format('a')}, {_MEAN.format('b')}), 7) + 0.0 AS mean_dot,
round(1 / (1 + sqrt({_FAR})), 6) AS mean_l2, round(1 / (1 + {_FAR}), 6) AS mean_sql2, round(list_inner_product({_TOP.format('a')}, {_TOP.format('b')}), 5) + 0.0 AS top_dot FROM s a JOIN s b ON a.label < b.label""")
def linkage_centroid_by_label(spark, d):
    """Similarities of the labels' centroids: of unit length, plain, and divided by their largest entry."""
    c = F.col
    link = lambda kind, sim: V.centroid_link(c("a_n"), c("a_sum"), c("b_n"), c("b_sum"), kind, sim)
    return _label_pairs(spark, d).select(
        c("a_node").alias("a"), c("b_node").alias("b"), _r(link("l2", "dot")).alias("unit_dot"), _r(link("none", "dot"), 7).alias("mean_dot"), _r(link("none", "l2")).alias("mean_l2"),
        _r(link("none", "sql2")).alias("mean_sql2"), _r(link("l_inf", "dot"), 5).alias("top_dot"),
    )


_SCORE_UNIT = f"sc AS (SELECT a.node // 2 AS node, {_DOT_UNIT} AS score FROM st a JOIN st b ON b.node = a.node + 1 AND a.node % 2 = 0)"
_SCORE_SQL2 = f"sc AS (SELECT a.node // 2 AS node, 1 / (1 + {_FAR}) AS score FROM st a JOIN st b ON b.node = a.node + 1 AND a.node % 2 = 0)"


@query(f"WITH RECURSIVE {_HEAP_STATS}, {_SCORE_UNIT} SELECT node, round(score, 6) + 0.0 AS score FROM sc")
def node_score_centroid(spark, d):
    h = heap(spark, d)
    return tree.node_scores(h, _heap_stats(spark, d, h, tree.closure(h)), "centroid").select("node", _r("score").alias("score"))


@query(f"WITH RECURSIVE {_HEAP_STATS}, {_SCORE_SQL2} SELECT node, round(score, 6) + 0.0 AS score FROM sc")
def node_score_centroid_distance(spark, d):
    h = heap(spark, d)
    return tree.node_scores(h, _heap_stats(spark, d, h, tree.closure(h)), "centroid", "none", "sql2").select("node", _r("score").alias("score"))


@query(_grid_sql(_DOT_UNIT, _SCORE_UNIT, _BEST))
def graft_best_centroid(spark, d):
    """The best cell of each grid under centroid linkage."""
    return tree.best_graft(_grid(spark, d, "centroid")).withColumn("score", _r("score"))


@query()
def online_tree_centroid(spark, d):
    """One tree over the whole table by centroid linkage, grafting by the full grid."""
    return online.build(_online_points(spark, d), online.ClusterConfig(linkage="centroid", graft_search="grid"))


@query()
def online_tree_extended(spark, d):
    """A stored tree of the first half of the points, grown by the second half."""
    p = _online_points(spark, d).withColumn("block", F.lit("all"))
    half = p.count() // 2
    first, rest = p.where(F.col("seq") < half), p.where(F.col("seq") >= half)
    return online.extend(online.build(first, online.ClusterConfig(), "block"), first, rest, online.ClusterConfig())


# arithmetic on vectors and sparse values


@query(f"""WITH {_E} SELECT a.id AS a, round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] + x[2])), 5) + 0.0 AS added, round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] - x[2])), 5) + 0.0 AS less,
round(list_sum(list_transform(a.v, lambda x: x / 3)), 5) + 0.0 AS third, round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] / (x[2] * x[2] + 1))), 5) + 0.0 AS quotient FROM e a JOIN e b ON b.id = a.id + 1""")
def vector_arithmetic(spark, d):
    p = _points(spark, d).select("id", V.wide("vec").alias("v"))
    both = p.select(F.col("id").alias("a"), F.col("v").alias("x")).join(p.select((F.col("id") - 1).alias("a"), F.col("v").alias("y")), "a")
    x, y = F.col("x"), F.col("y")
    say = lambda c, n: _r(V.total(c), 5).alias(n)
    return both.select("a", say(V.add(x, y), "added"), say(V.subtract(x, y), "less"), say(V.divide(x, F.lit(3.0)), "third"), say(V.ratio(x, F.transform(y, lambda t: t * t + 1)), "quotient"))


_SPARSE = f"{_E}, c AS (SELECT id, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM e), sp AS (SELECT id, pos, x FROM c WHERE x > 0), ids AS (SELECT id FROM e)"


@query(f"""WITH {_SPARSE}, n AS (SELECT id, sum(x * x) AS sq, sum(x) AS total, count(*) AS k FROM sp GROUP BY id), d AS (SELECT a.id, sum(a.x * b.x) AS dot FROM sp a JOIN sp b ON b.id = a.id + 1 AND a.pos = b.pos GROUP BY a.id)
SELECT i.id AS a, round(coalesce(d.dot, 0), 6) + 0.0 AS dot, round(x.sq + y.sq - 2 * coalesce(d.dot, 0), 6) + 0.0 AS far, round(sqrt(x.sq), 6) AS length, round(x.total / 4, 6) + 0.0 AS mean_total, round(x.total / sqrt(x.sq), 5) + 0.0 AS unit_total, x.k::DOUBLE AS kinds
FROM ids i JOIN n x ON x.id = i.id JOIN n y ON y.id = i.id + 1 LEFT JOIN d ON d.id = i.id""")
def sparse_vectors(spark, d):
    """The embeddings' positive entries as sparse vectors: products, distances and centroids."""
    cells = F.map_from_entries(F.filter(F.transform(V.wide("vec"), lambda x, i: F.struct(i.alias("k"), x.alias("v"))), lambda z: z["v"] > 0))
    p = _points(spark, d).select("id", cells.alias("m"))
    both = p.select(F.col("id").alias("a"), F.col("m").alias("x")).join(p.select((F.col("id") - 1).alias("a"), F.col("m").alias("y")), "a")
    x, y, n = F.col("x"), F.col("y"), F.lit(4.0)
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)
    return both.select(
        "a", _r(V.sparse_dot(x, y)).alias("dot"), _r(V.sparse_squared_distance(x, y)).alias("far"), _r(V.sparse_norm(x)).alias("length"), _r(total(V.sparse_centroid(x, n))).alias("mean_total"),
        _r(total(V.sparse_centroid(x, n, "l2")), 5).alias("unit_total"), total(V.sparse_centroid(x, n, "binary")).alias("kinds"),
    )


# records, features and weights


@query(f"""WITH {_E} SELECT a.id AS a, b.id AS b, round(list_inner_product(a.v, b.v) + ({_SQ}) + CASE WHEN a.label <> b.label THEN 1.0 ELSE 0.0 END, 6) + 0.0 AS score FROM e a JOIN e b ON b.id = a.id + 2""")
def unweighted_similarity(spark, d):
    """The plain sum over features."""
    p = _points(spark, d)
    both = p.select(F.col("id").alias("a"), F.col("vec").alias("x"), F.col("label").alias("lx")).join(p.select((F.col("id") - 2).alias("a"), F.col("id").alias("b"), F.col("vec").alias("y"), F.col("label").alias("ly")), "a")
    specs = [FE.FeatureSpec("dot"), FE.FeatureSpec("l2", "l2"), FE.FeatureSpec("label", "no_match")]
    at = lambda v, l: {"dot": F.col(v), "l2": F.col(v), "label": F.col(l)}
    return both.select("a", "b", _r(FE.similarity(specs, at("x", "lx"), at("y", "ly"))).alias("score"))


def _encoders() -> list[FE.Encoder]:
    return [
        FE.Encoder(FE.FeatureSpec("shape", "dot"), F.array(F.log1p("n_chars"), F.length("lang").cast("double"))),
        FE.Encoder(FE.FeatureSpec("source", "no_match"), F.col("source")),
        FE.Encoder(FE.FeatureSpec("lang", "no_match"), F.col("lang")),
    ]


@query("""WITH f AS (SELECT doc_id, ln(1 + n_chars) AS x, len(lang)::DOUBLE AS y, source, lang FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b, round(a.x * b.x + a.y * b.y + 0.0001 + CASE WHEN a.source <> b.source THEN 1.0 ELSE 0.0 END + 0.0001 + CASE WHEN a.lang <> b.lang THEN -20000.0 ELSE 0.0 END, 6) AS score FROM f a JOIN f b ON b.doc_id = a.doc_id + 1 WHERE a.lang IS NOT NULL AND b.lang IS NOT NULL""")
def encoded_records(spark, d):
    """Records encoded as features, and neighbours compared under the initial weights with a must-not-link rule."""
    made = FE.encode(_read(spark, d, "documents").where("lang is not null"), _encoders(), ["doc_id"])
    specs = [e.spec for e in _encoders()]
    weights = FE.initial_weights(specs, must_not_link={"lang"})
    side = lambda c, shift: made.select((F.col("doc_id") - shift).alias("a"), *[F.col(s.name).alias(f"{c}_{s.name}") for s in specs])
    both = side("l", 0).join(side("r", 1), "a")
    score = FE.similarity(specs, *({s.name: F.col(f"{c}_{s.name}") for s in specs} for c in "lr"), weights)
    return both.select("a", (F.col("a") + 1).alias("b"), _r(score).alias("score"))


@query("""WITH s AS (SELECT source AS block, count(*) AS n, count(*) FILTER (WHERE lang IS NOT NULL AND lang <> '-1') AS labelled FROM documents GROUP BY source)
SELECT * FROM s WHERE n < 5000 ORDER BY labelled DESC, block LIMIT 50""")
def dev_blocks_by_labels(spark, d):
    """The sources of fewer than 5000 documents with the most labelled ones."""
    return train.dev_blocks(_read(spark, d, "documents"), "source", "lang")


@query()
def dev_evaluation(spark, d):
    """Pairwise scores at thresholds taken from the trees of the labels."""
    p = _points(spark, d).select("id", "vec", F.col("label").alias("gold"), "label")
    return train.dev_evaluation(p, "label", 5)


# link graphs

_LINKS = "l AS (SELECT conv_id AS src, turn + 1000 AS dst, count(*)::DOUBLE AS score FROM conversations GROUP BY ALL)"


@query(f"WITH {_LINKS} SELECT src, dst, score FROM l WHERE src % 7 <> 0 AND dst % 7 <> 0")
def graph_deleted(spark, d):
    """Links without those of nodes that were deleted."""
    links = _read(spark, d, "conversations").groupBy(F.col("conv_id").alias("src"), (F.col("turn") + 1000).alias("dst")).agg(F.count("*").cast("double").alias("score"))
    ends = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()
    return knn.graph_without(links, ends.where("id % 7 = 0"))


@query(f"WITH {_LINKS}, r AS (SELECT src - src % 3 AS src, dst - dst % 3 AS dst, score FROM l) SELECT src, dst, max(score) AS score FROM r WHERE src <> dst GROUP BY ALL")
def graph_renamed(spark, d):
    """Links after groups of nodes were renamed to one."""
    links = _read(spark, d, "conversations").groupBy(F.col("conv_id").alias("src"), (F.col("turn") + 1000).alias("dst")).agg(F.count("*").cast("double").alias("score"))
    ends = links.select(F.col("src").alias("id")).union(links.select(F.col("dst").alias("id"))).distinct()
    return knn.graph_renamed(links, ends.select("id", (F.col("id") - F.col("id") % 3).alias("new")))


@query(f"""WITH {_E}, s AS (SELECT a.id AS query, b.id AS neighbour, list_inner_product(a.v, b.v) AS score FROM e a JOIN e b ON a.id <> b.id AND abs(a.id - b.id) > 5),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, neighbour) AS rank FROM s) SELECT query, neighbour, round(score, 6) + 0.0 AS score, rank::INTEGER AS rank FROM t WHERE rank <= 2""")
def nn_without_offlimits(spark, d):
    """Nearest neighbours among pairs that a table of barred pairs (ids up to five apart) doesn't list."""
    p = _points(spark, d)
    barred = p.select(F.col("id").alias("query"), F.explode(F.sequence(F.col("id") - 5, F.col("id") + 5)).alias("neighbour"))
    return search.by_features(p, p, [FE.FeatureSpec("vec")], 2, offlimits=barred).withColumn("score", _r("score"))


@query(f"""WITH RECURSIVE {_HEAP_STATS}, {_SCORE_COS} SELECT sc.node, round(score, 6) + 0.0 AS score FROM sc
WHERE NOT EXISTS (SELECT 1 FROM nodes c WHERE c.parent = sc.node AND c.node NOT IN (SELECT node FROM leaf))""")
def collapsible_pairs(spark, d):
    """The nodes of two leaves, with the score by which they would be collapsed."""
    h = heap(spark, d)
    scores = tree.node_scores(h, _heap_stats(spark, d, h, tree.closure(h)), "cosine")
    return scores.join(tree.collapsible(h), "node").select("node", _r("score").alias("score"))


@query()
def online_snapshots(spark, d):
    """The tree over the whole table after each quarter of the insertions."""
    p = _online_points(spark, d)
    return online.snapshots(p, -(-p.count() // 4))
