"""Queries that write with a sink and read back with the matching source, each with its DuckDB counterpart.

Files go to the session's shared folder and are removed when the driver exits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions import features as FE
from grovekit.functions import vectors as V
from grovekit.operators import hac, train, tree
from grovekit.plans.catalogue import _E, _HEAP, _points, _r, _read, heap, query
from grovekit.plans.session import fresh
from grovekit.sources import files


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("pid"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>").alias("vec"), F.col("vec_id").alias("seq"))


_TOLD = "len(v)::INTEGER AS dim, round(list_sum(v), 4) + 0.0 AS total, round(v[1], 6) + 0.0 AS first"


def _told(points: DataFrame, *more: str) -> DataFrame:
    vec = V.wide("vec")
    return points.select("pid", "label", F.size("vec").alias("dim"), _r(V.total(vec), 4).alias("total"), _r(vec[0]).alias("first"), *more)


@query(f"WITH {_E} SELECT id::VARCHAR AS pid, label::VARCHAR AS label, {_TOLD}, row_number() OVER (ORDER BY id) - 1 AS seq FROM e")
def stored_points(spark, d):
    """Points written as tab-separated lines and read again, in order."""
    path = fresh(spark, "points")
    files.write_points(_rows(spark, d), path)
    return _told(files.read_points(spark, path), "seq")


@query(f"WITH {_E} SELECT id::VARCHAR AS pid, label::VARCHAR AS label, {_TOLD} FROM e")
def stored_points_by_folder(spark, d):
    """Points in a folder for each label, listed recursively."""
    path = fresh(spark, "folders")
    line = F.concat_ws("\t", "pid", "label", F.transform("vec", lambda x: x.cast("string")))
    _rows(spark, d).select(F.col("label").alias("kind"), line.alias("value")).write.partitionBy("kind").text(path)
    return _told(files.read_points(spark, path, recursive=True))


@query("SELECT c_name AS value, row_number() OVER (ORDER BY c_custkey) - 1 AS seq FROM customer")
def stored_lines(spark, d):
    """Lines with their place."""
    path = fresh(spark, "lines")
    _read(spark, d, "customer").orderBy("c_custkey").select(F.col("c_name").alias("value")).write.text(path)
    return files.read_lines(spark, path)


@query(f"WITH {_HEAP} SELECT node::VARCHAR AS node, parent::VARCHAR AS parent, label::VARCHAR AS label FROM nodes")
def stored_tree(spark, d):
    path = fresh(spark, "tree")
    files.write_tree(heap(spark, d), path)
    return files.read_tree(spark, path)


@query(f"WITH {_HEAP}, two AS (SELECT * FROM nodes UNION ALL SELECT -1, NULL, 'apart') SELECT node::VARCHAR AS node, parent::VARCHAR AS parent, label::VARCHAR AS label FROM two")
def stored_forest(spark, d):
    """Two trees in one file."""
    path = fresh(spark, "forest")
    apart = spark.createDataFrame([(-1, None, "apart")], "node long, parent long, label string")
    files.write_tree(heap(spark, d).unionByName(apart), path)
    return files.read_tree(spark, path, one_root=False)


@query(f"WITH {_E} SELECT (row_number() OVER (ORDER BY id) - 1)::VARCHAR AS pid, label::VARCHAR AS label, {_TOLD} FROM e")
def stored_libsvm(spark, d):
    """Sparse lines with indices from 1, read as dense vectors."""
    path = fresh(spark, "libsvm")
    cells = F.transform("vec", lambda x, i: F.concat_ws(":", (i + 1).cast("string"), x.cast("string")))
    _rows(spark, d).orderBy("seq").select(F.concat_ws(" ", "label", cells).alias("value")).write.text(path)
    dim = _rows(spark, d).select(F.size("vec")).first()[0]
    return _told(files.read_libsvm(spark, path, dim))


@query(f"WITH {_E} SELECT (row_number() OVER (ORDER BY id) - 1)::VARCHAR AS pid, label::VARCHAR AS label, {_TOLD} FROM e")
def stored_class_last(spark, d):
    """Comma-separated id, values, class."""
    path = fresh(spark, "csv")
    _rows(spark, d).orderBy("seq").select(F.concat_ws(",", "pid", F.transform("vec", lambda x: x.cast("string")), "label").alias("value")).write.text(path)
    return _told(files.read_class_last(spark, path))


@query("SELECT n_name AS pid FROM nation WHERE n_name <> ''")
def stored_ids(spark, d):
    path = fresh(spark, "ids")
    _read(spark, d, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("value")).union(spark.createDataFrame([("",)], "value string")).write.text(path)
    return files.read_ids(spark, path)


@query("SELECT 'sizes' AS algorithm, t AS dataset, n::DOUBLE AS value FROM (SELECT 'documents' AS t, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'embeddings', count(*) FROM embeddings)")
def stored_results(spark, d):
    """Result lines, appended one by one."""
    path = fresh(spark, "results")
    for name in ("documents", "pages", "embeddings"):
        files.write_result(spark, path, "sizes", name, float(_read(spark, d, name).count()))
    p = F.split("value", "\t")
    return spark.read.text(path).select(p[0].alias("algorithm"), p[1].alias("dataset"), p[2].cast("double").alias("value"))


@query("SELECT 'the whole text' || chr(10) || 'of a file' || chr(10) AS value")
def stored_text(spark, d):
    """A string as a file, read whole."""
    path = fresh(spark, "text")
    files.write_text(spark, path, "the whole text\nof a file")
    return spark.read.text(path, wholetext=True)


@query(f"WITH {_HEAP}, v AS (SELECT unnest([1, 2, 3]) AS version) SELECT version::INTEGER AS version, node, parent, label::VARCHAR AS label FROM nodes, v WHERE node <= 2 * version + 1")
def stored_versions(spark, d):
    """A snapshot of a growing tree after each step, without the columns that can be derived."""
    path, h = fresh(spark, "versions"), heap(spark, d)
    for version in (1, 2, 3):
        files.save_version(h.where(F.col("node") <= 2 * version + 1).withColumn("score", F.lit(0.5)), path, version)
    one = lambda v: files.load_version(spark, path, v).select(F.lit(v).alias("version"), "node", "parent", "label")
    return one(1).unionByName(one(2)).unionByName(one(3))


@query(f"WITH {_E} SELECT id, round(list_sum(v) / (1 + id % 4), 5) + 0.0 AS total, round(v[1] / (1 + id % 4), 7) + 0.0 AS first FROM e")
def normalised_values(spark, d):
    """Values divided by a weight."""
    made = files.normalised(_points(spark, d).withColumn("weight", 1 + F.col("id") % 4))
    return made.select("id", _r(V.total(F.col("vec")), 5).alias("total"), _r(F.col("vec")[0], 7).alias("first"))


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), m AS (SELECT i AS step, 2 * i AS l, 2 * i + 1 AS r FROM n, range(0, (SELECT n - 1 FROM n)) t(i)),
every AS (SELECT i AS node FROM n, range(0, 2 * (SELECT n FROM n) - 1) t(i))
SELECT node, CASE WHEN node < 2 * n - 2 THEN n + node // 2 END AS parent, CASE WHEN node < n THEN 0.0 ELSE (node - n + 1) * 0.5 END::DOUBLE AS height FROM every, n""")
def merges_to_tree(spark, d):
    """A linkage list, read as a tree: merge i joins nodes 2i and 2i + 1."""
    n = _read(spark, d, "customer").count()
    merges = spark.range(n - 1).select(F.col("id").alias("step"), (2 * F.col("id")).alias("left"), (2 * F.col("id") + 1).alias("right"), ((F.col("id") + 1) * 0.5).alias("distance"), F.lit(2).alias("size"))
    return hac.nodes_of_merges(merges, n)


@query(f"WITH {_HEAP} SELECT parent, min(node) AS left_child, max(node) AS right_child FROM nodes WHERE parent IS NOT NULL GROUP BY parent")
def tree_to_merges(spark, d):
    return hac.merges_of_nodes(heap(spark, d)).toDF("parent", "left_child", "right_child")


@query("SELECT * FROM (VALUES ('vec', 'learned', 0.75, 0.125), ('title', 'learned', 1.0, 0.0001), ('source', 'rule', -20000.0, NULL), ('name', 'rule', 5000.0, NULL), ('threshold', 'cut', 1.5, NULL)) t(feature, kind, weight, bias)")
def stored_weights(spark, d):
    """A learned model with its rules and threshold, saved, loaded and listed."""
    path = fresh(spark, "weights")
    specs = [FE.FeatureSpec(n) for n in ("vec", "title", "source", "name")]
    weights = FE.initial_weights(specs, {"name"}, {"source"})
    weights.learned["vec"] = (0.75, 0.125)
    train.save_weights(weights, spark, path, 1.5)
    found, threshold = train.load_weights(spark, path)
    rows = [(n, "learned", w, b) for n, (w, b) in found.learned.items()] + [(n, "rule", w, None) for n, w in found.rules.items()] + [("threshold", "cut", threshold, None)]
    return spark.createDataFrame(rows, "feature string, kind string, weight double, bias double")


@query(f"WITH {_HEAP} SELECT '\"' || parent || '\" -> \"' || node || '\";' AS line FROM nodes WHERE parent IS NOT NULL")
def dot_arrows(spark, d):
    """The arrows of a tree's Graphviz form."""
    return files.dot_lines(heap(spark, d)).where("line like '% -> %'")
