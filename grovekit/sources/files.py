"""Readers and writers of the text formats: points, trees, libsvm, id files, DOT, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions.features import clean_label, md5_hash
from grovekit.functions import vectors as V
from grovekit.operators import evaluate, tree

POINT = "pid string, label string, vec array<float>, seq long"


def read_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(value, seq): lines in file order within a file; files follow by name.

    seq is the line's rank by (file, offset): the input is read in splits, so
    ranks come from one count for each split, not from a single task.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    placed = lines.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    part = F.shiftrightunsigned("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(F.struct("file_path", "file_block_start")).alias("first")).collect()  # one row for each split
    starts, total = {}, 0
    for r in sorted(sizes, key=lambda r: (r["first"]["file_path"], r["first"]["file_block_start"])):
        starts[r["part"]] = total
        total += r["n"]
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else F.create_map().cast("map<bigint,bigint>")
    return placed.select("value", (F.element_at(start, part.cast("long")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("seq"))


def _points(lines: DataFrame, parts: Column, first: int) -> DataFrame:
    numbers = F.filter(F.slice(parts, first, F.greatest(F.size(parts) - first + 1, F.lit(0))), lambda x: x != "")
    return lines.select(parts[0].alias("pid"), parts[1].alias("label"), F.transform(numbers, lambda x: x.cast("float")).alias("vec"), "seq")


def read_points(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Tab-separated pid, label, x1 .. xd; a line of fewer than two fields is an error."""
    lines = read_lines(spark, path, recursive).where("value <> ''")
    parts = F.split("value", "\t")
    checked = F.when(F.size(parts) >= 2, parts).otherwise(F.raise_error(F.concat(F.lit("not a point: "), "value")).cast("array<string>"))
    return _points(lines, checked, 3)


def write_points(points: DataFrame, path: str) -> None:
    row = F.concat_ws("\t", F.col("pid").cast("string"), F.coalesce(F.col("label").cast("string"), F.lit("None")), F.transform("vec", lambda x: x.cast("string")))
    points.select("seq", row.alias("value")).orderBy("seq").select("value").write.text(path)


def read_libsvm(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """``label idx:val ...`` with indices from 1; the pid is the line's number from 0."""
    lines = read_lines(spark, path).where("trim(value) <> ''")
    parts = F.split(F.trim("value"), r"\s+")
    pairs = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda p: F.split(p, ":"))
    cells = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p[0].cast("int"), p[1].cast("float"))))
    vec = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.coalesce(F.try_element_at(cells, i), F.lit(0.0).cast("float")))
    return lines.select(F.col("seq").cast("string").alias("pid"), parts[0].alias("label"), vec.alias("vec"), "seq")


def read_class_last(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated id, x1 .. xd, class: the id is dropped, the pid is the line's number."""
    lines = read_lines(spark, path).where("value <> ''")
    parts = F.split("value", ",")
    numbers = F.slice(parts, 2, F.size(parts) - 2)
    return lines.select(F.col("seq").cast("string").alias("pid"), F.element_at(parts, -1).alias("label"), F.transform(numbers, lambda x: x.cast("float")).alias("vec"), "seq")


def join_clusters(matrix: DataFrame, clusters: DataFrame) -> DataFrame:
    """``matrix(pid, vec, seq)`` with the labels of ``clusters(pid, label)``; rows without one go."""
    return matrix.join(clusters, "pid").select("pid", "label", "vec", "seq")


def transpose(rows: DataFrame, row: str = "row", vec: str = "vec") -> DataFrame:
    """(col, vec): the transposed matrix, with values in order of ``row``."""
    cells = rows.select(F.col(row).alias("r"), F.posexplode(vec).alias("col", "x"))
    return cells.groupBy("col").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "x"))), lambda s: s["x"]).alias("vec"))


def shuffled(points: DataFrame, turn: int = 0, key: str = "pid", seed: int = 33) -> DataFrame:
    """The points in the order of a hash of (seed + turn, key), with a new ``seq``."""
    place = F.md5(F.concat_ws("|", F.lit(seed + turn), F.col(key).cast("string")))
    return points.withColumn("shuffle_key", place).orderBy("shuffle_key", key)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("pid")).where("pid <> ''")


def write_tree(nodes: DataFrame, path: str) -> None:
    """Tab-separated node, parent, label, from the root down; missing values are None."""
    depth = tree.closure(nodes).groupBy("node").agg(F.max("dist").alias("depth"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    nodes.join(depth, "node").orderBy("depth", "node").select(F.concat_ws("\t", text("node"), text("parent"), text("label")).alias("value")).write.text(path)


def read_tree(spark: SparkSession, path: str, one_root: bool = True) -> DataFrame:
    """(node, parent, label) as strings; a line without exactly three fields, or a second root, is an error."""
    parts = F.split("value", "\t")
    ok = F.when(F.size(parts) == 3, parts).otherwise(F.raise_error(F.concat(F.lit("not a tree line: "), "value")).cast("array<string>"))
    nodes = spark.read.text(path).where("value <> ''").select(ok.alias("p")).select(F.col("p")[0].alias("node"), tree.label_of_pairs(F.col("p")[1]).alias("parent"), tree.label_of_pairs(F.col("p")[2]).alias("label"))
    if one_root:
        roots = tree.root(nodes).count()
        if roots != 1:
            raise ValueError(f"{roots} roots")
    return nodes


#: Colours of pure classes, in turn; nodes of several classes are grey.
COLOURS = "lightblue gold palegreen salmon plum khaki orange cyan pink tan".split()


def dot_lines(nodes: DataFrame) -> DataFrame:
    """(line): a Graphviz digraph: each node with its size, purity and top classes."""
    anc = tree.closure(nodes)
    leaf = tree.leaves(nodes)
    tops = evaluate.class_top(anc, leaf, 10).groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label", "n"))), lambda s: F.concat(clean_label(s["label"]), F.lit("="), s["n"].cast("string"))), "\\n").alias("classes"), F.count("*").alias("kinds"), F.min("label").alias("only"))
    said = nodes.join(tree.leaf_counts(anc, leaf), "node").join(evaluate.node_purity(anc, leaf), "node", "left").join(tops, "node", "left")
    colour = F.when(F.col("kinds") == 1, F.element_at(F.array(*[F.lit(c) for c in COLOURS]), (F.pmod(md5_hash(F.col("only")), F.lit(len(COLOURS))) + 1).cast("int"))).otherwise("grey")
    name = lambda c: F.concat(F.lit('"'), clean_label(F.col(c).cast("string")), F.lit('"'))
    body = said.select(F.concat(name("node"), F.lit(' [style=filled,fillcolor='), colour, F.when(F.col("parent").isNull(), ",shape=star").otherwise(""), F.lit(',label="'), F.col("node").cast("string"), F.lit("\\n"), F.col("n_leaves").cast("string"), F.lit(" leaves\\npurity "), F.coalesce(F.round("purity", 3).cast("string"), F.lit("-")), F.lit("\\n"), F.coalesce("classes", F.lit("")), F.lit('"];')).alias("line"))
    arrows = nodes.where("parent is not null").select(F.concat(name("parent"), F.lit(" -> "), name("node"), F.lit(";")).alias("line"))
    spark = nodes.sparkSession
    end = lambda s: spark.createDataFrame([(s,)], "line string")
    return end("digraph tree {").unionByName(body).unionByName(arrows).unionByName(end("}"))


def write_result(spark: SparkSession, path: str, algorithm: str, dataset: str, value: float) -> None:
    """Appends one line ``algorithm, dataset, value``."""
    spark.createDataFrame([(f"{algorithm}\t{dataset}\t{value}",)], "value string").coalesce(1).write.mode("append").text(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes one string as one file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").mode("overwrite").text(path)


def save_version(nodes: DataFrame, path: str, version: int) -> None:
    """A snapshot of the tree without derived columns, as one partition."""
    derived = ("sum", "sumsq", "score", "centroid")
    nodes.drop(*derived).withColumn("tree_version", F.lit(version)).write.mode("append").partitionBy("tree_version").parquet(path)


def load_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("tree_version") == version).drop("tree_version")


def normalised(points: DataFrame) -> DataFrame:
    """Points with ``vec`` divided by ``weight``."""
    return points.withColumn("vec", V.divide(V.wide("vec"), F.col("weight").cast("double")))
