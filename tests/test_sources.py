"""Round trips of the text formats, and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.operators import tree
from grovekit.sources import files
from grovekit.streaming import incremental


def test_points(spark, tmp_path):
    rows = [("p1", "a", [1.0, 2.5], 0), ("p2", "b", [0.0, -3.0], 1), ("p3", "a", [4.0, 4.0], 2)]
    df = spark.createDataFrame(rows, files.POINT)
    files.write_points(df, f"{tmp_path}/points")
    back = files.read_points(spark, f"{tmp_path}/points").orderBy("seq").collect()
    assert [(r["pid"], r["label"], list(r["vec"])) for r in back] == [r[:3] for r in rows]
    (tmp_path / "bad.tsv").write_text("only\n")
    with pytest.raises(Exception, match="not a point"):
        files.read_points(spark, f"{tmp_path}/bad.tsv").collect()


def test_line_numbers_follow_the_file(spark, tmp_path):
    (tmp_path / "many.txt").write_text("".join(f"line{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = files.read_lines(spark, f"{tmp_path}/many.txt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r["value"] == f"line{r['seq']}" for r in got) and len(got) == 5000


def test_other_formats(spark, tmp_path):
    (tmp_path / "a.libsvm").write_text("3 1:0.5 4:2\n1 2:1\n")
    got = files.read_libsvm(spark, f"{tmp_path}/a.libsvm", 4).orderBy("seq").collect()
    assert [(r["pid"], r["label"], list(r["vec"])) for r in got] == [("0", "3", [0.5, 0, 0, 2]), ("1", "1", [0, 1, 0, 0])]
    (tmp_path / "g.csv").write_text("1,0.1,0.2,7\n2,0.3,0.4,8\n")
    got = files.read_class_last(spark, f"{tmp_path}/g.csv").orderBy("seq").collect()
    assert [(r["pid"], r["label"], len(r["vec"])) for r in got] == [("0", "7", 2), ("1", "8", 2)]
    (tmp_path / "ids").write_text("p1\n\np3\n")
    assert {r["pid"] for r in files.read_ids(spark, f"{tmp_path}/ids").collect()} == {"p1", "p3"}
    m = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row int, vec array<double>")
    assert {r["col"]: list(r["vec"]) for r in files.transpose(m).collect()} == {0: [1, 3], 1: [2, 4]}


def test_tree_files(spark, tmp_path):
    nodes = spark.createDataFrame([(1, None, None), (2, 1, "a"), (3, 1, "b b")], "node long, parent long, label string")
    files.write_tree(nodes, f"{tmp_path}/tree")
    back = files.read_tree(spark, f"{tmp_path}/tree")
    assert {tuple(r) for r in back.collect()} == {("1", None, None), ("2", "1", "a"), ("3", "1", "b b")}
    assert tree.root(back).count() == 1
    (tmp_path / "two.tsv").write_text("1\tNone\tNone\n2\tnull\tx\n")
    with pytest.raises(ValueError):
        files.read_tree(spark, f"{tmp_path}/two.tsv")
    text = [r["line"] for r in files.dot_lines(nodes).collect()]
    assert text[0].startswith("digraph") and sum("->" in x for x in text) == 2 and sum("shape=star" in x for x in text) == 1
    files.save_version(nodes.withColumn("score", F.lit(1.0)), f"{tmp_path}/versions", 1)
    files.save_version(nodes.where("node < 3"), f"{tmp_path}/versions", 2)
    assert files.load_version(spark, f"{tmp_path}/versions", 2).count() == 2
    files.write_result(spark, f"{tmp_path}/res", "alg", "data", 0.5)
    files.write_result(spark, f"{tmp_path}/res", "alg", "data", 0.7)
    assert spark.read.text(f"{tmp_path}/res").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    v = np.random.default_rng(0).standard_normal((30, 4))
    rows = [(str(i % 2), str(i), str(i % 3), v[i].tolist(), i) for i in range(30)]
    df = spark.createDataFrame(rows, incremental.POINTS)
    for part in range(3):
        df.where(F.floor(F.col("seq") / 10) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = incremental.cluster_stream(stream, f"{tmp_path}/state", f"{tmp_path}/ck", availableNow=True)
    q.awaitTermination(120)
    from grovekit.operators.online import build

    got = incremental.current(spark, f"{tmp_path}/state").select("block", "node", "parent", "pid", "n")
    want = build(df, None, "block").select("block", "node", "parent", "pid", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
