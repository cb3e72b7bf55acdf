"""Clustering a stream of points, by blocks.

Every micro-batch's new points are inserted, in order, into the stored tree of
their block; a block's cost is its new points times its size, and blocks without
new points aren't read.  State is two sets of versioned Parquet folders; a batch
that is replayed starts from the same older versions and writes the same version
again, so the result is exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grovekit.operators.online import _TREE as TREE
from grovekit.operators.online import ClusterConfig, build, extend

POINTS = "block string, pid string, label string, vec array<double>, seq long"


def update(spark: SparkSession, root: str, batch: DataFrame, version: int, config: ClusterConfig | None = None) -> None:
    """Adds a batch ``(block, pid, label, vec, seq)``; writes ``points/version=`` and the touched blocks' ``trees/version=``.

    A pid that its block has had already isn't added again.
    """
    given = batch.select("block", "pid", "label", F.col("vec").cast("array<double>").alias("vec"), "seq").dropDuplicates(["block", "pid"])
    known = _before(spark, f"{root}/points", POINTS, version)
    if known is not None:
        given = given.join(known.select("block", "pid"), ["block", "pid"], "left_anti")
    given.write.mode("overwrite").parquet(f"{root}/points/version={version}")
    arrived = spark.read.schema(POINTS).parquet(f"{root}/points/version={version}")
    touched = arrived.select("block").distinct()
    trees = _before(spark, f"{root}/trees", TREE, version)
    if known is None or trees is None:
        build(arrived, config, "block").write.mode("overwrite").parquet(f"{root}/trees/version={version}")
        return
    newest = trees.join(touched, "block", "left_semi").groupBy("block").agg(F.max("version").alias("version"))
    stored = trees.join(newest, ["block", "version"]).drop("version")
    extend(stored, known.join(touched, "block", "left_semi").drop("version"), arrived, config).write.mode("overwrite").parquet(f"{root}/trees/version={version}")


def _before(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame | None:
    """What versions before ``version`` hold; None if there are none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    older = [n for n in names if n.startswith("version=") and int(n[8:]) < version]
    return spark.read.schema(schema + ", version long").option("basePath", path).parquet(*[f"{path}/{n}" for n in older]) if older else None


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest tree of each block."""
    trees = spark.read.option("basePath", f"{root}/trees").parquet(f"{root}/trees")
    newest = trees.groupBy("block").agg(F.max("version").alias("version"))
    return trees.join(newest, ["block", "version"])


def cluster_stream(points: DataFrame, root: str, checkpoint: str, config: ClusterConfig | None = None, **trigger) -> StreamingQuery:
    """Starts the stream; ``points(block, pid, label, vec, seq)`` is a streaming DataFrame."""
    spark = points.sparkSession
    writer = points.writeStream.foreachBatch(lambda batch, n: update(spark, root, batch, n, config)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
