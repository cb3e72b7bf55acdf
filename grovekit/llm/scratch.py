"""Working tables in the folder that the cluster shares.

The folder is the session's ``spark.checkpoint.dir``. Only on a local master
where that is unset (tests) a temporary folder is made and set; on a cluster an
unset folder is an error.  Tables written here survive the loss of any executor,
and cut lineage as a checkpoint does.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that Spark hands to a Python worker at once, so that a batch of long texts stays small.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
_MADE: dict[str, SparkSession] = {}


def root(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="grovekit-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver exits."""
    path = f"{root(spark)}/grovekit/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_sweep)
    _MADE[path] = spark
    return path


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)
        _MADE.pop(path, None)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python workers in batches of ``BATCH_BYTES`` at most.

    The operators that read whole texts in Python set this for the session, as
    the rows that they return are read by jobs that they don't start.
    """
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def settle(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back, with its path."""
    spark = df.sparkSession
    path = fresh(spark, name)
    small_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _sweep() -> None:
    for path, spark in list(_MADE.items()):
        try:
            drop(spark, path)
        except Exception:  # the session is gone already
            return
