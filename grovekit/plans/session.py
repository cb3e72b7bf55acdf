"""What plans need of the session."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Digits of a size in bytes that is believed.
GUESSED = 15
_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master may do without one (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="grovekit-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_folder(spark)}/grovekit/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_sweep)
    _MADE.append((spark, path))
    return path


def _sweep() -> None:
    for spark, path in _MADE:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone already
            return


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder.

    Spark hands its guess at the size on to the written table.  The guess for a
    join is a product, so over rounds that join what earlier rounds wrote it gets
    thousands of digits and planning takes minutes.  Beyond ``GUESSED`` digits the
    table is taken as of unknown size.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    done = df.checkpoint()
    made = done._jdf.queryExecution()
    if len(str(made.optimizedPlan().stats().sizeInBytes())) <= GUESSED:
        return done
    return DataFrame(done._jdf.sparkSession().internalCreateDataFrame(made.toRdd(), done._jdf.schema(), False), df.sparkSession)
