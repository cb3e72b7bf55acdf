"""What the rounds of an iteration counted, observed while their tables are written."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from grovekit.plans.session import checkpointed


class Rounds:
    """One row of metrics for each round: the given aggregates of its table, and its seconds.

    The aggregates are part of the job that writes the table
    (``DataFrame.observe``), so they need no pass of their own.
    """

    def __init__(self, **metrics: Column) -> None:
        self.metrics = metrics
        self.rows: list[dict] = []
        self.kinds = T.StructType()  # of the metrics, known with the first round

    def checkpointed(self, df: DataFrame) -> tuple[DataFrame, dict]:
        """The table written to the checkpoint folder, and its metrics."""
        seen, begun = Observation(), time.monotonic()
        named = [c.alias(n) for n, c in self.metrics.items()]
        self.kinds = df.agg(*named).schema
        done = checkpointed(df.observe(seen, *named))
        row = {"round": len(self.rows), **seen.get, "seconds": time.monotonic() - begun}
        self.rows.append(row)
        return done, row

    def table(self, spark: SparkSession) -> DataFrame:
        """The rounds so far, one row each: a few rows, as many as the iteration took."""
        kinds = T.StructType([T.StructField("round", T.IntegerType()), *self.kinds.fields, T.StructField("seconds", T.DoubleType())])
        return spark.createDataFrame([tuple(r[n] for n in kinds.names) for r in self.rows], kinds)
