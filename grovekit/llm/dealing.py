"""Pairs dealt out with what both sides have, so that no key gathers in one task.

Also the way in which tasks read such rows: one side once, then its partners as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partners of one row that meet it in a task, about.
SALT = 64
#: Rows of ids up to this many are broadcast to what they are joined with (some 16 MB), and shuffled beyond.
FEW = 200_000


def listed(ids: DataFrame, few: bool) -> DataFrame:
    """``ids``, to be broadcast if they are few."""
    return F.broadcast(ids) if few else ids


def dealt(pairs: DataFrame, data: DataFrame, *columns: str, few: bool = False) -> DataFrame:
    """(a, salt, own, b, columns): for each pair (a, b) what b has, after a row marked ``own`` that holds what a has.

    ``data`` has ``node``, each once, and the columns.  The partners of one a
    are dealt to about one salt for each ``SALT``, so an a of any number of pairs
    is spread over tasks, and a task holds one a at a time.  The data are read
    once, for both sides.  If the pairs are ``few``, they go to where the data
    are, which are then shuffled once.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.ceil(F.col("many") / SALT)
    many = pairs.groupBy("a").agg(F.count("*").alias("many"))
    partners = pairs.join(listed(many, few), "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), salts).alias("salt"), F.lit(False).alias("own"))
    leaders = many.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(True).alias("own"))
    met = data.join(listed(leaders.unionByName(partners), few), "node").select("a", "salt", "own", F.col("node").alias("b"), *columns)
    return met.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.desc("own"))
