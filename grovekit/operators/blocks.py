"""Blocks of rows that meet in tasks, each with each, without a copy of the rows for each block they meet.

``packed`` writes a table once to the checkpoint folder, in blocks of rows that
are bytes in one cell.  ``meet`` is the product of two such tables: a task reads
one block of the left side and, one after the other, the blocks of a group of
the right side.  What is shuffled is the blocks once; what a task holds is two
blocks, a group's bytes and what its comparison keeps.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.plans.session import checkpointed

#: Rows of a block.
BLOCK = 4096
#: Bytes of a group of blocks, which a task's JVM holds at once.
GROUP = 48 << 20


@dataclass(frozen=True)
class Packed:
    """Blocks (place, data) of a table, one to a partition, and how many bytes they are."""

    blocks: DataFrame
    n: int
    size: int


def packed(df: DataFrame, rows: int | None = None) -> Packed:
    """The table in blocks of at most ``rows`` rows; so many, where there are enough rows, that pairs of them occupy the tasks."""
    most, width = rows or BLOCK, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = max(min(256, most), min(most, -(-df.count() // max(1, math.isqrt(width)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - held)
                waiting.append(part)
                held, at = held + part.num_rows, at + part.num_rows
                if held == block:
                    yield _told(waiting)
                    waiting, held = [], 0
        if held:
            yield _told(waiting)

    made = checkpointed(df.mapInArrow(run, "data binary, size long"))
    told = made.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    n = max(1, told["n"])
    return Packed(made.select(F.monotonically_increasing_id().alias("place"), "data"), n, told["size"])


def _told(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(parts).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    data = sink.getvalue().to_pybytes()
    return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], ["data", "size"])


def _read(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def meet(left: Packed, right: Packed, begin: Callable[[pa.Table], object], schema: str) -> DataFrame:
    """The rows that ``begin(left block)`` gives with ``done()``, after ``add(right block)`` for each block of a group."""
    groups = max(1, -(-right.size // GROUP))
    many = left.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")
    groups = min(right.n, max(groups, -(-int(many) // left.n)))  # few blocks on the left: more groups, so that tasks are occupied

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for batch in batches:
            for place, a, b in zip(batch["place"], batch["data"], batch["other"], strict=True):
                if place != now:
                    if held is not None:
                        yield held.done()
                    now, held = place, begin(_read(a))
                held.add(_read(b))
        if held is not None:
            yield held.done()

    spread = left.blocks.repartition(left.n)
    others = right.blocks.select(F.col("data").alias("other")).repartition(groups)
    return spread.crossJoin(others.hint("shuffle_replicate_nl")).mapInPandas(run, schema)


def gathered(df: DataFrame, most: int) -> pa.Table | None:
    """The whole table in the driver, if it is at most ``most`` bytes, else None; it is written first, so that a large one never gets there."""
    made = packed(df, 1 << 16)
    if made.size > most:
        return None
    parts = [_read(bytes(r["data"])) for r in made.blocks.select("data").toLocalIterator()]
    return pa.concat_tables(parts) if parts else None
