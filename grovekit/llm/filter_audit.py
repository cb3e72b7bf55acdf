"""Audit of how filters interact: what each removes in every order of application.

1. *Failures.*  One pass over the texts gives each document's failed filters as
   bits and a digest of its text; E, the repeat of a smaller doc_id's text, is
   joined from the least doc_id of each digest that occurs more than once.
2. *First failure.*  ``FIRST[mask, order]`` is the step (0 to 4) at which an order
   removes a document that fails ``mask``, or 5.  Tasks look each row up for all
   120 orders and add up removals by part, order and step with ``np.bincount``,
   once for all documents and once for each label.
3. *Sums.*  A task's arrays go out as rows of (part, cell) and are summed, first
   where they were made, so no task gathers a part.  All other figures follow
   from these sums.

Filters (words are the runs of ``[^\\x20\\x09-\\x0D]``): A under 50 words; B
distinct words under 65 %; C ``[A-Z]`` over 5 % of the code points; D any of
``[#$%&*|]``; E as above.

Defined results: a null text counts as empty; a null part is the empty string; a
null doc_id counts as greater than all others, so such a row fails E if any row
with an id has its text, and never because of another without one; rows that
repeat a doc_id don't fail E through each other; several labels of one doc_id
count as 1 if any is 1, a null or missing label as 0; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm import scratch

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
CELLS = len(ORDERS) * STEPS
#: Distinct parts that a task adds up before it sends its arrays on (1.2 MB for each 100).
PARTS_AT_ONCE = 200
#: Bytes of a text whose words are split at once.
BLOCK = 1 << 20
_UPPER = bytes(range(0x41, 0x5B))
_SIGNS = [b"#", b"$", b"%", b"&", b"*", b"|"]
_CONTINUED = bytes(range(0x80, 0xC0))


def first_failures() -> np.ndarray:
    """(32, 120): the step at which an order removes a document, ``STEPS`` if it doesn't."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for o, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            table[(np.arange(1 << STEPS) >> FILTERS.index(order[step])) & 1 == 1, o] = step
    return table


FIRST = first_failures()


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """The text's words, in blocks that end between words."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and text[end] not in b" \t\n\x0b\f\r":
            end += 1
        yield text[at:end].split()
        at = end


def failed(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words, distinct = 0, set()
    for block in _blocks(text):
        words += len(block)
        distinct.update(block)
    points = len(text.translate(None, _CONTINUED))
    upper = len(text) - len(text.translate(None, _UPPER))
    signs = any(s in text for s in _SIGNS)
    return (words < 50) | (100 * len(distinct) < 65 * words) << 1 | (100 * upper > 5 * points) << 2 | signs << 3


def failures(docs: DataFrame, part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, part, mask, digest): A to D of each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(2).to_pylist()]
            mask = pa.array([failed(t) for t in texts], pa.int32())
            digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), mask, digest], names=["doc_id", "part", "mask", "digest"])

    scratch.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(read, "doc_id long, part string, mask int, digest binary")


def with_repeats(found: DataFrame) -> DataFrame:
    """(doc_id, part, mask) with E's bit, over the stored rows of ``failures``."""
    # written first, so that a digest of very many rows is a join whose skew Spark splits
    firsts, _ = scratch.settle(found.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").select("digest", "least"), "repeats")
    repeats = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("least")))
    return found.join(firsts, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(repeats, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def _arrays(labelled: DataFrame) -> DataFrame:
    """(part, cell, n, good, toxic): each task's sums; cells 0 to 599 are removals at (order, step), then come the failing and the only-failing of each filter, then all."""
    bits = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1
    alone = np.arange(1 << STEPS)[:, None] == 1 << np.arange(STEPS)
    further = np.hstack([bits, alone, np.ones((1 << STEPS, 1))])
    orders = np.arange(len(ORDERS)) * STEPS

    def sums(part: np.ndarray, mask: np.ndarray, weights: np.ndarray, n_parts: int) -> np.ndarray:
        """(parts, cells) of one batch."""
        steps = FIRST[mask]
        gone = steps < STEPS
        cell = (part[:, None] * CELLS + orders + steps)[gone]
        removed = np.bincount(cell, np.broadcast_to(weights[:, None], gone.shape)[gone], n_parts * CELLS).reshape(n_parts, CELLS)
        masks = np.bincount(part * len(bits) + mask, weights, n_parts * len(bits)).reshape(n_parts, len(bits))
        return np.hstack([removed, masks @ further])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, a in held.items():
                cell = np.flatnonzero(a[0])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), *[pa.array(x[cell].astype(np.int64)) for x in a]], names=["part", "cell", "n", "good", "toxic"])
            held.clear()

        for batch in batches:
            for at in range(0, len(batch), 8192):
                block = batch.slice(at, 8192)
                coded = block.column(0).dictionary_encode()
                names, part = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                mask = block.column(1).to_numpy()
                for low in range(0, len(names), PARTS_AT_ONCE):
                    mine = (part >= low) & (part < low + PARTS_AT_ONCE)
                    some = names[low : low + PARTS_AT_ONCE]
                    weights = [np.ones(int(mine.sum())), *(block.column(c).to_numpy()[mine].astype(float) for c in (2, 3))]
                    made = np.stack([sums(part[mine] - low, mask[mine], w, len(some)) for w in weights], axis=1)
                    for name, a in zip(some, made, strict=True):
                        held[name] = held[name] + a if name in held else a
                    if len(held) > PARTS_AT_ONCE:
                        yield from out()
        yield from out()

    return labelled.select("part", "mask", "good", "toxic").mapInArrow(add_up, "part string, cell int, n long, good long, toxic long")


def figures(cells: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part from its summed cells, of which there are 611 at most."""
    n, good, toxic = np.zeros((3, CELLS + 2 * STEPS + 1), np.int64)
    for a, name in ((n, "n"), (good, "good"), (toxic, "toxic")):
        a[cells["cell"]] = cells[name]
    removed = n[:CELLS].reshape(len(ORDERS), STEPS)
    filters = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
    shapley = np.bincount(filters.ravel(), removed.ravel(), STEPS).astype(np.int64)
    table = {
        "kept": n[-1] - np.cumsum(removed, axis=1),
        "removed": removed,
        "redundant": n[CELLS : CELLS + STEPS][filters] - removed,
        "unique_fails": n[CELLS + STEPS : -1][filters],
        "good_lost": good[:CELLS],
        "toxic_lost": toxic[:CELLS],
        "shapley": shapley[filters],
    }
    of = {"part": cells["part"].iloc[0], "filter_order": np.repeat(ORDERS, STEPS), "step": np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))}
    return pd.DataFrame(of | {k: v.ravel() for k, v in table.items()})


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    found, _ = scratch.settle(failures(docs, part, key, text), "failures")
    flag = lambda name: F.max((F.col(name) == 1).cast("int")).alias(f"is_{name}")
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    labelled = with_repeats(found).join(known, "doc_id", "left").select("part", "mask", F.coalesce("is_quality", F.lit(0)).alias("good"), F.coalesce("is_toxic", F.lit(0)).alias("toxic"))
    summed = _arrays(labelled).groupBy("part", "cell").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return summed.groupBy("part").applyInPandas(figures, f"part string, filter_order string, step int, {counts}")


_FAILS = ["words < 50", "100 * distinct_words < 65 * words", "100 * upper > 5 * points", "signs", "coalesce(m.doc_id > least, least IS NOT NULL)"]
#: The same rows in DuckDB.
SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
m AS (
  SELECT doc_id, part, least, len(w) AS words, len(list_distinct(w)) AS distinct_words, length(t) AS points,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, regexp_matches(t, '[#$%&*|]') AS signs FROM cut),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
bits AS (
  SELECT part, [{", ".join(f"({c})::BOOLEAN" for c in _FAILS)}] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM m LEFT JOIN known ON m.doc_id = known.doc_id),
masks AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM bits GROUP BY 1, 2),
letter AS (SELECT unnest(range(1, 6)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
each AS (
  SELECT part, o, step, o[step] AS f, n, good, toxic, fails[o[step]] AS fail,
    len(list_filter(o[:step - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_fails
  FROM masks, orders, (SELECT unnest(range(1, 6)) AS step)),
summed AS (
  SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fail), 0) AS redundant, coalesce(sum(n) FILTER (fail AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fail), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fail), 0) AS toxic_lost
  FROM each GROUP BY part, o, step, f)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
"""
