"""Line deduplication by pairwise alignment.

1. *Overlapping documents.*  What can be deleted is a run of lines with
   ``min_block_words`` words or more, so the shortest such runs, mostly single
   lines, are hashed (lines are trimmed) and counted over all documents.  A run
   that at most ``RARE`` documents share pairs each of them with all before it.
   A more frequent one pairs each document with the first that holds it (the
   least doc_id), so it nominates no more pairs for a document than a rare one,
   and none has to be left out for its frequency.
2. *Alignment.*  Pairs are aligned by patience diff: the longest run of lines
   that are unique in both documents and in the same order is kept, equal ends
   are matched, and the gaps between are aligned in the same way.  A gap all of
   whose common lines repeat is aligned by their longest common subsequence.  In
   each gap lines of ``min_block_words`` words or more come before shorter ones.
3. *Deletion.*  Aligned common blocks of at least ``min_block_words`` words are
   deleted from the later document (the greater doc_id).  What the alignment
   passes by, because it stands in another order or is a further copy, is
   deleted as well where a run of so many words stands that the earlier document
   holds as a run.

So a line that isn't blank is deleted exactly if it lies in a run of
``min_block_words`` words or more that an earlier document holds as a run: the
first document with the run is always among those that are aligned.

Only hashes of lines travel between documents.  Lines are whole, and each pair
is aligned whole.  A document that thousands of others overlap with is dealt out
with its partners in parts of bounded size.

Defined results: rows with a null text or doc_id, and texts without a long
enough run, are returned as they are with 0 lines removed; a line that both
documents hold several times goes from the later one wherever it stands there;
rows that repeat doc_id and text are one document and cleaned alike; of rows
with one doc_id and different texts, the order is by the texts' hash; a text all
of whose lines go becomes empty; columns named as the added ones are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm import scratch
from grovekit.llm.dealing import dealt
from grovekit.llm.hashing import mix

#: A run that so many documents hold pairs all of them.
RARE = 4
#: Bits of the table kept for tracing a longest common subsequence.
TABLE_BITS = 1 << 27


def patience(a: np.ndarray, b: np.ndarray, long_lines: set[int] | None = None) -> list[tuple[int, int, int]]:
    """Aligned blocks (start in a, start in b, length) of two sequences, in order.

    In each gap ``long_lines`` (by default all) are aligned before the rest, and
    lines that are unique in both before those that repeat.
    """
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    a_list, b_list = a.tolist(), b.tolist()
    while todo:
        a0, a1, b0, b1 = todo.pop()
        # equal ends
        n = 0
        while a0 + n < a1 and b0 + n < b1 and a_list[a0 + n] == b_list[b0 + n]:
            n += 1
        if n:
            out.append((a0, b0, n))
            a0, b0 = a0 + n, b0 + n
        n = 0
        while a1 - n > a0 and b1 - n > b0 and a_list[a1 - n - 1] == b_list[b1 - n - 1]:
            n += 1
        if n:
            a1, b1 = a1 - n, b1 - n
            out.append((a1, b1, n))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a_list[a0:a1]), Counter(b_list[b0:b1])
        common = in_a.keys() & in_b.keys()
        if not common:
            continue
        if long_lines is not None:
            common = common & long_lines or common
        place = {x: j for j, x in enumerate(b_list[b0:b1], b0) if in_b[x] == 1 and x in common}
        anchors = [(i, place[x]) for i, x in enumerate(a_list[a0:a1], a0) if in_a[x] == 1 and x in place]
        if anchors:
            run = _longest(anchors)
        else:  # every common line repeats
            at_a = [i for i in range(a0, a1) if a_list[i] in common]
            at_b = [j for j in range(b0, b1) if b_list[j] in common]
            run = [(at_a[i], at_b[j]) for i, j in longest_common([a_list[i] for i in at_a], [b_list[j] for j in at_b])]
        before_a, before_b = a0, b0
        for i, j in [*run, (a1, b1)]:
            if i > before_a and j > before_b:
                todo.append((before_a, i, before_b, j))
            if i < a1:
                out.append((i, j, 1))
            before_a, before_b = i + 1, j + 1
    out.sort()
    joined: list[tuple[int, int, int]] = []
    for i, j, n in out:
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (joined[-1][0], joined[-1][1], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    return joined


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    """Bit rows of the lengths' table: bit j is 0 where b[: j + 1] gives one more than b[:j]; all rows, or the last."""
    full = (1 << len(b)) - 1
    held: dict[int, bytearray] = {}
    for j, x in enumerate(b):
        held.setdefault(x, bytearray((len(b) + 7) // 8))[j >> 3] |= 1 << (j & 7)
    where = {x: int.from_bytes(bits, "little") for x, bits in held.items()}
    row, rows = full, [full]
    for x in a:
        u = row & where.get(x, 0)
        row = ((row + u) | (row - u)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a with each prefix of b."""
    bits = np.frombuffer(_rows(a, b, False)[0].to_bytes((len(b) + 7) // 8, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64))])


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in order; halved (Hirschberg) where the table is large."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        x, y = a[a0:a1], b[b0:b1]
        if not x or not y:
            continue
        if len(x) > 1 and len(x) * len(y) > TABLE_BITS:
            half = len(x) // 2
            k = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
            todo += [(a0, a0 + half, b0, b0 + k), (a0 + half, a1, b0 + k, b1)]
            continue
        rows = _rows(x, y, True)
        i, j = len(x), len(y)
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                out.append((a0 + i, b0 + j))
            elif rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
    return sorted(out)


def _longest(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of anchors that rises in both places."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(anchors):
        k = bisect_left(tails, j)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(j)
            at.append(n)
        else:
            tails[k], at[k] = j, n
    out, n = [], at[-1]
    while n >= 0:
        out.append(anchors[n])
        n = back[n]
    return out[::-1]


def _windows(lines: list[int], words: list[int], least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the shortest runs of ``least`` words or more from each line on, and up to each line; a count below 0 parts runs."""
    for step in (1, -1):
        order = range(len(lines))[::step]
        first, total = 0, 0  # the run is order[first : at + 1], the shortest that ends at order[at]
        for at, i in enumerate(order):
            if words[i] < 0:
                first, total = at + 1, 0
                continue
            total += words[i]
            while total - words[order[first]] >= least and first < at:
                total -= words[order[first]]
                first += 1
            if total >= least and words[i]:
                yield (order[first], i + 1) if step == 1 else (i, order[first] + 1)


def run_keys(lines: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """A hash for each shortest run of ``least`` words or more; that of a single line is the line's own."""
    made: set[int] = set()
    for i, j in set(_windows(lines.tolist(), words.tolist(), least)):
        key = lines[i : i + 1].astype(np.int64).view(np.uint64)
        for x in lines[i + 1 : j].astype(np.int64).view(np.uint64):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ x)
        made.add(int(key.view(np.int64)[0]))
    return np.array(sorted(made), np.int64)


def _passed_by(later: np.ndarray, words: np.ndarray, owner: np.ndarray, gone: np.ndarray, least: int) -> None:
    """Marks in ``gone`` what no block holds: runs of ``least`` words or more of common lines that the owner holds as a run."""
    count = dict(zip(later.tolist(), words.tolist(), strict=True))
    mine, theirs = later.tolist(), owner.tolist()
    common = count.keys() & set(theirs)
    left = [(count[x] if x in common else -1) for x in mine]
    if not any(n > 0 and not g for n, g in zip(left, gone.tolist(), strict=True)):
        return
    held = {tuple(theirs[i:j]) for i, j in _windows(theirs, [count[x] if x in common else -1 for x in theirs], least)}
    for i, j in _windows(mine, left, least):
        if tuple(mine[i:j]) in held:
            gone[i:j] = True


def removed_lines(later: np.ndarray, words: np.ndarray, owners: list[np.ndarray], min_block_words: int) -> np.ndarray:
    """Places of the later document's lines that lie in an aligned block with an owner, or in a run that the alignment passes by."""
    gone = np.zeros(len(later), bool)
    long_lines = set(later[words >= min_block_words].tolist())
    for owner in owners:
        mine = np.zeros(len(later), bool)
        for start, _, n in patience(later, owner, long_lines):
            if words[start : start + n].sum() >= min_block_words:
                mine[start : start + n] = True
        _passed_by(later, words, owner, mine, min_block_words)
        gone |= mine
    return np.flatnonzero(gone)


def overlapping(keyed: DataFrame) -> tuple[DataFrame, str]:
    """(a, b): pairs of an earlier and a later document, from ``keyed(d, r, keys)`` with a row for each document; and the path that they lie at."""
    held = keyed.select("d", "r", F.explode("keys").alias("key"))
    # both are written, so that Spark can split the join of the two where a key is frequent
    shared, shared_path = scratch.settle(held.groupBy("key").agg(F.min_by("r", F.struct("d", "r")).alias("first"), F.count("*").alias("n")).where("n > 1"), "shared")
    met, met_path = scratch.settle(held.join(shared.hint("merge"), "key"), "met")
    rare = met.where(F.col("n") <= RARE)
    earlier, later = rare.select("key", F.col("d").alias("d0"), F.col("r").alias("a")), rare.select("key", F.col("d").alias("d1"), F.col("r").alias("b"))
    among = earlier.join(later, "key").where("d0 < d1 or (d0 = d1 and a < b)").select("a", "b")
    frequent = met.where((F.col("n") > RARE) & (F.col("r") != F.col("first"))).select(F.col("first").alias("a"), F.col("r").alias("b"))
    pairs = scratch.settle(frequent.union(among).distinct(), "pairs")
    scratch.drop(keyed.sparkSession, shared_path, met_path)
    return pairs


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", min_block_words: int = 5) -> DataFrame:
    """``docs``' columns with the cleaned text, ``n_lines`` and ``removed`` (places of deleted lines)."""
    own = [c for c in docs.columns if c not in ("n_lines", "removed")]
    keyed = docs.select(*own).withColumn("__row", F.xxhash64(F.col(key), F.col(text)))
    lines = F.split(F.col("t"), "\n")
    trimmed = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\x09-\x0d]+", " ")))
    base = keyed.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("d"), F.col("__row").alias("r"), F.col(text).alias("t"))
    base = base.select("d", "r", trimmed.alias("l"))
    hashed = base.select(
        "d", "r",
        F.transform("l", lambda x: F.xxhash64(x)).alias("h"),
        F.transform("l", lambda x: F.when(x == "", 0).otherwise(F.size(F.split(x, " +")))).alias("w"),
    )

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(keys=[run_keys(np.asarray(h), np.asarray(w), min_block_words) for h, w in zip(batch["h"], batch["w"], strict=True)])

    hashed = hashed.mapInPandas(runs, "d long, r long, h array<long>, w array<int>, keys array<long>").dropDuplicates(["r"])  # rows that repeat are equal
    hashed, lines_path = scratch.settle(hashed, "lines")
    pairs, pairs_path = overlapping(hashed.select("d", "r", "keys"))
    one = hashed.select(F.col("r").alias("node"), "h", "w")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner = np.empty(0, np.int64)
        for batch in batches:
            made = []
            for is_own, r, h, w in zip(batch["own"], batch["b"], batch["h"], batch["w"], strict=True):
                if is_own:
                    owner = np.asarray(h)
                    continue
                gone = removed_lines(np.asarray(h), np.asarray(w), [owner], min_block_words)
                if len(gone):
                    made.append((r, gone.tolist()))
            yield pd.DataFrame(made, columns=["r", "gone"])

    gone = dealt(pairs, one, "h", "w").mapInPandas(align, "r long, gone array<int>")
    gone = gone.select("r", F.explode("gone").alias("g")).groupBy("r").agg(F.sort_array(F.collect_set("g")).alias("__gone"))  # a document's own lines
    gone, _ = scratch.settle(gone, "gone")
    scratch.drop(docs.sparkSession, lines_path, pairs_path)
    # the same join at every size: both sides by the row's hash
    parted = keyed.join(gone.withColumnRenamed("r", "__r").hint("merge"), F.col("__row") == F.col("__r"), "left").withColumn("__parts", F.split(F.col(text), "\n"))
    count = F.coalesce(F.size("__parts"), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), "__gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get("__parts", i)), "\n")
    new = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)
    return parted.select(
        *[new.alias(c) if c == text else F.col(c) for c in own], F.when(F.col(text).isNull(), 0).otherwise(count).alias("n_lines"),
        F.coalesce("__gone", F.array().cast("array<int>")).alias("removed"),
    )
