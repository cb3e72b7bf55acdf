"""Document fingerprints by MinHash.

A text's shingles are the runs of ``words`` words; ``PERMUTATIONS`` universal
hash functions ``(a * x + b) mod 2**64`` give the least value of each, all in
vectorised numpy.  Two fingerprints are as alike as the share of components in
which they agree, an unbiased estimate of the shingle sets' Jaccard similarity.

``near_duplicates`` joins bands of the signatures in Spark and verifies the
Jaccard similarity of each candidate on the whole shingle sets.

Defined results: a null or wordless text has an empty shingle set, whose
fingerprint is the constant of all ones; two such are alike (1), and alike to
no other text (0).  A text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovekit.llm.hashing import combine, mix, word_hashes
from grovekit.llm import scratch
from grovekit.llm.jaccard_join import join

PERMUTATIONS = 128
#: 32 bands of 4: a pair of similarity 0.8 shares one with probability 1 - 5e-8.
BANDS = 32
_FULL = np.iinfo(np.uint64).max
_SEEDS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _SEEDS[:PERMUTATIONS, None] | np.uint64(1), _SEEDS[PERMUTATIONS:, None]
_BLOCK = 2048  # shingles hashed at once


def signature(tokens: np.ndarray) -> np.ndarray:
    """The least value of each permutation, 32 bits each; all ones for an empty set."""
    least = np.full(PERMUTATIONS, _FULL, np.uint64)
    for at in range(0, len(tokens), _BLOCK):
        np.minimum(least, (_A * tokens[at : at + _BLOCK] + _B).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Shingles of a text, with repeats, in no order that matters."""
    return combine(words, min(n, len(words))) if len(words) else words


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / PERMUTATIONS


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprint(text: Column, words: int = 5) -> Column:
    """The fingerprint of a string column, as 1024 hex digits."""

    @F.pandas_udf(T.StringType())
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([_hex(signature(shingles(h, words))) for h in word_hashes(texts)], dtype=object)

    return made(text.cast("binary"))


def neighbours(docs: DataFrame, key: str, text: str, ranges: int) -> DataFrame:
    """(part, k, t, extra): rows dealt into ranges of descending key; each range's end has the next range's first row as an extra.

    Ties of the key are ordered by text.  A null key counts as the least.
    """
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(least)).alias("k"), F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    cuts = rows.select("k").agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges + 1)], 100 * ranges).alias("cuts"), F.max("k").alias("top")).first()
    if cuts["top"] is None:
        return rows.select(F.lit(0).alias("part"), "k", "doc_id", "t", F.lit(False).alias("extra"))
    # a range holds the keys in (next cut, its own cut]; its own cut is a key of the table, and the first in descending order
    firsts = sorted({*cuts["cuts"], cuts["top"]}, reverse=True)
    ascending = np.array(firsts[::-1], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(ascending)  # one number for each range, so bounded by the number of partitions

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def parts(keys: pd.Series) -> pd.Series:
        """The row's range; for a range's first key also the range before, as an extra, coded below 0."""
        cuts, last = shared.value, len(shared.value) - 1
        at = np.searchsorted(cuts, keys.to_numpy())
        first = cuts[at] == keys.to_numpy()
        before = np.where(at == last, last, last - at - 1)  # the first of all follows the last range
        return pd.Series([[last - a, -1 - b] if f else [last - a] for a, b, f in zip(at.tolist(), before.tolist(), first.tolist(), strict=True)])

    dealt = rows.withColumn("p", F.explode(parts("k")))
    part = F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p"))
    return dealt.select(part.alias("part"), "k", "doc_id", "t", (F.col("p") < 0).alias("extra"))


def edited(docs: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text.

    The edited text has the last third of the code points replaced by the first
    as many of the next document, in descending order of key (after the last:
    the first).  The rows are sorted by ranges of the key, each of which also
    gets the row that follows it, so one shuffle of the texts is all.
    """
    scratch.small_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = neighbours(docs, key, text, 8 * parts).repartition(parts, "part").sortWithinPartitions("part", "extra", F.desc("k"), "t")

    def pair(rows: list[tuple], following: tuple) -> pd.DataFrame:
        """Rows in order with the row that follows them."""
        texts = [r[2] for r in rows]
        decoded = [t.decode("utf-8", "replace") for t in [*texts, following[2]]]
        made = []
        for a, b in zip(decoded, decoded[1:], strict=False):
            cut = len(a) // 3
            made.append((a[: len(a) - cut] + b[:cut]).encode())
        own = [signature(shingles(h, words)) for h in word_hashes([*texts, following[2]])]
        new = [signature(shingles(h, words)) for h in word_hashes(made)]
        n = len(rows)
        return pd.DataFrame({
            "doc_id": pd.array([r[1] for r in rows], "Int64"), "n_chars": [len(t) for t in decoded[:n]], "edited_sha256": [hashlib.sha256(t).hexdigest() for t in made],
            "fingerprint": [_hex(s) for s in own[:n]], "edited_fingerprint": [_hex(s) for s in new],
            "near_edited": [likeness(own[i], new[i]) for i in range(n)], "near_next": [likeness(own[i], own[i + 1]) for i in range(n)],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # rows that wait for the one that follows
        size, part, closed = 0, None, False
        for batch in batches:
            for p, k, doc_id, t, extra in zip(batch["part"], batch["k"], batch["doc_id"], batch["t"], batch["extra"], strict=True):
                if p != part:
                    held, size, part, closed = [], 0, p, False
                row = (k, None if pd.isna(doc_id) else int(doc_id), t)
                if extra:
                    if not closed and held:
                        yield pair(held, row)
                        held = []
                    closed = True
                    continue
                if held and (size > 1 << 19 or len(held) >= 2000):
                    yield pair(held, row)
                    held, size = [], 0
                held.append(row)
                size += len(t)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInPandas(run, schema)


def bands(tokens: np.ndarray, percent: int) -> np.ndarray:
    """A code for each band of a set's fingerprint."""
    sig = signature(tokens).astype(np.uint64).reshape(BANDS, PERMUTATIONS // BANDS)
    code = np.arange(BANDS, dtype=np.uint64)
    for column in sig.T:
        code = mix(code ^ column)
    return code


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id): documents joined by bands of their signatures, verified by Jaccard similarity.

    The members of each band's bucket are verified against its leader first, so
    a bucket of any size gives as many pairs as members; those still in
    different components are then searched by ``jaccard_join``'s tree, until
    each pair of a bucket is verified, ruled out by exact bounds, or connected.
    Classes are the components of the verified pairs, named by their least doc_id
    (null if all have none).
    """
    found = join(docs, words, percent, key, text, bands)
    return found.select("doc_id", F.col("component_id").alias("class_id"))
