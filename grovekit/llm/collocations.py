"""Phrase collocations: word sequences that occur together more often than their parts suggest.

1. *Pieces.*  Texts (A-Z lower-cased) are split at ``[.,;:!?\\x0A-\\x0D]``; a
   piece is its words ``[^\\x20\\x09]+``.  Identical pieces of a language become
   one with a multiplicity, counted in each batch before they are shuffled.
2. *Counts.*  Tasks turn pieces into weighted n-grams of 1 to ``longest`` words
   and deal them to hash buckets, as compressed blocks.  A bucket's blocks
   stream through DuckDB, which sums them within ``MEMORY`` and spills beyond it
   to Spark's own spill folders.  Only what occurs ``least`` times is kept: no
   part of a candidate can be rarer than the candidate.
3. *Parts.*  Each candidate asks for the counts of its parts: the requests are
   shuffled to the counts by (lang, part), a join whose skew Spark splits, and
   the answers come back by candidate.  The same parts tell which candidates a
   longer one covers.
4. *Scores.*  ``floor(1000000 * a * a / (l * r))`` in 38-digit decimals, exact up
   to counts of 10 ** 15; beyond, the job fails rather than round.  The
   lowest-scoring cut counts (after flooring; ties to the shorter first part).

Defined results: a null text has no pieces; a null lang is ``und``; rows count
as often as they are repeated; equal scores go by count, then by phrase in byte
order; an empty table gives no rows; other columns are ignored; a piece of any
length is one row, cut nowhere.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovekit.llm import scratch
from grovekit.llm.hashing import combine, word_hashes

#: What ends a piece becomes a line end, and a tab a space.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
#: Words whose n-grams a task adds up at once.
WORDS = 300_000
#: Pieces that a task holds before it sends them on, and their bytes.
PIECES, PIECE_BYTES = 200_000, 32 << 20
#: What DuckDB may hold in a task before it spills.
MEMORY = "400MB"
#: Bytes of n-grams that a bucket should have, about, and the number of buckets beyond which they grow instead (and DuckDB spills).
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 20_000
#: Parts of a language that are ranked apart first.
SALTS = 16
_BLOCK = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
#: Whole decimals; what has no room in 38 digits is an error.
_SCORE = "cast(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0)) as decimal(38,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"


def pieces(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, piece, n): distinct pieces, words joined by one space, and how often each occurs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, bytes]] = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            names, found = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.binary()), pa.array(held.values(), pa.int64())], names=["lang", "piece", "n"])

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in t.as_py().lower().translate(_ENDS).split(b"\n"):
                    words = piece.strip(b" ")
                    if words:
                        held[name, b" ".join(words.split()) if b"  " in words else words] += 1
                        size += len(words)
                        if len(held) >= PIECES or size >= PIECE_BYTES:
                            yield out()
                            held.clear()
                            size = 0
        if held:
            yield out()

    scratch.small_batches(docs.sparkSession)
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(cut, "lang string, piece binary, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def grams(lang: pa.Array, piece: pa.Array, n: pa.Array, longest: int, buckets: int) -> pa.Table:
    """(lang, gram, n, bucket): weighted n-grams of 1 to ``longest`` words of some pieces, summed; the bucket follows from the words."""
    words = pc.split_pattern(piece.cast(pa.string()), " ")
    flat, of = words.flatten(), pc.list_parent_indices(words).to_numpy()
    coded = flat.dictionary_encode()
    hashes = next(word_hashes([" ".join(coded.dictionary.to_pylist()).encode()]))[coded.indices.to_numpy()]
    made = []
    for k in range(1, min(longest, len(flat)) + 1):
        count = len(flat) - k + 1
        whole = np.flatnonzero(of[:count] == of[k - 1 :])
        at, owner = pa.array(whole), pa.array(of[whole])
        gram = flat if k == 1 else pc.binary_join_element_wise(*[flat.slice(j, count).take(at) for j in range(k)], " ")
        bucket = pa.array((combine(hashes, k)[whole] % np.uint64(buckets)).astype(np.int64))
        table = pa.table({"lang": lang.take(owner), "gram": gram, "n": n.take(owner), "bucket": bucket})
        made.append(table.group_by(["lang", "gram"]).aggregate([("n", "sum"), ("bucket", "min")]).select(["lang", "gram", "n_sum", "bucket_min"]))
    return pa.concat_tables(made).rename_columns(["lang", "gram", "n", "bucket"])


def _dealt(found: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, lang, grams, n): blocks of n-grams as compressed lines, and their counts."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        packer = zstandard.ZstdCompressor()

        def out() -> pa.RecordBatch:
            every = pa.Table.from_batches(held).combine_chunks()
            table = grams(*(every.column(c).chunk(0) for c in ("lang", "piece", "n")), longest, buckets).combine_chunks()
            coded = table.column("lang").chunk(0).dictionary_encode()
            place = table.column("bucket").to_numpy() * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(place, kind="stable")
            place = place[order]
            cut = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
            sorted_grams = table.column("gram").chunk(0).take(pa.array(order))
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), sorted_grams), "\n").cast(pa.binary())
            n = table.column("n").to_numpy()[order]
            return pa.RecordBatch.from_arrays([
                pa.array(place[cut[:-1]] // len(coded.dictionary)), coded.dictionary.take(pa.array(place[cut[:-1]] % len(coded.dictionary))),
                pa.array([packer.compress(x.as_py()) for x in lines], pa.binary()),
                pa.array([packer.compress(n[x:y].tobytes()) for x, y in zip(cut, cut[1:], strict=False)], pa.binary()),
            ], names=["bucket", "lang", "grams", "n"])

        for batch in batches:
            for at in range(0, len(batch), 5000):
                part = batch.slice(at, 5000)
                held.append(part)
                size += part.column(1).nbytes // 6
                if size >= WORDS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return found.mapInArrow(deal, "bucket long, lang string, grams binary, n binary")


def _counted(dealt: DataFrame, least: int) -> DataFrame:
    """(lang, gram, words, f): n-grams of at least ``least`` occurrences; single words whatever their count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()

        def blocks() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, lines, n in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    counts = np.frombuffer(unpacker.decompress(n), np.int64)
                    gram = pc.split_pattern(pa.array([unpacker.decompress(lines)], pa.binary()).cast(pa.string()), "\n").flatten()
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(counts)), gram, pa.array(counts)], schema=_BLOCK)

        spill = tempfile.mkdtemp(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None, prefix="grams-")  # as Spark's own spills
        con = duckdb.connect(config={"temp_directory": spill, "memory_limit": MEMORY, "threads": 1, "preserve_insertion_order": False})
        try:
            stream = pa.RecordBatchReader.from_batches(_BLOCK, blocks())  # noqa: F841  DuckDB reads it by its name
            con.sql(f"CREATE TEMP TABLE counted AS SELECT lang, gram, sum(n)::BIGINT AS f FROM stream GROUP BY ALL HAVING sum(n) >= {least} OR NOT contains(gram, ' ')")
            yield from con.sql("SELECT lang, gram, (length(gram) - length(replace(gram, ' ', '')) + 1)::INTEGER AS words, f FROM counted").fetch_record_batch(20_000)
        finally:
            con.close()
            shutil.rmtree(spill, ignore_errors=True)

    return dealt.mapInArrow(count, "lang string, gram string, words int, f long")


def counts(docs: DataFrame, longest: int = 3, least: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, words, f) over all texts; a working table."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(parts, min(MOST_BUCKETS, size * longest * (longest + 1) // 2 // BUCKET_BYTES))
    dealt = _dealt(pieces(docs, lang, text), longest, buckets).repartition(buckets, "bucket")
    return scratch.settle(_counted(dealt, least), "grams")[0]


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words.

    A phrase needs ``least`` occurrences; it is dropped if a longer one that
    contains it has ``cover`` % of them or more.
    """
    counted = counts(docs, longest, least, lang, text)
    totals = counted.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    known = counted.where(f"f >= {least}").select("lang", F.col("gram").alias("part"), F.col("f").alias("answer"))
    phrases = counted.where(f"words > 1 and f >= {least}").select("lang", F.col("gram").alias("phrase"), "words", F.col("f").alias("a"), F.split("gram", " ").alias("w"))

    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", 1, k), " ").alias("first"), F.array_join(F.slice("w", k + 1, F.col("words") - k), " ").alias("rest"))))
    sides = phrases.select("lang", "phrase", "a", cuts.alias("c")).select("lang", "phrase", "a", "c.k", F.inline(F.array(F.struct(F.lit(True).alias("left"), F.col("c.first").alias("part")), F.struct(F.lit(False).alias("left"), F.col("c.rest").alias("part")))))
    answered = sides.join(known, ["lang", "part"])
    by_cut = answered.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("answer"))).alias("l"), F.max(F.when(~F.col("left"), F.col("answer"))).alias("r"))
    scored = by_cut.withColumn("score", F.expr(_SCORE))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")

    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")))))
    covers = phrases.where("words > 2").select("lang", inner.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    open_ = lowest.join(covers, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {cover} * a")
    # the best of each salted part first, so that a language's last ranking has no more than SALTS * top rows
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = open_.withColumn("place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB.
SQL = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, w[i:i + m - 1] AS g, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM cut, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE m = 1 GROUP BY lang),
candidates AS (SELECT * FROM grams WHERE m > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.g, c.m, c.f AS a, k, x.f AS l, y.f AS r, 1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c JOIN grams x ON c.lang = x.lang AND c.g[1:k] = x.g JOIN grams y ON c.lang = y.lang AND c.g[k + 1:] = y.g),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
covers AS (SELECT lang, g[i:i + 1] AS g, max(f) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM candidates WHERE m = 3) GROUP BY ALL),
ranked AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM lowest b LEFT JOIN covers c ON b.lang = c.lang AND b.g = c.g
  WHERE b.m = 3 OR longer IS NULL OR 100 * longer < 50 * a),
numbered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM numbered JOIN totals USING (lang) WHERE rank <= 2000
"""
