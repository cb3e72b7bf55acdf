"""Mixing sources to target weights, by Poisson replication.  DataFrame functions only.

Each source gets a mean repetition rate
``rate = documents * weight(source) / documents(source)``, whatever its size;
only where ``max_rate`` is given it is cut there, and the source then stays
below its target.
Each document draws its number of copies from a Poisson distribution with that
mean: a hash of (seed, doc_id) gives a uniform number, which the inverse of the
cumulative distribution turns into a count.  A mean above ``LARGEST_RATE`` is
the sum of equal smaller ones, each with its own draw.  The document is exploded
by the count, and the copies are dealt out and sorted by a hash: a global
shuffle.

Target weights are given by source, or follow ``documents(source) ** alpha``.
With given weights, sources that are not named share what is left of 1 in
proportion to their documents.

Defined results: a null source is a source of its own; a row with a null doc_id
draws by a hash of all its plain columns, so only rows equal in them share a
draw; repeated rows have equal draws; an empty table gives no rows; columns named
as the operator's own (``copy``, ``repeats``, ``rate``) are replaced, all others
pass through.  Only rows without a doc_id have their text hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

#: Up to so many sources the table of rates is broadcast (a few hundred bytes each).
BROADCAST_SOURCES = 20_000
#: Beyond, each source's rate is dealt to so many salted keys.
SALTS = 64
#: The largest mean of one draw; exp(-rate) soon has no double beyond.
LARGEST_RATE = 500.0


def rates(docs: DataFrame, source: str, alpha: float, target_weights: dict[str, float] | None, max_rate: float | None) -> DataFrame:
    """(src, n, rate): one row per source."""
    if max_rate is not None and not 0 < max_rate <= LARGEST_RATE:
        raise ValueError(f"max_rate must be in (0, {LARGEST_RATE}]")
    cut = (lambda rate: rate) if max_rate is None else (lambda rate: F.least(F.lit(max_rate), rate))
    counted = docs.groupBy(F.col(source).alias("src")).agg(F.count("*").alias("n"))
    if target_weights is None:
        weighed = counted.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
        total = weighed.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
        return weighed.crossJoin(F.broadcast(total)).select("src", "n", cut(F.col("all_n") * (F.col("w") / F.col("all_w")) / F.col("n")).alias("rate"))
    given: Column = F.lit(None).cast("double")
    for name, weight in target_weights.items():
        given = F.when(F.col("src") == name, F.lit(float(weight))).otherwise(given)
    weighed = counted.withColumn("given", given)
    left = max(0.0, 1.0 - sum(target_weights.values()))
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum(F.when(F.col("given").isNull(), F.col("n")).otherwise(0)).alias("rest_n"))
    weight = F.coalesce(F.col("given"), F.lit(left) * F.col("n") / F.col("rest_n"))
    return weighed.crossJoin(F.broadcast(total)).select("src", "n", cut(F.col("all_n") * weight / F.col("n")).alias("rate"))


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... up to where the tail is below a double's last bit."""
    start = F.exp(-rate)
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    grow = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), F.struct(start.alias("p"), F.array(start).alias("c")), grow, lambda s: s["c"])


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def replicate(
    docs: DataFrame, source: str = "source", key: str = "doc_id", alpha: float = 0.5,
    target_weights: dict[str, float] | None = None, max_rate: float | None = None, seed: int = 11,
) -> DataFrame:
    """``docs``' columns with ``copy`` (from 1), ``repeats`` and ``rate``, in shuffled order."""
    spark = docs.sparkSession
    docs = docs.select([c for c in docs.columns if c not in ("copy", "repeats", "rate")])
    table = rates(docs, source, alpha, target_weights, max_rate)
    table = table.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE)).cast("int")).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("draws")))
    n_sources = docs.select(source).distinct().count()
    names = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select([F.col(c).alias(a) for c, a in names.items()])
    if n_sources <= BROADCAST_SOURCES:
        joined = renamed.join(F.broadcast(table), renamed[names[source]].eqNullSafe(table["src"]))
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        renamed = renamed.withColumn("salt", F.pmod(F.xxhash64(names[key]), F.lit(SALTS)).cast("int"))
        joined = renamed.join(salted, renamed[names[source]].eqNullSafe(salted["src"]) & (renamed["salt"] == salted["salt"]))
    # rows without a key are told apart by their other values
    plain = [F.col(a) for c, a in names.items() if isinstance(docs.schema[c].dataType, AtomicType)]
    drawn_by = F.coalesce(F.col(names[key]).cast("string"), F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in plain])))
    draw = uniform(F.lit(seed), drawn_by)
    further = lambda k: uniform(F.lit(seed), drawn_by, k)
    count = lambda u: F.size(F.filter("cdf", lambda c: c <= u))
    more = F.aggregate(F.sequence(F.lit(2), F.col("draws")), F.lit(0), lambda total, k: total + count(further(k)))
    counted = joined.withColumn("u", draw).withColumn("repeats", count(F.col("u")) + F.when(F.col("draws") > 1, more).otherwise(0)).where("repeats > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    apart = F.when(F.col(names[key]).isNull(), F.xxhash64(*plain, F.lit(seed))).otherwise(F.lit(0).cast("long"))
    dealt = copies.withColumn("place", F.xxhash64(F.lit(seed), F.col(names[key]), apart, F.col("copy")))
    columns = [F.col(a).alias(c) for c, a in names.items()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select(*names.values(), "copy", "repeats", "rate", "place").repartition(parts, "place").sortWithinPartitions("place").select(*columns, "copy", "repeats", "rate")


#: The same rows in DuckDB, with alpha 0.5 and seed 11, where no rate is above LARGEST_RATE.
SQL = """
WITH RECURSIVE counted AS (SELECT source AS src, count(*) AS n FROM documents GROUP BY 1),
total AS (SELECT sum(n) AS all_n, sum(sqrt(n::DOUBLE)) AS all_w FROM counted),
rated AS (SELECT src, all_n * (sqrt(n::DOUBLE) / all_w) / n AS rate FROM counted, total),
cdf AS (
  SELECT src, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rated
  UNION ALL
  SELECT src, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 40)
),
drawn AS (
  SELECT *, row_number() OVER () AS rid, ('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, md5(concat_ws('|', '', coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''), coalesce(n_chars::VARCHAR, ''))))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents
),
counts AS (
  SELECT d.rid, any_value(f.rate) AS rate, count(*) FILTER (WHERE f.c <= d.u) AS repeats
  FROM drawn d JOIN cdf f ON d.source IS NOT DISTINCT FROM f.src GROUP BY d.rid
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, repeats + 1))::INTEGER AS copy, repeats::INTEGER AS repeats, round(rate, 9) AS rate
FROM drawn JOIN counts USING (rid) WHERE repeats > 0
"""
