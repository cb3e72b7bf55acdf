"""The corpus pipeline: documents through language ID, near-duplicate removal, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's input.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grovekit.llm import decontaminate, jaccard_join, langid, mixing, scratch, sharding


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a learned language; null texts and texts without letters go.

    So do texts in other languages: those of which no learned language is likelier than all others together, and
    those with fewer than half of their n-grams in labelled texts.
    Repeated rows are treated alike; without labelled rows no language is known and all documents go.
    """
    return langid.accept(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each component of links of similarity 0.8 or more on five-word shingles.

    Rows are told apart by doc_id and text, and only rows equal in both count
    once; a row without doc_id goes if its component has one with a doc_id, and
    else one such row stays; texts without words link with nothing and stay.
    """
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark passage; null and empty texts stay, repeated rows are treated alike."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at the square root of their share, by whole copies of documents, in shuffled order; a null source is a source of its own."""
    return mixing.replicate(docs).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as stored in a compacted, versioned shard store; all rows stay as they are, repeated ones and nulls too."""
    return sharding.shard(docs)[1]


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mix),
    ("sharding", shards),
]

#: Language models and banded alignment have no SQL form.  tests/llm holds the stages against plain versions over a small
#: table: labels, all pairs of sets, full alignment, Poisson inversion in SQL, and the rows stored; the language model by
#: its accuracy only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = scratch.settle(docs, name)
    return docs
