"""The operators' queries, over whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.llm import collocations, decontaminate, filter_audit, html_extract, jaccard_join, kneserney, langid, line_dedup, minhash, mixing, quality, sharding, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = langid.fold(F.col("doc_id"), 3)
    model = langid.train(docs.where(remainder != 1))
    return langid.predict(docs.select("doc_id", (remainder == 1).alias("held_out"), "text"), model).drop("text")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(_table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = sharding.shard(_table(spark, sf_dir, "documents"))
    return rows


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"), words=4, percent=85).drop("class_size")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedupe(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), urlfilter.RULES).drop("url")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = langid.fold(F.col("doc_id"), 5)
    model = kneserney.train(docs.where(remainder != 1))
    return kneserney.score(docs.select("doc_id", (remainder == 1).alias("held_out"), "text"), model)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *base, (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.PROSE).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_sharding": op4_sharding,
    "op5_fingerprint": op5_fingerprint,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_lm_score": op9_lm_score,
    "op10_decontaminate": op10_decontaminate,
    "op11_filter_audit": op11_filter_audit,
    "op12_collocations": op12_collocations,
    "op13_quality_rules": op13_quality_rules,
}
ORACLE: dict[str, str] = {
    "op3_mixing": mixing.SQL,
    "op6_jaccard_join": jaccard_join.SQL,
    "op8_url_filter": urlfilter.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_collocations": collocations.SQL,
    "op13_quality_rules": quality.SQL,
}
