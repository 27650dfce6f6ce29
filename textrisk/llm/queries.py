"""Registered queries of the pipeline operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrisk.llm import decontaminate, imatch, licenses, line_dedup, minhash, mix, pieces, quality, search, suffix, toxicity, url_filter, whitening
from textrisk.llm.labelled import held_out


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    clean = line_dedup.dedup_lines(_table(spark, sf, "documents"), dropped="n_dropped")
    return clean.select("doc_id", "text", "n_dropped")


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    scored = quality.scored(docs, quality.fit(docs, _table(spark, sf, "labels")))
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"))


def op3_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf, "documents"))


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf, "pages"), url_filter.fit(spark))
    return judged.withColumn("score", F.round("score", 6))


def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.withColumn("coverage", F.round("coverage", 6))


def op6_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: source and language are their directories, the id the name."""
    name = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = _table(spark, sf, "documents").select(name.alias("path"), "text")
    return licenses.scan(files).withColumn("cosine", F.round("cosine", 6))


def op7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return pieces.encode(docs, pieces.Vocabulary.load())


def op8_imatch(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return imatch.edit_report(docs, imatch.lexicon(docs))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    score = toxicity.score("text", toxicity.fit(docs, _table(spark, sf, "labels")))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op10_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.repeated_passages(_table(spark, sf, "documents"))


def op11_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the words that the mix of sources weighted 5, 2, 1 takes of it."""
    return mix.mix(_table(spark, sf, "documents"))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Every finite embedding projected on the first four principal components, whitened."""
    return whitening.whiten(_table(spark, sf, "embeddings"))


def op13_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of all for each benchmark item."""
    return search.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_quality,
        op3_minhash,
        op4_url_filter,
        op5_decontaminate,
        op6_licenses,
        op7_pieces,
        op8_imatch,
        op9_toxicity,
        op10_suffix,
        op11_mix,
        op12_whitening,
        op13_search,
    )
}
