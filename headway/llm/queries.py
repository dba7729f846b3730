"""The operators over the driver's tables: thin queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headway.llm import bpe, centroids, classifier, collocations, decontaminate, langid, licenses, lines, ngram_join, oracles, quality, secrets, sharding, substrings
from headway.llm.tables import documents, table


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), byte_bpe())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir))


SHARD_BYTES = 32_000_000


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), SHARD_BYTES)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_licenses": op1_licenses, "op2_ngram_jaccard": op2_ngram_jaccard, "op3_bpe": op3_bpe, "op4_decontaminate": op4_decontaminate, "op5_sharding": op5_sharding, "op6_secrets": op6_secrets, "op7_language": op7_language,
    "op8_substrings": op8_substrings, "op9_quality": op9_quality, "op10_lines": op10_lines,
    "op11_collocations": op11_collocations, "op12_centroids": op12_centroids, "op13_classifier": op13_classifier,
}
ORACLE_SQL = oracles.all_sql(SHARD_BYTES)
