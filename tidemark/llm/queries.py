"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, langid, merkle, packing, pii, ppm, quality, secrets, sql, substring, textcore

TOKENIZER = "word_bpe_49k.json"


def tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    textcore.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"), texts=False)


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_neighbours(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"), by_file=True)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer()))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_document_fingerprints": op2_document_fingerprints,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op8_secret_scan": op8_secret_scan,
        "op9_pii": op9_pii,
        "op10_language_id": op10_language_id,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """SQL can express neither learned models, hashed trees, the tokenizer nor spans of matches."""
    return {
        "op1_substring_dedup": sql.SUBSTRING.strip(),
        "op5_ngram_jaccard_join": sql.JACCARD.strip(),
        "op7_benchmark_decontamination": sql.DECONTAMINATION.strip(),
    }
