"""From raw documents to packed sequences, by five of the training-data operators.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents.  Empty tables pass through; a null text
counts as empty; a null doc_id is kept where a stage has no reason to drop it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, packing, pii, quality, textcore
from tidemark.llm.queries import table, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs.select(*COLUMNS), quality.fit(docs, table(spark, sf_dir, "labels")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones stays: that with the smallest id.

    Rows are told apart by all columns, not by their id: rows that are not linked stay,
    whatever ids they have.  `jaccard.single` says which one stays where ids repeat.
    """
    return jaccard.single(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in twenty lies in benchmark passages go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to marks of its kind; n_chars follows."""
    return pii.redact(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack(packing.pieces(docs, tokenizer()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in between."""
    staged = textcore.Staged(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = staged.write(stage(spark, docs, sf_dir))
        staged.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
