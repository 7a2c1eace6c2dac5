"""Corpus pipeline: each stage reads what its predecessor kept, and its decisions take effect.

Documents of low quality go; of each group of near copies the smallest id stays; documents that hold
a benchmark window go; personal data become pseudonyms; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import decontaminate, jaccard, packing, pii, quality
from rankloom.llm.common import release, shared_table, table, tables_made


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at or above the threshold, by a model fitted to the labels of ``docs``."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near copies: five words, similarity 0.8 or more."""
    return jaccard.keep_one(docs, k=5, threshold=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, with pseudonyms in place of personal data; n_chars follows the text."""
    out = pii.without_pii(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in out.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_pseudonyms", pii_pseudonyms),
    ("best_fit_packing", best_fit_packing),
]

#: Trees, suffix arrays and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = tables_made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared_table(docs, f"stage-{name}")
            release(before, docs)
    return docs
