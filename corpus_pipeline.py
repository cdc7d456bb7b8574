"""A training corpus from raw documents: five stages, each one of the operators of ``duelens.llm``.

``run`` applies them to ``documents``; each stage's rows are written and read again as the next
one's documents. All but the last return the columns of ``documents``; where a stage changes a text
and the table has ``n_chars``, that follows the text. Null and empty texts fail the quality rules, so an
empty table and a table of nothing else give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelens.llm import decontamination, ngram_join, packing, quality_rules, secret_scan
from duelens.operators.staging import discarding, staged


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed rules or are probably bad by all rules together go."""
    return quality_rules.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8."""
    return ngram_join.one_of_each_group(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut; documents that are mostly such passages go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(decontamination.decontaminated(docs, benchmark))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, hidden ones too."""
    return _measured(secret_scan.without_secrets(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Models, connected components and tokenizers have no SQL; tests hold brute force against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``; what a stage has written for itself is removed when its rows are there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with discarding(spark):
            docs = staged(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
