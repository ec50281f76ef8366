"""A corpus pipeline of five stages over ``documents``: language ID, quality rules, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. ``run`` stores each stage's result as
Parquet in the shared folder and reads it back for the next, so a lost executor repeats no finished stage. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import langid, neardup, packing, quality, secrets
from bidloom.llm.common import materialise

#: SQL can express neither the language model's code lengths nor the decoding of secrets; tests compare with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language: no letter, an undecided code length, or one that no language explains."""
    return langid.keep(docs, langid.train(docs))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that fail the base rules or whose histograms are far from their language's."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8 or more."""
    return neardup.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets, plain or encoded, by a mark; n_chars follows the text."""
    kind = docs.schema["n_chars"].dataType
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences of at most 1024."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
