"""A training corpus from ``documents``: toxic texts go, near copies go, leaked test items go, personal data is
masked, and what is left becomes token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Its result is written as Parquet
and read again as the docs of the next one. All but the last return the columns of ``documents``. Null texts pass
every stage and have no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm import bpe, decontaminate, near_dedup, pii, toxicity
from citemill.session import stage

# SQL has no expression for the trained toxicity model, the first stage.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the limit."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.severity(model, docs)["expected_severity"] < toxicity.LIMIT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group by 5-word shingles. Rows that repeat a doc_id are one document."""
    gone = near_dedup.near_duplicates(docs, shingle_words=5).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return docs.where(decontaminate.is_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced by its kind; ``n_chars`` counts the new text."""
    masked = pii.masked_texts(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256)."""
    return bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("contextual_pii", mask_personal_data),
    ("bpe_encode_decode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
