"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet to the
shared folder and read again, so a stage that loses executors repeats its own work only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loofold.llm import secrets
from loofold.llm.language import UNKNOWN, identify, trained_on_folds
from loofold.llm.mixing import mixed_documents
from loofold.llm.neardup import one_of_each
from loofold.llm.packing import packed_pieces
from loofold.session import written_table

#: Mean certainty of words below which no language is believed.
LEAST_CERTAINTY = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of recognised languages, one or several; a missing lang is filled in.

    Without any labelled text no language can be told, and all documents with a letter stay.
    """
    model = trained_on_folds(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, model, keep_row=True)
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("certainty") >= LEAST_CERTAINTY))
    columns = [F.coalesce("row.lang", "lang_pred").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns]
    return kept.select(*columns)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew."""
    clean = secrets.redacted(docs, secrets.trained(docs))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of one piece each."""
    return packed_pieces(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_neardup", minhash_neardup),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("packing", packing),
]

#: Language identification is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written_table(stage(spark, docs, sf_dir), name)
    return docs
