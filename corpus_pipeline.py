"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents. Null, empty and repeated rows are treated as the stage's operator defines it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import jaccard_join, language_id, mixing, packing, secret_scan
from quillstone.llm.common import table, with_checkpoints


def find_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that are not held out; those in no language (no text, no letter) go, and a missing lang is filled in."""
    model = language_id.train(docs.where(~language_id.held_out()))
    told = language_id.predict(docs.select(F.struct("*").alias("row"), "text"), model, F.col("row"))
    kept = told.where(F.col("row.text").rlike("\\p{L}") & ((F.col("lang_pred") != language_id.UNKNOWN) | F.lit(not model.languages)))
    filled = F.coalesce("row.lang", F.nullif(F.col("lang_pred"), F.lit(language_id.UNKNOWN)))
    return kept.select(*[filled.alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars is that of the masked text."""
    found = secret_scan.findings(docs, secret_scan.Ledger.of_tables(spark, f"{sf_dir}#pipeline"))
    text = secret_scan.redacted(F.coalesce("row.text", F.lit("")), F.col("spans"))
    masked = F.when(F.size("spans") > 0, text).otherwise(F.col("row.text"))
    changed = {"text": masked, "n_chars": F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are interleaved to their target weights; the rows come in that order."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", find_language),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Neither MinHash groups nor token ids can be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_checkpoints(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = docs.checkpoint()
    return docs
