"""A training corpus from raw documents: drop poor ones, drop near copies, mix the sources, tokenize.

run() writes each stage as Parquet in the shared folder and reads it again as the next stage's input. Every stage
but the last returns the columns of documents.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm import byte_bpe, mixing, near_dedup, quality
from contrail.llm.common import stage, table

#: The pipeline's near copies: a Jaccard similarity of their five-word shingles of so many hundredths. op5_near_dedup has 85.
NEAR_PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, fitted on the labelled ones, rejects. All columns stay as they are."""
    thin = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality.score(thin, quality.fit(docs, table(spark, sf_dir, "labels"))).where("predicted = 1").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = 85) -> DataFrame:
    """Keeps one row of each group of near copies: that of the smallest doc_id, null last, and then of the smallest digest."""
    kept = near_dedup.one_of_each(docs, percent).select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("own_digest"), F.col("text").isNull().alias("own_null"))
    rows = own.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_digest") == F.col("kept_digest")), "left_semi")
    return rows.dropDuplicates(["own_id", "own_digest", "own_null"]).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does, none to three times."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's ids and decoded bytes."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", keep_good), ("near_dedup", partial(drop_near_copies, percent=NEAR_PERCENT)), ("mix", mix_sources), ("byte_bpe", tokenize)]

#: No SQL: the classifier and the tokenizer can't be expressed in it. tests/llm checks each stage on its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"corpus-{name}")
    return docs
