"""Corpus pipeline: stages of ``(spark, docs, sf_dir) -> DataFrame``, each written and read again.

1. quality       documents whose perplexity under a model of trusted text is above the
                 threshold of their language go (``labels`` name the trusted documents).
2. line_dedup    of lines that are alike (Jaccard 0.8 or more on words) the earliest stays.
3. near_dedup    of documents whose SimHash fingerprints link, the smallest id stays.
4. packing       documents get a length bucket and a batch within the token budget.

Each stage works on all that its predecessor kept.  The first three return the
columns of ``documents`` (``n_chars`` is that of the text they return); the last adds
token counts and the batch.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookspark.llm import line_dedup as lines
from bookspark.llm import packing as pack
from bookspark.llm import quality as classifier
from bookspark.llm import simhash
from bookspark.llm.token_counts import added_names, with_token_counts
from bookspark.session import write_and_reload

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one."""
    out = lines.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (3-word shingles, 3 bits)."""
    return simhash.dedup(docs, shingle_words=3, max_bits=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token counts, length bucket and batch."""
    return pack.pack(with_token_counts(docs, VOCABULARY, cover=True), added_names(docs.columns)["n_tokens"], order_by=["doc_id"])


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

# The quality model, SimHash and the bucket boundaries are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_and_reload(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
