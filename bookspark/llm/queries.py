"""The registered queries of the operators: ``(spark, sf_dir) -> DataFrame``."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookspark.llm import (bpe, filter_audit, fingerprints, line_dedup, lm_scoring, packing, quality, simhash, token_counts,
                           token_store, topk, warc, whitening)
from bookspark.session import write_and_reload


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_warc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cover=True)
    lengths = write_and_reload(counts.select("doc_id", "n_tokens"), "lengths")
    return packing.pack(lengths, "n_tokens", order_by=["doc_id"])


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select(F.col("_id").alias("doc_id"), F.col("_lang").alias("lang"), "perplexity", "threshold", "keep")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe.decode(encoded, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cover=True)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=4)
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = token_store.store_report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return stored.select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_warc_conversion": op2_warc_conversion,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_output": op13_token_output,
}
