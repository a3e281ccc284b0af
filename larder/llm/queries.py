"""Registered queries of the operators: each applies one to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (bpe, histogram_sort, importance, jaccard_join, line_dedup, order_minhash, rans, simhash_trie, substring_dedup, toxicity, vector_codes,
                        warc, winnowing)
from larder.session import scratch_path


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return line_dedup.clean(_table(spark, d, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op2_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = simhash_trie.near_duplicates(_table(spark, d, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op3_histogram_sort(spark: SparkSession, d: str) -> DataFrame:
    placed = histogram_sort.shard(_table(spark, d, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", F.crc32("text").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def held_out(doc_id) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def toxic_scores(spark: SparkSession, docs: DataFrame, d: str) -> DataFrame:
    """``docs`` with ``score``, from a classifier fitted on the labels of documents that are not held out."""
    labels = _table(spark, d, "labels").where(~held_out(F.col("doc_id")))
    return toxicity.score(docs, toxicity.fit(_table(spark, d, "documents"), labels))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    scored = toxic_scores(spark, _table(spark, d, "documents").select("doc_id", "text"), d)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_bpe_encode_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = bpe.encode(_table(spark, d, "documents"), decoded=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_order_minhash(spark: SparkSession, d: str) -> DataFrame:
    return order_minhash.compare(_table(spark, d, "documents"))


def op7_winnowing_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = winnowing.contamination(_table(spark, d, "documents"), _table(spark, d, "benchmark"))
    return found.drop("th")


def op8_warc(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "warc-archives")
    warc.write(_table(spark, d, "pages"), root)
    return warc.read(spark, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_rans_tokens(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, "token-files")
    rans.write(_table(spark, d, "documents"), root)
    return rans.read(spark, root, ids=False)


def op10_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = substring_dedup.dedup(_table(spark, d, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    found = importance.resample(_table(spark, d, "documents"), _table(spark, d, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    found = jaccard_join.classes(_table(spark, d, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op13_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    coded, codebook = vector_codes.compress(_table(spark, d, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_sha256(codebook)).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_histogram_sort": op3_histogram_sort,
    "op4_toxicity": op4_toxicity,
    "op5_bpe_encode_decode": op5_bpe_encode_decode,
    "op6_order_minhash": op6_order_minhash,
    "op7_winnowing_decontamination": op7_winnowing_decontamination,
    "op8_warc": op8_warc,
    "op9_rans_tokens": op9_rans_tokens,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup.oracle(),
    "op11_importance_resampling": importance.oracle(),
    "op12_jaccard_join": jaccard_join.oracle(),
    "op13_vector_codes": vector_codes.oracle(),
}
