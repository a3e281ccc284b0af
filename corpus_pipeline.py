"""Training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the documents that stay, with the columns of ``documents``; the last
returns tokens. NULL ids and texts, repeated rows, empty tables and further
columns pass as each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import bpe, line_dedup, queries, simhash_trie, toxicity, winnowing
from larder.llm.common import own_names
from larder.session import materialize

#: A document goes if its score is this or more.
TOXIC = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC; learnt from the labels that are not held out."""
    labels = _table(spark, sf_dir, "labels").where(~queries.held_out(F.col("doc_id")))
    (score,) = own_names(docs, "_toxicity")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), score)
    return scored.where(F.col(score) < TOXIC).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their source's boilerplate lines; ``n_chars`` follows a changed text."""
    lines, dropped = own_names(docs, "_n_lines", "_n_dropped")
    cleaned = line_dedup.clean(docs, counts=(lines, dropped))
    if "n_chars" in docs.columns:
        now = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(dropped) > 0, now).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash_trie.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    found = winnowing.contamination(docs, _table(spark, sf_dir, "benchmark"))
    own_id, own_th = own_names(docs, "_id", "_th")
    bad = found.where("contaminated").select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[own_id]) & (F.xxhash64(docs["text"]) == bad[own_th]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: the texts' tokens, and a digest of the text that they decode to."""
    rows = bpe.encode(docs, decoded=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: Neither the classifier nor the tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, from ``documents``; each result is a table in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return docs
