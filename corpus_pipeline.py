"""The corpus pipeline: stages that each apply one operator to what the last one kept.

Every stage but the last returns the columns of `documents`. Defined results: a null
text is rejected by the quality rules; documents of which line dedup leaves no word go;
of near-duplicates the one with the smallest doc_id stays; documents without a doc_id
are told apart by their text and come after those that have one; mixing repeats documents of
small sources and drops none; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import line_dedup, mixing, near_dedup, packing, quality
from talentloom.session import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.cascade(docs, kept_only=True)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line, exactly or nearly."""
    cleaned = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    # Texts without a doc_id get keys from their hash, at the upper end of the range.
    hashed = F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), hashed))
    found = near_dedup.near_duplicates(keyed, doc_id="_key").where("kept").groupBy("doc_id").agg(F.max("n_shingles").alias("_items"))
    kept = keyed.join(found.withColumnRenamed("doc_id", "_key"), "_key")
    alike = F.col("doc_id").isNull() & (F.col("_items") > 0)  # copies of one text share a key
    first = kept.where(alike).groupBy("_key").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return kept.where(~alike).select(*docs.columns).unionByName(first.select("_row.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them: each once at least, those of small
    sources again, up to one and a half times."""
    return mixing.mixed_documents(docs, repetition=1.5)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
# Signatures, token ids and packing are not expressible in SQL; brute-force tests stand in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
