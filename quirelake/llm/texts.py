"""The text fields that several operators read, as (field, item_id, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirelake.sources import block_texts, read_table


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read_table(spark, sf_dir, "medical_document_chunks")
    return chunks.where("chunk_id IS NOT NULL AND chunk_text IS NOT NULL").select(F.lit("chunk_text").alias("field"), F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("text"))


def payload_texts(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    blocks = block_texts(read_table(spark, sf_dir, "document_payloads"), *keep)
    return blocks.select(F.lit("block_text").alias("field"), F.concat_ws(":", "record_id", "page_pos", "block_pos").alias("item_id"), "text", *keep)


def truth_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = read_table(spark, sf_dir, "evaluation_texts")
    return truth.where("document_id IS NOT NULL AND ground_truth_text IS NOT NULL").select(F.lit("ground_truth_text").alias("field"), F.col("document_id").alias("item_id"), F.col("ground_truth_text").alias("text"))
