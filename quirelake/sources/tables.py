"""Table readers and the schemas of the document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CELL = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
FIELD = T.StructType([T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType())])
METADATA = T.StructType(
    [
        T.StructField("reading_order", T.IntegerType()),
        T.StructField("layout_label", T.StringType()),
        T.StructField("layout_position", T.IntegerType()),
        T.StructField("region", T.StringType()),
        T.StructField("column_index", T.IntegerType()),
    ]
)
BLOCK = T.StructType(
    [
        T.StructField("block_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("needs_review", T.BooleanType()),
        T.StructField("title", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), FIELD)),
        T.StructField(
            "structured_data",
            T.StructType([T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(CELL)))]),
        ),
        T.StructField("metadata", METADATA),
    ]
)
PAGE = T.StructType(
    [T.StructField("page_number", T.IntegerType()), T.StructField("page_type", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK))]
)
PAYLOAD = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("document_id", T.StringType()),
        T.StructField("input_file", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("pages", T.ArrayType(PAGE)),
    ]
)


def schema_of(name: str) -> T.DataType:
    """The declared type of one level of the document model."""
    return {"payload": PAYLOAD, "page": PAGE, "block": BLOCK, "field": FIELD, "cell": CELL, "metadata": METADATA}[name]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_texts(payloads: DataFrame, *keep: str) -> DataFrame:
    """One row per block that has a text: record_id, page_pos, block_pos, text and the block fields named in keep.

    Positions count from 0 and include null elements. Null pages, null blocks and null texts give no row. Rows repeated
    under one record_id are kept; callers that need each block once drop duplicates after their own narrowing.
    """
    pages = payloads.select("record_id", F.posexplode("pages").alias("page_pos", "page"))
    blocks = pages.select("record_id", "page_pos", F.posexplode("page.blocks").alias("block_pos", "block"))
    return blocks.where(F.col("block.text").isNotNull()).select(
        "record_id", "page_pos", "block_pos", F.col("block.text").alias("text"), *[F.col(f"block.{k}").alias(k) for k in keep]
    )
