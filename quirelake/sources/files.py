"""Files as tables and tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SUFFIXES = ("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents in a folder: path, document_id (the stem), file_hash (SHA-256 of the content), length, modificationTime, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").rlike(r"\.(" + "|".join(SUFFIXES) + ")$")).select("path", stem(F.col("path")).alias("document_id"), F.sha2("content", 256).alias("file_hash"), "length", "modificationTime", "content")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[A-Za-z0-9]+$", "")


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON documents, one object or list per file."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_texts(df: DataFrame, path: str, text: str) -> None:
    df.select(text).write.mode("overwrite").text(path)


def write_log(df: DataFrame, path: str) -> None:
    """Appends log rows, partitioned by day."""
    df.write.mode("append").partitionBy("accessed_day").parquet(path)
