"""Filters that stay where they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def late_filter(df: DataFrame, condition: Column) -> DataFrame:
    """Filters on computed columns without being pushed below them.

    A pushed filter repeats the expressions of the columns it reads, once for the filter and once for the result, and
    long chains of them grow past what can be compiled. The partition's number in the condition keeps it in its place.
    """
    return df.withColumn("_late", F.spark_partition_id()).where(condition & (F.col("_late") >= 0)).drop("_late")
