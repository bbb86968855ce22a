"""Values of the row before, and running numbers, in ordered groups of any size.

A group is cut into buckets (days, say); windows run within a bucket, and what a bucket needs from the ones before it is
carried over by a small table of one row per bucket. A group that holds a third of all rows is so worked on in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_previous(df: DataFrame, key: str, order: list[str], value: str, bucket: Column, out: str) -> DataFrame:
    """Adds the value of the row before in the order of the key; the bucket must not decrease along the order."""
    d = df.withColumn("_b", bucket)
    last = d.groupBy(key, "_b").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    before = last.select(key, "_b", F.lag("_last").over(Window.partitionBy(key).orderBy("_b")).alias("_prev"))
    d = d.join(before, [key, "_b"])
    return d.withColumn(out, F.coalesce(F.lag(value).over(Window.partitionBy(key, "_b").orderBy(*order)), "_prev")).drop("_prev", "_b")


def with_running_sum(df: DataFrame, key: str, order: list[str], value: str, bucket: Column, out: str) -> DataFrame:
    """Adds the sum of the values up to each row in the order of the key."""
    d = df.withColumn("_b", bucket)
    per = d.groupBy(key, "_b").agg(F.sum(value).alias("_s"))
    before = per.select(key, "_b", (F.sum("_s").over(Window.partitionBy(key).orderBy("_b")) - F.col("_s")).alias("_before"))
    d = d.join(before, [key, "_b"])
    running = F.sum(value).over(Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn(out, running + F.col("_before")).drop("_before", "_b")
