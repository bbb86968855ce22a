"""Streams: event windows with late data, arrivals without repeats, job states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirelake.operators.registry import unseen, upsert
from quirelake.session import durable


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the checkpoint folder that all executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        durable(spark.range(1))
    return f"{sc.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def window_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and event type; events later than `late` behind the newest are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    marked = events.withWatermark("ts", late)
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def first_arrivals(files: DataFrame, key: str = "file_hash", at: str = "arrived_at", within: str = "1 day") -> DataFrame:
    """Arrivals without those whose content arrived before, within the watermark."""
    return files.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote."""
    out = shared_folder(spark)
    query = stream.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/progress").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def ingest_into(registry_path: str, key: str = "file_hash"):
    """A foreachBatch function: new content is added to the registry table, repeats are skipped; safe to run again for a batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates([key]).withColumn("batch_id", F.lit(batch_id))
        try:
            known = spark.read.parquet(registry_path).where(F.col("batch_id") != batch_id)
        except Exception:
            known = spark.createDataFrame([], once.schema)
        durable(unseen(once, known, key)).write.mode("append").parquet(registry_path)

    return run


def job_states(states: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest state of every job; progress is kept within 0 to 100."""
    clamp = changes.withColumn("progress", F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress"))))
    return upsert(states, clamp, ["job_id"], ["updated_at", "progress"])
