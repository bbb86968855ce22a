"""Command line: python -m quirelake.cli ingest|search|ask ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from quirelake.plans import pipeline


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quirelake")
    sub = ap.add_subparsers(dest="what", required=True)
    p = sub.add_parser("ingest", help="payloads to chunks")
    p.add_argument("payloads")
    p.add_argument("out")
    for name in ("search", "ask"):
        p = sub.add_parser(name, help="questions against chunks")
        p.add_argument("chunks")
        p.add_argument("question")
        p.add_argument("--role", default="doctor")
        p.add_argument("--document")
        p.add_argument("--top", type=int, default=5)
    a = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "ingest":
        pipeline.ingest(spark.read.parquet(a.payloads)).write.mode("overwrite").parquet(a.out)
        return 0
    chunks = spark.read.parquet(a.chunks).select("chunk_id", F.col("record_id").cast("string").alias("document_id"), "section", "entity_focus", F.col("chunk_text").alias("text"))
    q = spark.createDataFrame([("q", a.question, a.role, a.document, 20, a.top)], "query_id string, query_text string, role string, document_id string, candidate_k int, top_k int")
    out = pipeline.ask(q, chunks) if a.what == "ask" else pipeline.retrieve(q, chunks).select("place", "chunk_id", "text")
    out.show(a.top, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
