"""The access log: masked entries, range scans, pages by key."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, functions as F

from quirelake.operators import privacy as P


def entries(accesses: DataFrame) -> DataFrame:
    """Log rows of (audit_id, ts, actor_name, actor_role, query_text, document_id, status, error): keyed by time and id, masked."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    masked = lambda c: P.generalise(P.redact(F.coalesce(F.col(c), F.lit("")), P.pick_spans(P.find_spans(F.col(c)))))
    name = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown"))
    doc = F.nullif(F.trim(F.col("document_id")), F.lit(""))
    return accesses.select(
        F.concat(stamp, F.lit("#"), F.col("audit_id")).alias("accessed_at"), F.to_date("ts").alias("accessed_day"), "audit_id", name("actor_name").alias("actor_name"), F.lower(name("actor_role")).alias("actor_role"),
        P.authorised(F.col("actor_role")).alias("authorized"), F.lower(name("status")).alias("status"), masked("query_text").alias("query_masked"), F.coalesce(P.identity(F.col("query_text")), F.lit("")).alias("query_hash"),
        F.when(doc.isNotNull(), 1).otherwise(0).alias("document_count"), F.coalesce(P.identity(doc), F.lit("")).alias("document_hash"), masked("error").alias("error_masked"),
    )


def in_range(day: Column, first: str | None, last: str | None) -> Column:
    """Days from first to last, both included; open where null."""
    cond = day.isNotNull()
    if first:
        cond = cond & (day >= F.lit(first).cast("date"))
    if last:
        cond = cond & (day <= F.lit(last).cast("date"))
    return cond


def cursor_of(accessed_at: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"before": accessed_at}).encode()).decode()


def cursor_at(cursor: str | None) -> str | None:
    """The key in a cursor; None for a missing or malformed one, which means the first page."""
    try:
        return str(json.loads(base64.urlsafe_b64decode((cursor or "").encode()))["before"])
    except Exception:
        return None


def page(log: DataFrame, size: int, cursor: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """One page, newest first; the next begins behind the key of its last row. Partitions by day are pruned by the range."""
    rows = log.where(in_range(F.col("accessed_day"), first, last))
    before = cursor_at(cursor)
    if before:
        rows = rows.where(F.col("accessed_at") < before)
    return rows.orderBy(F.desc("accessed_at")).limit(size)


def public(log: DataFrame) -> DataFrame:
    """Rows as shown: the time without the id, no hash of the question."""
    return log.withColumn("accessed_at", F.substring_index("accessed_at", "#", 1)).drop("query_hash", "audit_id")
