"""Keyed tables with last-write-wins: index upserts, the registry of processed files, artifact keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def last_write(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key that is last by the given columns (nulls first); aggregated before the shuffle, so a hot key is no hot task."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*by)).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Old rows without the new keys, and the last new row of each key."""
    last = last_write(new, keys, by)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def replace_documents(old: DataFrame, new: DataFrame, document: str = "document_id") -> DataFrame:
    """All rows of the new rows' documents replaced, so that a document with fewer chunks leaves none behind."""
    return old.join(new.select(document).distinct(), document, "left_anti").unionByName(new, allowMissingColumns=True)


def unseen(files: DataFrame, registry: DataFrame, key: str = "file_hash") -> DataFrame:
    """Files whose content is not in the registry."""
    return files.join(registry.select(key).distinct(), key, "left_anti")


def artifact_key(prefix: Column, document_id: Column, *parts: Column) -> Column:
    """'prefix/document/part/...' without empty parts and doubled slashes."""
    cleaned = [F.regexp_replace(c, "^/+|/+$", "") for c in (prefix, document_id, *parts)]
    return F.array_join(F.filter(F.array(*cleaned), lambda x: x.isNotNull() & (x != "")), "/")


def split_uri(uri: Column) -> Column:
    """Struct (scheme, bucket, key) of an object's address; nulls where it is none."""
    pattern = r"^([a-z0-9]+)://([^/]+)/(.+)$"
    ok = uri.rlike(pattern)
    return F.struct(*[F.when(ok, F.regexp_extract(uri, pattern, i)).alias(n) for i, n in ((1, "scheme"), (2, "bucket"), (3, "key"))])


def sorted_json(m: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def read_map(text: Column) -> Column:
    """A JSON object of strings as a map; an empty map for malformed or missing text."""
    return F.coalesce(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}), F.expr("CAST(map() AS map<string,string>)"))
