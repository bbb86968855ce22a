"""Queries of the general problems: units (2) and nested records (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirelake.operators import flatten, units
from quirelake.sources import read_table


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measured value with its recorded unit and its value in the common unit."""
    return units.harmonise(read_table(spark, sf_dir, "document_payloads"), read_table(spark, sf_dir, "lab_units"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows recorded in another unit than the common one."""
    return p2_values(spark, sf_dir).where("NOT is_common").select("record_id", "page_pos", "block_pos", "row_pos", "unit_code").distinct()


def p2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values per quantity and recorded unit."""
    v = p2_values(spark, sf_dir)
    return v.groupBy("quantity", "unit_code").agg(F.count("*").alias("n"), F.min("value_common").alias("low"), F.max("value_common").alias("high"))


def _nodes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...], values: bool) -> DataFrame:
    return flatten.all_nodes(read_table(spark, sf_dir, "document_payloads"), read_table(spark, sf_dir, "raw_payloads"), kinds, values)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, block, field and cell of both payload tables."""
    nodes = _nodes(spark, sf_dir, ("page", "block", "field", "cell"), False)
    return nodes.select("record_id", "page_pos", "block_pos", "row_pos", "kind", "item_key")


def p4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.pages_table(_nodes(spark, sf_dir, ("page",), True))


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.blocks_table(_nodes(spark, sf_dir, ("block",), True)).drop("bbox", "confidence")


def p4_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.fields_table(_nodes(spark, sf_dir, ("field",), True))


def p4_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.cells_table(_nodes(spark, sf_dir, ("cell",), True))


def p4_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.metadata_table(_nodes(spark, sf_dir, ("meta",), True))


QUERIES = {f.__name__: f for f in (p2_found, p2_values, p2_summary, p4_found, p4_pages, p4_blocks, p4_fields, p4_cells, p4_metadata)}

# Both payload tables as JSON, one row per record.
_JSON = """
WITH typed AS (SELECT record_id, any_value(to_json({'pages': pages})) AS j FROM document_payloads GROUP BY record_id),
raw AS (SELECT record_id, any_value(payload)::JSON AS j FROM raw_payloads WHERE json_valid(payload) GROUP BY record_id),
docs AS (SELECT record_id, j, true AS typed FROM typed UNION ALL SELECT record_id, j, false FROM raw),
pg AS (SELECT record_id, typed, unnest(range(json_array_length(j->'pages')::BIGINT))::INT AS page_pos, j FROM docs WHERE json_type(j->'pages') = 'ARRAY'),
pages AS (SELECT record_id, typed, page_pos, j->'pages'->page_pos AS p FROM pg WHERE json_type(j->'pages'->page_pos) = 'OBJECT'),
bl AS (SELECT record_id, typed, page_pos, unnest(range(json_array_length(p->'blocks')::BIGINT))::INT AS block_pos, p FROM pages WHERE json_type(p->'blocks') = 'ARRAY'),
blocks AS (SELECT record_id, typed, page_pos, block_pos, p->'blocks'->block_pos AS b FROM bl WHERE json_type(p->'blocks'->block_pos) = 'OBJECT'),
fk AS (SELECT record_id, page_pos, block_pos, unnest(json_keys(b->'fields')) AS k, b FROM blocks WHERE json_type(b->'fields') = 'OBJECT'),
fields AS (SELECT record_id, page_pos, block_pos, k, json_extract(b->'fields', '$."' || k || '"') AS v FROM fk),
mk AS (SELECT record_id, page_pos, block_pos, unnest(json_keys(b->'metadata')) AS k, b FROM blocks WHERE json_type(b->'metadata') = 'OBJECT'),
rw AS (SELECT record_id, page_pos, block_pos, unnest(range(json_array_length(b->'structured_data'->'rows')::BIGINT))::INT AS row_pos, b FROM blocks WHERE json_type(b->'structured_data'->'rows') = 'ARRAY'),
row_ AS (SELECT record_id, page_pos, block_pos, row_pos, b->'structured_data'->'rows'->row_pos AS r, b->'structured_data'->'columns' AS c FROM rw),
objects AS (SELECT *, unnest(json_keys(r)) AS k FROM row_ WHERE json_type(r) = 'OBJECT'),
lists AS (SELECT *, unnest(range(json_array_length(r)::BIGINT))::INT AS i FROM row_ WHERE json_type(r) = 'ARRAY'),
cells AS (
  SELECT record_id, page_pos, block_pos, row_pos, k, json_extract(r, '$."' || k || '"') AS v FROM objects
  UNION ALL
  SELECT record_id, page_pos, block_pos, row_pos, CASE WHEN json_type(r->i) = 'OBJECT' THEN ((r->i)->>'k') ELSE coalesce((c->>i), 'column_' || i) END, CASE WHEN json_type(r->i) = 'OBJECT' THEN ((r->i)->'v') ELSE (r->i) END
  FROM lists WHERE json_type(r->i) <> 'OBJECT' OR ((r->i)->>'k') IS NOT NULL)
"""
SQL = {
    "p4_found": _JSON
    + """SELECT record_id, page_pos, -1 AS block_pos, -1 AS row_pos, 'page' AS kind, '' AS item_key FROM pages
UNION ALL SELECT record_id, page_pos, block_pos, -1, 'block', '' FROM blocks
UNION ALL SELECT record_id, page_pos, block_pos, -1, 'field', k FROM fields
UNION ALL SELECT record_id, page_pos, block_pos, row_pos, 'cell', k FROM cells""",
    "p4_pages": _JSON + "SELECT record_id, page_pos, (p->>'page_number')::INT AS page_number, p->>'page_type' AS page_type FROM pages",
    "p4_blocks": _JSON + "SELECT record_id, page_pos, block_pos, b->>'block_id' AS block_id, b->>'type' AS type, b->>'text' AS text, b->>'source' AS source, (b->>'needs_review')::BOOLEAN AS needs_review, b->>'title' AS title FROM blocks",
    "p4_fields": _JSON + "SELECT record_id, page_pos, block_pos, k AS name, CASE WHEN json_type(v) = 'OBJECT' THEN v->>'value' ELSE v->>'$' END AS value, CASE WHEN json_type(v) = 'OBJECT' THEN (v->>'confidence')::DOUBLE END AS confidence FROM fields",
    "p4_cells": _JSON + "SELECT record_id, page_pos, block_pos, row_pos, k AS column_name, CASE WHEN json_type(v) = 'OBJECT' THEN v->>'value' ELSE v->>'$' END AS value FROM cells",
    "p4_metadata": _JSON + """SELECT record_id, page_pos, block_pos, k AS name, json_extract_string(b->'metadata', '$."' || k || '"') AS value FROM mk""",
}
