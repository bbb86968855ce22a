"""Chunks of documents for search: sections carried forward, orders gathered, one numbered table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quirelake.functions import text as T
from quirelake.functions.staging import late_filter
from quirelake.operators import extract as E
from quirelake.operators.layout import block_order


def with_sections(blocks: DataFrame) -> DataFrame:
    """Adds to the ordered blocks of each page `section`, carried forward from the last heading, and `body` without it."""
    o = block_order(blocks).withColumn("s", T.section(F.coalesce("block.text", F.lit(""))))
    fallback = F.when(F.col("block.type") == "table", "table").when(F.col("block.type") == "form", "form").otherwise(F.nullif(T.section_name(F.col("block.title")), F.lit("")))
    last = F.last("s.section", ignorenulls=True).over(Window.partitionBy("record_id", "page_pos").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return o.withColumn("section", F.coalesce(last, fallback)).withColumn("body", F.coalesce("s.body", "block.text", F.lit("")))


def orders(lines: DataFrame, keys: list[str], at: str, line: str) -> DataFrame:
    """Lines of a document with the number of the order they belong to (0 before the first) and what they are.

    A line that starts an order opens one; continuations and fragments belong to it; other lines are notes of no order.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    starts, goes_on = T.starts_order(F.col(line)), T.continues_order(F.col(line))
    d = lines.withColumn("starts", starts).withColumn("before", F.lag(line).over(w))
    d = d.withColumn("order_no", F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = F.when(F.col("starts"), "start").when((F.col("order_no") > 0) & (goes_on | F.coalesce(T.fragment(F.col(line), F.coalesce("before", F.lit(""))), F.lit(False))), "continuation").otherwise("note")
    return d.withColumn("part", part).drop("before", "starts")


def order_texts(numbered: DataFrame, keys: list[str], at: str, line: str) -> DataFrame:
    """One text per order: its lines in order."""
    kept = numbered.where("part <> 'note'").groupBy(*keys, "order_no").agg(F.array_sort(F.collect_list(F.struct(at, line))).alias("l"))
    return kept.select(*keys, "order_no", F.array_join(F.transform("l", lambda x: x[line]), " ").alias("order_text"))


def distinct_lines(lines: DataFrame, keys: list[str], at: str, line: str) -> DataFrame:
    """A document's distinct lines (case ignored, first wins) in order, as one text."""
    first = lines.withColumn("n", F.row_number().over(Window.partitionBy(*keys, F.lower(line)).orderBy(at))).where("n = 1")
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at, line))).alias("l")).select(*keys, F.array_join(F.transform("l", lambda x: x[line]), "\n").alias("summary"), F.size("l").alias("lines"))


def build_chunks(blocks: DataFrame, most: int = 220, hard: int = 320, overlap: int = 40) -> DataFrame:
    """All chunks of every record: (record_id, chunk_index, chunk_id, page_pos, section, strategy, entity_focus, chunk_text, chunk_char_count, entity_types).

    Per block the first kind that yields something: table rows, form fields, medication lines, laboratory values, narrative
    packed to the token budget. Order: page, reading order, place within the block.
    """
    d = with_sections(blocks)
    text = F.coalesce("body", F.lit(""))
    table = F.filter(F.transform(F.coalesce("block.structured_data.rows", F.expr("array()")), lambda r: F.array_join(F.filter(F.transform(r, lambda c: F.when(F.trim(F.coalesce(c["v"], F.lit(""))) != "", F.concat(c["k"], F.lit(": "), F.trim(c["v"])))), lambda x: x.isNotNull()), "; ")), lambda x: x.isNotNull() & (x != ""))
    form = F.filter(F.split(E.render_fields(F.col("block.fields")), "\n"), lambda x: x != "")
    cleaned = F.transform(F.split(text, "\n"), lambda x: E.clean_line(x))
    meds = F.filter(cleaned, lambda x: E.signals(x)["prescription"])
    labs = F.transform(F.regexp_extract_all(text, F.lit(E.LAB), F.lit(0)), lambda m: F.trim(F.concat(F.regexp_extract(m, E.LAB, 1), F.lit(": "), F.regexp_extract(m, E.LAB, 2), F.lit(" "), F.regexp_extract(m, E.LAB, 3))))
    d = d.select("record_id", "page_pos", "ord", "section", "body", F.col("block.type").alias("type"), F.when(F.col("block.type") == "table", table).alias("table"), F.when(F.col("block.type") == "form", form).alias("form"), meds.alias("meds"), labs.alias("labs"))
    narrative = F.transform(T.pack_units(F.flatten(F.transform(T.units_of(F.col("body")), lambda u: T.cut_long(u, hard))), most, overlap), lambda p: F.array_join(p, " "))
    kind = F.when(F.size("table") > 0, "table_row").when(F.size("form") > 0, "form_field").when(F.size("meds") > 0, "medication").when(F.size("labs") > 0, "lab").otherwise("narrative")
    d = d.withColumn("kind", kind)
    parts = F.when(F.col("kind") == "table_row", F.col("table")).when(F.col("kind") == "form_field", F.col("form")).when(F.col("kind") == "medication", F.col("meds")).when(F.col("kind") == "lab", F.col("labs")).otherwise(narrative)
    rows = d.select("record_id", "page_pos", "ord", "section", "kind", F.posexplode(parts).alias("sub", "t"))
    rows = late_filter(rows, F.trim("t") != "")
    chunk = rows.withColumn("chunk_text", T.with_section(F.col("t"), F.col("section")))
    n = F.row_number().over(Window.partitionBy("record_id").orderBy("page_pos", "ord", "sub")) - 1
    strategy = F.when(F.col("kind") == "form_field", "form_fields").when(F.col("kind") == "narrative", "section_aware").otherwise("entity_preserving")
    types = F.array_sort(F.array_distinct(F.transform(E.entities(F.col("chunk_text")), lambda e: e["type"])))
    return chunk.withColumn("chunk_index", n).select("record_id", "chunk_index", F.format_string("%d:chunk:%04d", "record_id", "chunk_index").alias("chunk_id"), "page_pos", "section", strategy.alias("strategy"), F.when(F.col("kind") != "narrative", F.col("kind")).alias("entity_focus"), "chunk_text", F.length("chunk_text").alias("chunk_char_count"), types.alias("entity_types"))


DEMOGRAPHIC = ("name", "address", "dob", "date", "allergies", "weight", "mrn", "patient_id")
TITLES = {"name": "Patient Name", "address": "Address", "dob": "Date of Birth", "date": "Date", "allergies": "Allergies", "weight": "Weight", "mrn": "MRN", "patient_id": "Patient ID", "rx": "Prescription"}


def form_chunks(pairs: DataFrame) -> DataFrame:
    """Chunks of paired labels and values (record_id, page_pos, pair_no, label, value): one per pair, the first of equal ones,
    and a profile of the page where it has two demographic lines and more."""
    title = F.col("label")
    for key, name in TITLES.items():
        title = F.when(F.col("label") == key, name).otherwise(title)
    first = pairs.groupBy("record_id", "page_pos", "label", "value").agg(F.min("pair_no").alias("pair_no")).withColumn("line", F.concat(title, F.lit(": "), "value"))
    one = first.select("record_id", "page_pos", "pair_no", F.lit("form_field").alias("entity_focus"), F.col("line").alias("chunk_text"))
    profile = first.where(F.col("label").isin(*DEMOGRAPHIC)).groupBy("record_id", "page_pos").agg(F.array_sort(F.collect_list(F.struct("pair_no", "line"))).alias("l")).where("size(l) >= 2")
    return one.unionByName(profile.select("record_id", "page_pos", F.lit(-1).alias("pair_no"), F.lit("demographic_profile").alias("entity_focus"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("chunk_text")))
