"""Queries of page routing, geometry, order and layout."""

from __future__ import annotations

import re

from pyspark.sql import Window, functions as F

from quirelake.functions import geometry as G
from quirelake.functions import text as T
from quirelake.operators import layout as L
from quirelake.operators import quality as Q
from quirelake.operators.sequence import with_previous, with_running_sum
from quirelake.plans.extract_queries import _BLOCKS, _blocks
from quirelake.sources import read_table

W, H = 612.0, 792.0


def _pages(spark, sf_dir):
    p = read_table(spark, sf_dir, "document_payloads").select("record_id", "input_file", "pages").dropDuplicates(["record_id"])
    return p.select("record_id", "input_file", F.posexplode("pages").alias("page_pos", "page")).where("page IS NOT NULL")


def image_coverage(spark, sf_dir):
    boxes = F.transform(F.coalesce("page.blocks", F.expr("array()")), lambda b: b["bbox"])
    return _pages(spark, sf_dir).select("record_id", "page_pos", Q.image_coverage(F.lit(W * H), boxes).alias("c")).select("record_id", "page_pos", F.round("c.coverage", 4).alias("coverage"), "c.images")


def page_route(spark, sf_dir):
    boxes = F.transform(F.filter(F.coalesce("page.blocks", F.expr("array()")), lambda b: b["type"] == "image_ocr"), lambda b: b["bbox"])
    text = F.array_join(F.transform(F.coalesce("page.blocks", F.expr("array()")), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    d = _pages(spark, sf_dir).select("record_id", "page_pos", "input_file", text.alias("text"), Q.image_coverage(F.lit(W * H), boxes).alias("c"))
    d = T.with_quality(d, "text").withColumn("good", F.col("quality") == "good").withColumn("mostly", F.col("c.coverage") >= Q.MOSTLY)
    d = d.withColumn("hand", Q.handwritten(F.col("input_file"), F.col("text"), F.col("good"), F.col("mostly")))
    return d.select("record_id", "page_pos", "quality", "hand", Q.page_class(F.col("hand"), F.col("good"), F.col("c.images"), F.col("mostly")).alias("page_class"))


def crop_heuristic(spark, sf_dir):
    b = _blocks(spark, sf_dir).where("size(block.bbox) = 4")
    return b.select("record_id", "page_pos", "block_pos", Q.crop_class(G.width(F.col("block.bbox")), G.height(F.col("block.bbox")), F.col("block.text")).alias("c")).select("record_id", "page_pos", "block_pos", "c.label", "c.confidence")


def review_flags(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return p.select("record_id", "page_pos", Q.page_review(F.col("page.page_type"), F.col("page.blocks")).alias("needs_review"), Q.flagged_blocks(F.col("page.blocks")).alias("flagged"))


def doc_summary(spark, sf_dir):
    """Counts per record: pages by class, blocks, tables, forms, prescriptions, flagged blocks."""
    p = read_table(spark, sf_dir, "document_payloads").select("record_id", "pages").dropDuplicates(["record_id"])
    d = p.select("record_id", F.explode_outer("pages").alias("page")).select("record_id", "page", F.explode_outer("page.blocks").alias("b"), F.monotonically_increasing_id().alias("_n"))
    pages = p.select("record_id", F.explode_outer("pages").alias("page")).groupBy("record_id").agg(F.count("page").alias("total_pages"), *[F.count_if(F.col("page.page_type") == c).alias(c) for c in ("copyable_pdf", "mixed_pdf", "handwritten_prescription", "fully_scanned_report_form_table")])
    blocks = d.groupBy("record_id").agg(F.count("b").alias("total_blocks"), *[F.count_if(F.col("b.type") == t).alias(n) for t, n in (("table", "tables"), ("form", "forms"), ("prescription_item", "prescriptions"))], F.count_if(F.col("b.needs_review")).alias("flagged"))
    return pages.join(blocks, "record_id")


def usage_totals(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.col("value") * 0.002), 4).alias("cost"))


def bbox_ops(spark, sf_dir):
    b = _blocks(spark, sf_dir).where("size(block.bbox) = 4")
    box = F.col("block.bbox")
    r = lambda c: F.transform(c, lambda x: F.round(x, 3))
    ops = b.select(
        "record_id", "page_pos", "block_pos", G.to_thousand(box, F.lit(W), F.lit(H)).alias("thousand"), r(G.clip(box, F.lit(300.0), F.lit(400.0))).alias("clipped"), r(G.pad(box, 10.0, F.lit(W), F.lit(H))).alias("padded"),
        r(G.shift(box, F.lit(5.0), F.lit(-5.0))).alias("shifted"), r(G.flip(box, F.lit(H))).alias("flipped"), r(G.scale(box, F.lit(150 / 72))).alias("pixels"), r(G.union(box, F.array(F.lit(0.0), F.lit(0.0), F.lit(50.0), F.lit(50.0)))).alias("united"),
    )
    names = ("thousand", "clipped", "padded", "shifted", "flipped", "pixels", "united")
    return ops.select("record_id", "page_pos", "block_pos", *[F.col(n)[i].alias(f"{n}_{i}") for n in names for i in range(4)])


def neighbour_overlap(spark, sf_dir):
    """Overlaps of each block with the next of its page."""
    b = _blocks(spark, sf_dir)
    n = b.withColumn("next", F.lead("block.bbox").over(Window.partitionBy("record_id", "page_pos").orderBy("block_pos"))).where("size(block.bbox) = 4 AND size(next) = 4")
    return n.select("record_id", "page_pos", "block_pos", F.round(G.x_overlap(F.col("block.bbox"), F.col("next")), 6).alias("x_overlap"), F.round(G.covered(F.col("block.bbox"), F.col("next")), 6).alias("covered"))


def block_order(spark, sf_dir):
    return L.block_order(_blocks(spark, sf_dir)).select("record_id", "page_pos", "block_pos", "ord")


def region_order(spark, sf_dir):
    return L.region_order(_blocks(spark, sf_dir)).select("record_id", "page_pos", "block_pos", "region", "priority", "ord")


def right_side_values(spark, sf_dir):
    return L.right_side_values(_blocks(spark, sf_dir))


def best_layout(spark, sf_dir):
    """Layout boxes: the four quarters of the page."""
    b = _blocks(spark, sf_dir)
    quarters = [(0, "Header", [0.0, 0.0, 306.0, 200.0]), (1, "Paragraph", [306.0, 0.0, 612.0, 200.0]), (2, "Table", [0.0, 200.0, 306.0, 792.0]), (3, "Form", [306.0, 200.0, 612.0, 792.0])]
    each = F.array(*[F.struct(F.lit(n).alias("box_no"), F.lit(label).alias("label"), F.array(*map(F.lit, box)).alias("box")) for n, label, box in quarters])
    boxes = b.select("record_id", "page_pos").distinct().select("*", F.inline(each))
    return L.best_layout(b, boxes).select("record_id", "page_pos", "block_pos", "box_no", "label", F.round("share", 6).alias("share"))


def span_groups(spark, sf_dir):
    """Runs of one event type of a user: length and mean value."""
    e = read_table(spark, sf_dir, "events")
    day, order = F.to_date("ts"), ["ts", "event_id"]
    g = with_previous(e, "user_id", order, "event_type", day, "p").withColumn("new", F.when(F.col("p") == F.col("event_type"), 0).otherwise(1))
    g = with_running_sum(g, "user_id", order, "new", day, "run")
    return g.groupBy("user_id", "run", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean_value"))


def paragraph_merge(spark, sf_dir):
    def fold(rows):
        return [(r["record_id"], r["page_pos"], r["block_pos"], r["text"], r["bbox"], r["confidence"], r["merged"]) for r in L.merge_paragraphs(rows)]

    return L.per_page(_blocks(spark, sf_dir), fold, "record_id bigint, page_pos int, block_pos int, text string, bbox array<double>, confidence double, merged int")


def column_cluster(spark, sf_dir):
    def fold(rows):
        rows = [r for r in rows if r["bbox"]]
        return [(r["record_id"], r["page_pos"], r["block_pos"], c) for r, c in zip(rows, L.cluster_columns([(r["bbox"][0], r["bbox"][2]) for r in rows], W))]

    return L.per_page(_blocks(spark, sf_dir), fold, "record_id bigint, page_pos int, block_pos int, column_no int")


_FITS = {
    "name": re.compile(r"[^\W\d_][^\d]*\s[^\d]+"), "address": re.compile(r".*(?:,|\d).*"), "dob": re.compile(r".*\d+[./-]\d+[./-]\d+.*"), "date": re.compile(r".*\d+[./-]\d+[./-]\d+.*"), "allergies": re.compile(r"[^\d]*[a-zA-Z][^\d]*"),
    "weight": re.compile(r"\d+(?:\.\d+)?\s*(?:kgs?|lbs?)?", re.I), "mrn": re.compile(r".*\d.*"), "patient_id": re.compile(r".*\d.*"), "rx": re.compile(r".*(?:mg|tab|cap).*", re.I),
}


def label_pairing(spark, sf_dir):
    """Label lines of a page's forms with the value lines that follow, by kind."""
    def fold(rows):
        labels, values = [], []
        for r in rows:
            for line in (r["text"] or "").split("\n") if r["type"] == "form" else ():
                key = T.LABELS.get(re.sub(r"\s*[:\-]?\s*$", "", line).strip().lower())
                if key:
                    labels.append(key)
                elif line.strip() and not re.match(r"[A-Za-z ]+ ?[:\-] ", line):
                    values.append(line.strip())
        pairs = L.pair_labels(labels, values, lambda k, v: bool(_FITS[k].fullmatch(v)))
        return [(rows[0]["record_id"], rows[0]["page_pos"], i, k, v) for i, (k, v) in enumerate(pairs)] if rows else []

    return L.per_page(_blocks(spark, sf_dir), fold, "record_id bigint, page_pos int, pair_no int, label string, value string")


def line_merge(spark, sf_dir):
    """Prescription blocks of a page joined with their continuations."""
    anchor = lambda t: bool(re.search(r"(?i)\b(?:tab|cap|syp|inj)\b|\d\s?(?:mg|mcg|g|ml)\b", t))
    goes_on = lambda t: bool(re.search(r"(?i)\b(?:od|bd|tds|qid|hs|sos|stat|\d-\d-\d|before|after|with meals?|bedtime)\b", t))

    def fold(rows):
        lines = [r for r in rows if r["bbox"] and r["text"]]
        return [(g[0]["record_id"], g[0]["page_pos"], g[0]["block_pos"], " ".join(x["text"] for x in g), len(g)) for g in L.merge_lines(lines, H, anchor, goes_on)]

    return L.per_page(_blocks(spark, sf_dir).where("block.type = 'prescription_item'"), fold, "record_id bigint, page_pos int, block_pos int, text string, lines int")


QUERIES = {f.__name__: f for f in (image_coverage, page_route, crop_heuristic, review_flags, doc_summary, usage_totals, bbox_ops, neighbour_overlap, block_order, region_order, right_side_values, best_layout, span_groups, paragraph_merge, column_cluster, label_pairing, line_merge)}

_PAGES = """pgs AS (SELECT record_id, input_file, (i - 1)::INT AS page_pos, pages[i] AS p FROM (SELECT record_id, input_file, pages, unnest(range(1, len(pages) + 1)) AS i FROM (SELECT DISTINCT ON (record_id) * FROM document_payloads)) WHERE pages[i] IS NOT NULL)"""
_AREA = "greatest(x[3] - x[1], 0) * greatest(x[4] - x[2], 0)"
_WS = r" \t\n\r\f\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LB = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def _has(col, markers):
    return "(" + " OR ".join(f"contains({col}, '{m}')" for m in markers) + ")"


_X, _Y = "coalesce(b.bbox[1], 1e9)", "coalesce(b.bbox[2], 1e9)"
SQL = {
    "image_coverage": f"WITH {_PAGES}, a AS (SELECT record_id, page_pos, list_filter(list_transform(list_filter(list_transform(p.blocks, lambda b: b.bbox), lambda x: len(x) = 4), lambda x: {_AREA}), lambda v: v / {W * H} >= 0.02) AS a FROM pgs) SELECT record_id, page_pos, round(coalesce(list_sum(a), 0) / {W * H}, 4) AS coverage, coalesce(len(a), 0)::INT AS images FROM a",
    "page_route": rf"""WITH {_PAGES}, t AS (SELECT record_id, page_pos, input_file, coalesce(array_to_string(list_transform(p.blocks, lambda b: coalesce(b.text, '')), chr(10)), '') AS text, list_filter(list_transform(list_filter(list_transform(list_filter(p.blocks, lambda b: b.type = 'image_ocr'), lambda b: b.bbox), lambda x: len(x) = 4), lambda x: {_AREA}), lambda v: v / {W * H} >= 0.02) AS a FROM pgs),
s AS (SELECT *, regexp_replace(text, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS t FROM t),
m AS (SELECT *, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_/%.\-]+')) AS w, (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g'))) / greatest(length(t), 1)::DOUBLE AS al, (length(t) - length(regexp_replace(t, '[^\p{{L}}\p{{N}}{_WS}.,:;\-/()%]', '', 'g'))) / greatest(length(t), 1)::DOUBLE AS we,
 list_filter(list_transform(string_split_regex(t, '{_LB}'), lambda l: regexp_replace(l, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda l: l <> '') AS l FROM s),
q AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN (length(t) >= 100 OR w >= 6) AND al >= 0.45 AND we <= 0.25 AND CASE WHEN len(l) > 0 THEN 1 - len(list_distinct(l)) / len(l)::DOUBLE ELSE 0 END <= 0.40 THEN 'good' ELSE 'poor' END AS quality, coalesce(list_sum(a), 0) / {W * H} >= 0.70 AS mostly, coalesce(len(a), 0) AS images, lower(text) AS low FROM m),
h AS (SELECT *, (list_has_any(string_split_regex(regexp_replace(lower(coalesce(input_file, '')), '^.*/|\.[a-z0-9]+$', '', 'g'), '[_-]'), [{', '.join(repr(x) for x in Q.NAME_HINTS)}]) AND mostly) OR ({_has('low', Q.TEXT_HINTS)} AND quality <> 'good') OR (mostly AND ({_has('low', Q.TEXT_MARKERS)} OR regexp_matches(low, '(^|[^A-Za-z0-9_])(?:\d+\s?(?:mg|mcg|ml|g))([^A-Za-z0-9_]|$)'))) AS hand FROM q)
SELECT record_id, page_pos, quality, hand, CASE WHEN hand THEN 'handwritten_prescription' WHEN quality = 'good' AND images = 0 THEN 'copyable_pdf' WHEN quality = 'good' THEN 'mixed_pdf' WHEN mostly THEN 'fully_scanned_report_form_table' ELSE 'unknown' END AS page_class FROM h""",
    "crop_heuristic": f"""WITH {_BLOCKS}, s AS (SELECT record_id, page_pos, block_pos, greatest(b.bbox[3] - b.bbox[1], 0) AS w, greatest(b.bbox[4] - b.bbox[2], 0) AS h, lower(coalesce(b.text, '')) AS t FROM blocks WHERE len(b.bbox) = 4),
c AS (SELECT *, CASE WHEN w * h < 15000 THEN 1 WHEN {_has('t', Q.FORM_HINTS)} THEN 2 WHEN regexp_matches(t, '[0-9]') AND NOT contains(t, ':') AND w > h THEN 3 WHEN contains(t, ':') THEN 4 ELSE 5 END AS k FROM s)
SELECT record_id, page_pos, block_pos, ['noise', 'form', 'report', 'printed', 'unknown'][k] AS label, [0.65, 0.78, 0.72, 0.70, 0.55][k]::DOUBLE AS confidence FROM c""",
    "review_flags": f"WITH {_PAGES} SELECT record_id, page_pos, coalesce(p.page_type IN ('unknown', 'error'), false) OR coalesce(len(list_filter(p.blocks, lambda b: b.needs_review)) > 0, false) AS needs_review, coalesce(len(list_filter(p.blocks, lambda b: b.needs_review)), 0)::INT AS flagged FROM pgs",
    "doc_summary": f"""WITH {_PAGES}, {_BLOCKS}, r AS (SELECT DISTINCT record_id FROM document_payloads),
a AS (SELECT record_id, count(*) AS total_pages, count(*) FILTER (p.page_type = 'copyable_pdf') AS copyable_pdf, count(*) FILTER (p.page_type = 'mixed_pdf') AS mixed_pdf, count(*) FILTER (p.page_type = 'handwritten_prescription') AS handwritten_prescription, count(*) FILTER (p.page_type = 'fully_scanned_report_form_table') AS fully_scanned_report_form_table FROM pgs GROUP BY record_id),
b AS (SELECT record_id, count(*) AS total_blocks, count(*) FILTER (b.type = 'table') AS tables, count(*) FILTER (b.type = 'form') AS forms, count(*) FILTER (b.type = 'prescription_item') AS prescriptions, count(*) FILTER (b.needs_review) AS flagged FROM blocks GROUP BY record_id)
SELECT record_id, coalesce(total_pages, 0) AS total_pages, coalesce(copyable_pdf, 0) AS copyable_pdf, coalesce(mixed_pdf, 0) AS mixed_pdf, coalesce(handwritten_prescription, 0) AS handwritten_prescription, coalesce(fully_scanned_report_form_table, 0) AS fully_scanned_report_form_table, coalesce(total_blocks, 0) AS total_blocks, coalesce(tables, 0) AS tables, coalesce(forms, 0) AS forms, coalesce(prescriptions, 0) AS prescriptions, coalesce(flagged, 0) AS flagged FROM r LEFT JOIN a USING (record_id) LEFT JOIN b USING (record_id)""",
    "usage_totals": "SELECT event_type, count(*) AS requests, round(sum(value), 4) AS total, round(sum(value * 0.002::DOUBLE), 4) AS cost FROM events GROUP BY event_type",
    "bbox_ops": f"""WITH {_BLOCKS}, s AS (SELECT record_id, page_pos, block_pos, b.bbox AS x FROM blocks WHERE len(b.bbox) = 4), r AS (SELECT *, [x[1] * 1000 / {W}, x[2] * 1000 / {H}, x[3] * 1000 / {W}, x[4] * 1000 / {H}] AS k FROM s),
o AS (SELECT record_id, page_pos, block_pos, list_transform(k, lambda v: greatest(0, least(1000, floor(v)))::INT) AS thousand, list_transform([greatest(0, least(x[1], 300)), greatest(0, least(x[2], 400)), greatest(0, least(x[3], 300)), greatest(0, least(x[4], 400))], lambda v: round(v, 3)) AS clipped,
list_transform([greatest(0, least(x[1] - 10, {W})), greatest(0, least(x[2] - 10, {H})), greatest(0, least(x[3] + 10, {W})), greatest(0, least(x[4] + 10, {H}))], lambda v: round(v, 3)) AS padded, list_transform([x[1] + 5, x[2] - 5, x[3] + 5, x[4] - 5], lambda v: round(v, 3)) AS shifted,
list_transform([x[1], {H} - x[4], x[3], {H} - x[2]], lambda v: round(v, 3)) AS flipped, list_transform(x, lambda v: round(v * (150 / 72::DOUBLE), 3)) AS pixels, list_transform([least(x[1], 0), least(x[2], 0), greatest(x[3], 50), greatest(x[4], 50)], lambda v: round(v, 3)) AS united FROM r) SELECT record_id, page_pos, block_pos, """ + ", ".join(f"{n}[{i + 1}] AS {n}_{i}" for n in ("thousand", "clipped", "padded", "shifted", "flipped", "pixels", "united") for i in range(4)) + " FROM o",
    "neighbour_overlap": f"""WITH {_BLOCKS}, s AS (SELECT record_id, page_pos, block_pos, b.bbox AS a, lead(b.bbox) OVER (PARTITION BY record_id, page_pos ORDER BY block_pos) AS n FROM blocks),
r AS (SELECT *, greatest(least(a[3], n[3]) - greatest(a[1], n[1]), 0) AS iw, greatest(least(a[4], n[4]) - greatest(a[2], n[2]), 0) AS ih, greatest(a[3] - a[1], 0) AS w, greatest(a[4] - a[2], 0) AS h, greatest(n[3] - n[1], 0) AS nw FROM s WHERE len(a) = 4 AND len(n) = 4)
SELECT record_id, page_pos, block_pos, round(CASE WHEN least(w, nw) > 0 THEN iw / least(w, nw) ELSE 0 END, 6) AS x_overlap, round(CASE WHEN w * h > 0 THEN iw * ih / (w * h) ELSE 0 END, 6) AS covered FROM r""",
    "block_order": f"WITH {_BLOCKS} SELECT record_id, page_pos, block_pos, row_number() OVER (PARTITION BY record_id, page_pos ORDER BY coalesce(b.metadata.reading_order, 1000000000), {_Y}, {_X}, block_pos)::INT AS ord FROM blocks",
    "region_order": f"""WITH {_BLOCKS}, m AS (SELECT *, max(b.bbox[4]) OVER (PARTITION BY record_id, page_pos) AS pb FROM blocks),
r AS (SELECT *, coalesce(lower(b.metadata.region), CASE WHEN b.bbox[4] <= 0.14::DOUBLE * pb THEN 'header' WHEN b.bbox[2] >= 0.94::DOUBLE * pb THEN 'footer' END, lower(b.metadata.layout_label), lower(b.type), 'other') AS region FROM m),
p AS (SELECT *, CASE WHEN region IN ('title', 'header') THEN 0 WHEN region IN ('table', 'form') THEN 2 WHEN region = 'footer' THEN 3 ELSE 1 END AS priority FROM r)
SELECT record_id, page_pos, block_pos, region, priority, row_number() OVER (PARTITION BY record_id, page_pos ORDER BY priority, {_Y}, {_X}, block_pos)::INT AS ord FROM p""",
    "right_side_values": f"""WITH {_BLOCKS}, o AS (SELECT record_id, page_pos, block_pos, b.type AS type, b.bbox AS x, row_number() OVER (PARTITION BY record_id, page_pos ORDER BY coalesce(b.metadata.reading_order, 1000000000), {_Y}, {_X}, block_pos) AS ord,
 len(list_filter(string_split(coalesce(b.text, ''), chr(10)), lambda l: lower(regexp_extract(regexp_replace(regexp_replace(l, '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g'), '^([A-Za-z][A-Za-z /_\\-]{{0,40}}?) ?:?$', 1)) IN ('date', 'patient name', 'name', 'address', 'dob', 'date of birth', 'allergies', 'allergy', 'weight', 'mrn', 'patient id', 'id', 'rx', 'prescription'))) AS labels FROM blocks)
SELECT l.record_id, l.page_pos, l.block_pos AS label_pos, v.block_pos FROM o l JOIN o v USING (record_id, page_pos) WHERE l.labels >= 2 AND len(l.x) = 4 AND len(v.x) = 4 AND v.type IN ('paragraph', 'form') AND v.ord > l.ord AND v.x[1] > l.x[3] - 8 AND v.x[2] >= l.x[2] - 18 AND v.x[2] <= l.x[4] + greatest(120, 0.75::DOUBLE * greatest(l.x[4] - l.x[2], 0))""",
    "best_layout": f"""WITH {_BLOCKS}, q(box_no, label, y) AS (VALUES (0, 'Header', [0.0, 0.0, 306.0, 200.0]::DOUBLE[]), (1, 'Paragraph', [306.0, 0.0, 612.0, 200.0]::DOUBLE[]), (2, 'Table', [0.0, 200.0, 306.0, 792.0]::DOUBLE[]), (3, 'Form', [306.0, 200.0, 612.0, 792.0]::DOUBLE[])),
m AS (SELECT record_id, page_pos, block_pos, box_no, label, CASE WHEN greatest(x[3] - x[1], 0) * greatest(x[4] - x[2], 0) > 0 THEN greatest(least(x[3], y[3]) - greatest(x[1], y[1]), 0) * greatest(least(x[4], y[4]) - greatest(x[2], y[2]), 0) / (greatest(x[3] - x[1], 0) * greatest(x[4] - x[2], 0)) ELSE 0 END AS share FROM (SELECT *, b.bbox AS x FROM blocks), q WHERE len(x) = 4),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, page_pos, block_pos ORDER BY share DESC, box_no) AS n FROM m WHERE share > 0.15) WHERE n = 1)
SELECT b.record_id, b.page_pos, b.block_pos, box_no, label, round(share, 6) AS share FROM blocks b LEFT JOIN t USING (record_id, page_pos, block_pos)""",
    "span_groups": """WITH g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events))
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n, round(avg(value), 5) AS mean_value FROM g GROUP BY ALL""",
}
