"""Queries of medication, laboratory, entity, form and table extraction over the payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quirelake.functions.staging import late_filter
from quirelake.operators import extract as E
from quirelake.session import spread
from quirelake.sources import block_texts, read_table


def _blocks(spark, sf_dir) -> DataFrame:
    """One row per block of each record, repeated rows of a record once: record_id, page_pos, block_pos, block."""
    p = spread(read_table(spark, sf_dir, "document_payloads").select("record_id", "pages"), "record_id").dropDuplicates(["record_id"])
    pages = p.select("record_id", F.posexplode("pages").alias("page_pos", "page"))
    return pages.select("record_id", "page_pos", "page.page_number", "page.page_type", F.posexplode("page.blocks").alias("block_pos", "block")).where("block IS NOT NULL")


def _rx_lines(spark, sf_dir) -> DataFrame:
    b = block_texts(read_table(spark, sf_dir, "document_payloads"), "type", "confidence")
    lines = b.where("type = 'prescription_item' OR type = 'paragraph'").select(F.explode(F.split("text", "\n")).alias("line"), F.col("confidence"))
    return spread(lines.groupBy("line").agg(F.max("confidence").alias("confidence")), "line")


def med_lines(spark, sf_dir):
    l = E.with_signals(_rx_lines(spark, sf_dir).select("line", E.clean_line(F.col("line")).alias("text")), "text")
    return l.select("line", "text", "footer", "explicit", "narrative", "score", "prescription")


def med_parse(spark, sf_dir):
    return E.medications(_rx_lines(spark, sf_dir)).select("line", "medication", "dose", "route", "frequency", "duration", "form", "instructions", "needs_review")


def lab_parse(spark, sf_dir):
    b = block_texts(read_table(spark, sf_dir, "document_payloads")).select("text").distinct()
    return E.labs(b.select("text", F.col("text").alias("block_text")), "text").select("block_text", "lab_no", "test_name", "value", "unit")


def ner_dictionary(spark, sf_dir):
    c = read_table(spark, sf_dir, "medical_document_chunks").where("chunk_text IS NOT NULL").select("chunk_id", "chunk_text").distinct()
    return c.select("chunk_id", F.explode(E.entities(F.col("chunk_text"))).alias("e")).select("chunk_id", "e.text", "e.type").distinct()


def form_fallback(spark, sf_dir):
    b = block_texts(read_table(spark, sf_dir, "document_payloads"), "type").where("type = 'form'").select("text").distinct()
    return b.select("text", F.explode(E.form_fields(F.col("text"))).alias("f")).select("text", "f.key", "f.value")


def text_blocks(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(E.paragraphs(F.col("text"))).alias("block_no", "block_text"))


def table_rows(spark, sf_dir):
    return E.table_chunks(_blocks(spark, sf_dir))


def table_summary(spark, sf_dir):
    """Tables of two rows and more as one text."""
    r = E.table_chunks(_blocks(spark, sf_dir)).groupBy("record_id", "page_pos", "block_pos").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct("row_pos", "chunk_text"))).alias("r"))
    return r.where("rows >= 2").select("record_id", "page_pos", "block_pos", "rows", F.array_join(F.transform("r", lambda x: x["chunk_text"]), "\n").alias("summary"))


def render_text(spark, sf_dir):
    """The search text of every record: blocks in reading order, rendered, neighbours of equal text once."""
    order = [F.coalesce("page_number", F.lit(10**9)), "page_pos", F.coalesce("block.metadata.reading_order", F.lit(10**9)), F.coalesce(F.get("block.bbox", F.lit(1)), F.lit(1e9)), F.coalesce(F.get("block.bbox", F.lit(0)), F.lit(1e9)), "block_pos"]
    b = late_filter(_blocks(spark, sf_dir).withColumn("t", E.render_block(F.col("block"))), F.col("t") != "")
    n = b.withColumn("ord", F.row_number().over(Window.partitionBy("record_id").orderBy(*order)))
    kept = n.withColumn("p", F.lag("t").over(Window.partitionBy("record_id").orderBy("ord"))).where("p IS NULL OR p <> t")
    out = kept.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("r"))
    return out.select("record_id", F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("rag_text"))


QUERIES = {f.__name__: f for f in (med_lines, med_parse, lab_parse, ner_dictionary, form_fallback, text_blocks, table_rows, table_summary, render_text)}

_WS = r" \t\n\r\f\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _sq(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g')"


_N = "([^A-Za-z0-9_]|$)"
_P = "(^|[^A-Za-z0-9_])"
_BLOCKS = """pg AS (SELECT record_id, pages, unnest(range(1, len(pages) + 1)) AS i FROM (SELECT DISTINCT ON (record_id) record_id, pages FROM document_payloads)),
bl AS (SELECT record_id, i, pages[i] AS p, unnest(range(1, len(pages[i].blocks) + 1)) AS j FROM pg),
blocks AS (SELECT record_id, (i - 1)::INT AS page_pos, (j - 1)::INT AS block_pos, p.page_number, p.page_type, p.blocks[j] AS b FROM bl WHERE p.blocks[j] IS NOT NULL)"""
_FIX = "regexp_replace(coalesce(line, ''), 'x', 'x')"
for _a, _b in E.OCR_FIXES:
    _FIX = f"replace({_FIX}, '{_a}', '{_b}')"
_CLEAN = f"regexp_replace(regexp_replace({_FIX}, '(?i)</?math[^>]*>', ' ', 'g'), '[{{}}\\[\\]<>]+', ' ', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '{_P}([01Iil])\\s*-\\s*([01Iil])\\s*-\\s*([01Iil]){_N}', '\\1\\2-\\3-\\4\\5', 'g')"
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '{_P}[Iil]-([01Iil])-([01Iil]){_N}', '\\g<1>1-\\2-\\3\\4', 'g'), '{_P}([01])-[Iil]-([01Iil]){_N}', '\\1\\2-1-\\3\\4', 'g'), '{_P}([01])-([01])-[Iil]{_N}', '\\1\\2-\\3-1\\4', 'g')".replace("\\g<1>1", "\\11")
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '{_P}[xX]\\s*[Iil1]\\s*(days?|weeks?|months?){_N}', '\\1x 1 \\2\\3', 'g'), '(?i)(\\d)\\s*(days?|weeks?|months?){_N}', '\\1 \\2\\3', 'g')"
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '[\"`]+', '', 'g'), '[•·]+', ' ', 'g')"
_CLEAN = f"regexp_replace({_sq(_CLEAN)}, '^[ .,:;\\-]+|[ .,:;\\-]+$', '', 'g')"


def _has(col: str, markers) -> str:
    return "(" + " OR ".join(f"contains({col}, '{m}')" for m in markers) + ")"


_RX = f"""WITH l AS (SELECT line, max(confidence) AS confidence FROM (SELECT unnest(string_split(b.text, chr(10))) AS line, b.confidence AS confidence FROM (SELECT unnest(p.blocks) AS b FROM (SELECT unnest(pages) AS p FROM document_payloads)) WHERE b.type IN ('prescription_item', 'paragraph') AND b.text IS NOT NULL) GROUP BY line),
c AS (SELECT line, confidence, {_CLEAN} AS text FROM l),
s AS (SELECT *, lower(text) AS low, text = '' OR {_has('lower(text)', E.FOOTER)} AS footer, {_has('lower(text)', E.KNOWN)} AS known, regexp_matches(lower(text), '^(?:adv|rx)') AS starts, len(string_split(text, ' ')) AS w,
 regexp_matches(text, '{E.FORM}') AS fm, regexp_matches(text, '{E.DOSE}') AS ds, regexp_matches(text, '{E.FREQUENCY}') AS fq, regexp_matches(text, '{E.ROUTE}') AS rt, regexp_matches(text, '{E.INSTRUCTION}') AS ins, regexp_matches(text, '{E.DURATION}') AS du FROM c),
e AS (SELECT *, NOT footer AND (known OR fm OR ds OR fq OR rt OR starts OR (ins AND w <= 8)) AS explicit FROM s),
n AS (SELECT *, text = '' OR {_has('low', E.SIGNATURE)} OR {' OR '.join(f"starts_with(low, '{o}')" for o in E.OPENERS)} OR ({_has('low', E.NARRATIVE)} AND NOT explicit) OR (w >= 8 AND NOT explicit) AS narrative,
 (CASE WHEN fm THEN 3 ELSE 0 END + CASE WHEN ds THEN 3 ELSE 0 END + CASE WHEN fq THEN 2 ELSE 0 END + CASE WHEN du THEN 1 ELSE 0 END + CASE WHEN starts THEN 2 ELSE 0 END + CASE WHEN known THEN 4 ELSE 0 END) AS score FROM e),
r AS (SELECT *, NOT footer AND NOT narrative AND score >= 3 AS prescription FROM n)"""
_KNOWN_CASE = "CASE " + " ".join(f"WHEN contains(low, '{k}') THEN '{' '.join(x.capitalize() for x in k.split())}'" for k in sorted(E.KNOWN, key=lambda x: (-len(x), [-ord(c) for c in x]))) + " END"
_HEADW = f"""list_filter(regexp_extract_all(string_split_regex(regexp_replace(regexp_replace(regexp_replace(text, '(?i)^\\s*adv[:\\-]?\\s*', ''), '(?i)^\\s*(?:before|after|with)\\s+meals?{_N}', '\\1'), '{E.FORM}', ''), '{E.STOP_AT}')[1], '[A-Za-z][A-Za-z0-9-]*'), lambda x: lower(x) NOT IN ('before', 'after', 'with', 'meals', 'meal', 'tab', 'cap', 'syp', 'adv', 'rx'))"""
_VALUES = ", ".join(f"('{w}', '{k}')" for k, ws in sorted(E.VOCABULARY.items()) for w in sorted(ws))
SQL = {
    "med_lines": _RX + " SELECT line, text, footer, explicit, narrative, score, prescription FROM r",
    "med_parse": _RX + f""", m AS (SELECT *, {_KNOWN_CASE} AS kn, {_HEADW} AS hw FROM r WHERE prescription),
x AS (SELECT *, coalesce(kn, CASE WHEN explicit AND len(hw) > 0 THEN array_to_string(list_transform(hw[1:3], lambda x: upper(x[1]) || lower(x[2:])), ' ') END) AS medication, nullif(regexp_extract(text, '{E.DOSE}', 2), '') AS dose FROM m)
SELECT line, medication, dose, nullif(regexp_extract(text, '{E.ROUTE}', 2), '') AS route, nullif(regexp_extract(text, '{E.FREQUENCY}', 2), '') AS frequency, nullif(regexp_extract(text, '{E.DURATION}', 1), '') AS duration, nullif(regexp_extract(text, '{E.FORM}', 1), '') AS form, nullif(regexp_extract(text, '{E.INSTRUCTION}', 2), '') AS instructions, coalesce(confidence < 0.7, true) OR medication IS NULL OR dose IS NULL AS needs_review FROM x""",
    "lab_parse": f"""WITH t AS (SELECT DISTINCT b.text AS block_text FROM (SELECT unnest(p.blocks) AS b FROM (SELECT unnest(pages) AS p FROM document_payloads)) WHERE b.text IS NOT NULL),
m AS (SELECT block_text, regexp_extract_all(block_text, '{E.LAB}', 0) AS a FROM t), u AS (SELECT block_text, unnest(range(len(a)::BIGINT))::INT AS lab_no, unnest(a) AS x FROM m)
SELECT block_text, lab_no, regexp_extract(x, '{E.LAB}', 1) AS test_name, regexp_extract(x, '{E.LAB}', 2) AS value, nullif(regexp_extract(x, '{E.LAB}', 3), '') AS unit FROM u""",
    "ner_dictionary": f"SELECT DISTINCT chunk_id, v.w AS text, v.k AS type FROM medical_document_chunks, (VALUES {_VALUES}) v(w, k) WHERE regexp_matches(lower(chunk_text), '{_P}(?:' || v.w || '){_N}')",
    "form_fallback": f"""WITH t AS (SELECT DISTINCT b.text AS text FROM (SELECT unnest(p.blocks) AS b FROM (SELECT unnest(pages) AS p FROM document_payloads)) WHERE b.text IS NOT NULL AND b.type = 'form'),
l AS (SELECT text, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10)))::BIGINT)) AS i FROM t),
k AS (SELECT text, i, regexp_replace(regexp_replace(lower(regexp_extract(x, '^([^:]+):', 1)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, {_sq("regexp_extract(x, '^[^:]+:(.*)$', 1)")} AS value FROM l WHERE regexp_matches(x, '^[^:]+:'))
SELECT text, key, arg_max(value, i) AS value FROM k WHERE key <> '' GROUP BY text, key""",
    "text_blocks": f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n[ \\t\\r]*\\n'), lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda x: x <> '') AS p, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, CASE WHEN len(p) > 1 THEN p ELSE l END AS u FROM s) SELECT doc_id, unnest(range(len(u)::BIGINT))::INT AS block_no, unnest(u) AS block_text FROM c""",
    "table_rows": f"""WITH {_BLOCKS}, r AS (SELECT record_id, page_pos, block_pos, b.structured_data.columns AS c, b.structured_data.rows AS rs, unnest(range(1, len(b.structured_data.rows) + 1)) AS k FROM blocks WHERE b.type = 'table'),
x AS (SELECT record_id, page_pos, block_pos, (k - 1)::INT AS row_pos, coalesce(len(list_filter(c, lambda y: regexp_matches(y, '(?i)medication|drug|dosage|dose|frequency'))) > 0, false) AS medication_table, array_to_string(list_transform(list_filter(rs[k], lambda y: trim(coalesce(y.v, '')) <> ''), lambda y: y.k || ': ' || trim(y.v)), '; ') AS chunk_text FROM r)
SELECT * FROM x WHERE chunk_text <> ''""",
    "table_summary": f"""WITH {_BLOCKS}, r AS (SELECT record_id, page_pos, block_pos, b.structured_data.rows AS rs, unnest(range(1, len(b.structured_data.rows) + 1)) AS k FROM blocks WHERE b.type = 'table'),
x AS (SELECT record_id, page_pos, block_pos, k, array_to_string(list_transform(list_filter(rs[k], lambda y: trim(coalesce(y.v, '')) <> ''), lambda y: y.k || ': ' || trim(y.v)), '; ') AS t FROM r)
SELECT record_id, page_pos, block_pos, count(*) AS rows, string_agg(t, chr(10) ORDER BY k) AS summary FROM x WHERE t <> '' GROUP BY ALL HAVING count(*) >= 2""",
    "render_text": f"""WITH {_BLOCKS}, t AS (SELECT *, trim(coalesce(b.text, '')) AS plain, array_to_string(list_filter(list_transform(b.structured_data.rows, lambda r: array_to_string(list_filter(list_transform(r, lambda c: trim(coalesce(c.v, ''))), lambda v: v <> ''), ' | ')), lambda x: x <> ''), chr(10)) AS tab,
 array_to_string(list_transform(list_filter(list_sort(map_keys(b.fields)), lambda k: trim(coalesce(b.fields[k].value, '')) <> ''), lambda k: k || ': ' || trim(b.fields[k].value)), chr(10)) AS frm FROM blocks),
r AS (SELECT *, coalesce(CASE WHEN b.type = 'table' THEN nullif(tab, '') END, CASE WHEN b.type = 'form' THEN nullif(frm, '') END, plain) AS x FROM t),
o AS (SELECT record_id, x, row_number() OVER (PARTITION BY record_id ORDER BY coalesce(page_number, 1000000000), page_pos, coalesce(b.metadata.reading_order, 1000000000), coalesce(b.bbox[2], 1e9), coalesce(b.bbox[1], 1e9), block_pos) AS n FROM r WHERE x <> ''),
k AS (SELECT *, lag(x) OVER (PARTITION BY record_id ORDER BY n) AS p FROM o) SELECT record_id, string_agg(x, chr(10) || chr(10) ORDER BY n) AS rag_text FROM k WHERE p IS NULL OR p <> x GROUP BY record_id""",
}
