"""Queries over texts: quality, tokens, sections, chunk packing and the helpers of forms and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirelake.functions import text as T
from quirelake.functions.staging import late_filter
from quirelake.operators.sequence import with_previous
from quirelake.session import balanced
from quirelake.sources import block_texts, read_table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of the payloads' blocks."""
    b = block_texts(read_table(spark, sf_dir, "document_payloads"))
    return b.select(F.explode(F.split("text", "\n")).alias("line")).distinct()


def text_quality(spark, sf_dir):
    q = T.with_quality(_docs(spark, sf_dir), "text")
    return q.select("doc_id", "char_count", "word_count", *[F.round(c, 4).alias(c) for c in ("alpha_ratio", "weird_ratio", "duplicate_ratio")], "quality")


def ws_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.squeeze(F.col("text")).alias("one_line"), T.squeeze_lines(F.col("text")).alias("per_line"))


def token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", T.token_count(F.col("text")).alias("tokens"), F.size(T.search_terms(F.col("text"))).alias("terms"))


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl): one row per document and term."""
    terms = docs.where("text IS NOT NULL").select("doc_id", T.search_terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    return terms.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def term_stats(spark, sf_dir):
    return postings(_docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(spark, sf_dir):
    terms = _docs(spark, sf_dir).where("text IS NOT NULL").select(F.size(T.search_terms(F.col("text"))).alias("n")).where("n > 0")
    return terms.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms"), F.avg("n").alias("avgdl"))


def sentence_units(spark, sf_dir):
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.posexplode(T.units_of(F.col("text"))).alias("unit_no", "unit"))


def long_split(spark, sf_dir):
    return _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.posexplode(T.cut_long(F.col("text"), 60)).alias("part_no", "part"))


def token_pack(spark, sf_dir):
    """Narrative chunks: units, long units cut, packed to 220 tokens with 40 repeated; numbered ids."""
    units = F.flatten(F.transform(T.units_of(F.col("text")), lambda u: T.cut_long(u, 320)))
    packs = _docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.posexplode(T.pack_units(units)).alias("chunk_no", "units"))
    return packs.select(F.format_string("%d:chunk:%04d", "doc_id", "chunk_no").alias("chunk_id"), "doc_id", "chunk_no", F.array_join("units", " ").alias("chunk_text"))


def sections(spark, sf_dir):
    s = _lines(spark, sf_dir).select("line", T.section(F.col("line")).alias("s"))
    return late_filter(s, F.col("s").isNotNull()).select("line", "s.section", "s.body", "s.only")


def section_prefix(spark, sf_dir):
    c = read_table(spark, sf_dir, "medical_document_chunks").where("chunk_text IS NOT NULL").select("chunk_text", "section").distinct()
    return c.select("chunk_text", "section", T.with_section(F.col("chunk_text"), F.col("section")).alias("prefixed"))


def form_labels(spark, sf_dir):
    return _lines(spark, sf_dir).select("line", T.label_key(F.col("line")).alias("label")).where("label IS NOT NULL")


def label_values(spark, sf_dir):
    """Lines 'Label: value' of known labels, and whether the value fits the label."""
    kv = _lines(spark, sf_dir).select("line", F.regexp_extract("line", r"^([A-Za-z ]+?) ?[:\-] (.*)$", 1).alias("k"), F.regexp_extract("line", r"^([A-Za-z ]+?) ?[:\-] (.*)$", 2).alias("v")).where("k <> '' AND v <> ''")
    keyed = kv.select("line", T.label_key(F.col("k")).alias("label"), T.squeeze(F.col("v")).alias("value")).where("label IS NOT NULL")
    return keyed.select("line", "label", "value", T.fits_label(F.col("label"), F.col("value")).alias("fits"))


def order_lines(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).select("line", T.starts_order(line).alias("starts"), T.continues_order(line).alias("continues"), T.boilerplate(line).alias("boilerplate"))


def safe_names(spark, sf_dir):
    p = read_table(spark, sf_dir, "document_payloads").select("input_file").distinct()
    return p.select("input_file", T.safe_file_name(F.col("input_file")).alias("safe_name"), F.regexp_replace("input_file", r"\.[A-Za-z0-9]+$", "_rag.txt").alias("rag_name"), F.regexp_replace("input_file", r"\.[A-Za-z0-9]+$", "_chunks.json").alias("chunk_name"))


def folded_texts(spark, sf_dir):
    e = read_table(spark, sf_dir, "evaluation_texts").where("ground_truth_text IS NOT NULL").select("document_id", "ground_truth_text").distinct()
    t = e.select("document_id", T.folded(F.col("ground_truth_text")).alias("folded"))
    words = F.split("folded", " ")
    return t.select("document_id", "folded", F.size(T.ngrams(words, 2)).alias("bigrams"), F.size(T.ngrams(words, 3)).alias("trigrams"), T.length_confidence(F.col("folded")).alias("confidence"))


def fts_terms(spark, sf_dir):
    """Query terms of the keyword index: blank-separated, letters and digits only, quoted and joined by OR."""
    q = read_table(spark, sf_dir, "retrieval_queries").where("query_text IS NOT NULL").select("query_id", "query_text").distinct()
    terms = F.filter(F.transform(F.split(T.squeeze(F.col("query_text")), " "), lambda x: F.regexp_replace(x, "[^A-Za-z0-9]", "")), lambda x: x != "")
    return q.select("query_id", F.array_join(F.transform(terms, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR ").alias("fts_query"))


def layout_labels(spark, sf_dir):
    b = block_texts(read_table(spark, sf_dir, "document_payloads"), "metadata")
    l = b.select("metadata.layout_label").distinct()
    return l.select("layout_label", T.layout_label(F.col("layout_label")).alias("normal"), T.field_key(F.col("layout_label")).alias("key"))


def doc_context(spark, sf_dir):
    """Context from ids built of customer and supplier keys."""
    c, s = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "supplier")
    joined = c.join(s, F.col("c_custkey") % 100 == F.col("s_suppkey")).select(F.concat(F.lit("Ann_C"), "c_custkey", F.lit("-Bo_S"), "s_suppkey", F.lit("-North_Clinic-"), F.when(F.col("c_custkey") % 3 == 0, "East-").otherwise(""), F.lit("MRN"), "c_custkey").alias("document_id"))
    return joined.select("document_id", T.document_context(F.col("document_id")).alias("c")).select("document_id", "c.*")


def consecutive_dedup(spark, sf_dir):
    """Events of a user in order, without those of the same type as the one before."""
    e = read_table(spark, sf_dir, "events")
    return with_previous(e, "user_id", ["ts", "event_id"], "event_type", F.to_date("ts"), "p").where("p IS NULL OR p <> event_type").select("event_id", "user_id", "event_type")


QUERIES = {f.__name__: f for f in (text_quality, ws_normalize, token_counts, term_stats, corpus_stats, sentence_units, long_split, token_pack, sections, section_prefix, form_labels, label_values, order_lines, safe_names, folded_texts, fts_terms, layout_labels, doc_context, consecutive_dedup)}

_WS = r" \t\n\r\f\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LB = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def _sq(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g')"


_LINES_SQL = """lines AS (SELECT DISTINCT unnest(string_split(b.text, chr(10))) AS line FROM (
  SELECT unnest(p.blocks) AS b FROM (SELECT unnest(pages) AS p FROM document_payloads)) WHERE b.text IS NOT NULL)"""
_UNITS = f"""units AS (SELECT doc_id, CASE WHEN len(rows) > 1 AND len(list_filter(rows, lambda x: len(string_split(x, ' ')) >= 4)) > 0 THEN rows
  ELSE list_filter(string_split(regexp_replace({_sq('text')}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') END AS u
  FROM (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '{_LB}'), lambda x: {_sq('x')}), lambda x: x <> '') AS rows FROM documents WHERE text IS NOT NULL))"""
_LABEL_CASE = "CASE lower({x}) WHEN 'date' THEN 'date' WHEN 'patient name' THEN 'name' WHEN 'name' THEN 'name' WHEN 'address' THEN 'address' WHEN 'dob' THEN 'dob' WHEN 'date of birth' THEN 'dob' WHEN 'allergies' THEN 'allergies' WHEN 'allergy' THEN 'allergies' WHEN 'weight' THEN 'weight' WHEN 'mrn' THEN 'mrn' WHEN 'patient id' THEN 'patient_id' WHEN 'id' THEN 'patient_id' WHEN 'rx' THEN 'rx' WHEN 'prescription' THEN 'rx' END"
_CONT = r"(?i)^[\-–— ]*(?:please take|take|dispense|refills?|schedule|monitor|watch|follow-up|continue|instructions?)([^A-Za-z]|$)"
_BOIL = r"(?i)^(?:rx|medication and instructions|patient instructions|hello|prescribing physician|signature|date ?[:\-]? ?\d{4}-\d{2}-\d{2}|page \d+|\[your name\]|sincerely|kind regards)"
_NAMES = "history|chief complaint|complaints|findings|impression|plan|assessment|diagnosis|prescribed medications|prescribed medication|medications|medication|prescription|labs|lab|investigations|investigation|advice|patient instructions|patient instruction|instructions|instruction|follow-up|follow up|discharge summary"
_HEAD = rf"(?is)^[ \t\n\r]*({'|'.join(sorted(_NAMES.split('|'), key=len, reverse=True))})[ \t]*(?:\([^)\n]*\))?[ \t]*(?:[:\-]+|\r?\n|\r?\z)(.*)\z"
SQL = {
    "text_quality": rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS t FROM documents),
m AS (SELECT doc_id, t, length(t) AS n, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_/%.\-]+')) AS w,
 (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g'))) / greatest(length(t), 1)::DOUBLE AS a,
 (length(t) - length(regexp_replace(t, '[^\p{{L}}\p{{N}}{_WS}.,:;\-/()%]', '', 'g'))) / greatest(length(t), 1)::DOUBLE AS x,
 list_filter(list_transform(string_split_regex(t, '{_LB}'), lambda l: regexp_replace(l, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda l: l <> '') AS l FROM t),
d AS (SELECT *, CASE WHEN len(l) > 0 THEN 1 - len(list_distinct(l)) / len(l)::DOUBLE ELSE 0.0 END AS dup FROM m)
SELECT doc_id, n::INT AS char_count, w::INT AS word_count, round(a, 4) AS alpha_ratio, round(x, 4) AS weird_ratio, round(dup, 4) AS duplicate_ratio,
CASE WHEN t = '' THEN 'empty' WHEN (n >= 100 OR w >= 6) AND a >= 0.45 AND x <= 0.25 AND dup <= 0.40 THEN 'good' ELSE 'poor' END AS quality FROM d""",
    "ws_normalize": f"SELECT doc_id, {_sq('text')} AS one_line, array_to_string(list_filter(list_transform(string_split_regex(text, '{_LB}'), lambda x: {_sq('x')}), lambda x: x <> ''), chr(10)) AS per_line FROM documents WHERE text IS NOT NULL",
    "token_counts": f"SELECT doc_id, len(regexp_extract_all(text, '[^{_WS}]+'))::INT AS tokens, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::INT AS terms FROM documents WHERE text IS NOT NULL",
    "term_stats": "SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, lower(t) AS term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS t FROM documents) GROUP BY ALL) GROUP BY term",
    "corpus_stats": "SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms, avg(n) AS avgdl FROM (SELECT len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0",
    "sentence_units": f"WITH {_UNITS} SELECT doc_id, unnest(range(len(u)::BIGINT))::INT AS unit_no, unnest(u) AS unit FROM units",
    "long_split": f"""WITH t AS (SELECT doc_id, list_filter(string_split({_sq('text')}, ' '), lambda x: x <> '') AS k FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, k, unnest(range(greatest(ceil(len(k) / 60.0), 1)::BIGINT)) AS i FROM t) SELECT doc_id, i::INT AS part_no, array_to_string(k[i * 60 + 1 : i * 60 + 60], ' ') AS part FROM p""",
    "sections": f"""WITH {_LINES_SQL}, m AS (SELECT line, regexp_extract(line, '{_HEAD}', 1) AS h, regexp_replace(regexp_extract(line, '{_HEAD}', 2), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS body FROM lines)
SELECT line, CASE lower(h) WHEN 'medication' THEN 'medications' WHEN 'lab' THEN 'labs' WHEN 'prescribed medications' THEN 'prescription' WHEN 'prescribed medication' THEN 'prescription' WHEN 'patient instructions' THEN 'instructions' WHEN 'patient instruction' THEN 'instructions' WHEN 'instruction' THEN 'instructions' WHEN 'follow-up' THEN 'follow up' ELSE lower(h) END AS section, body, body = '' AS only FROM m WHERE h <> ''""",
    "form_labels": f"WITH {_LINES_SQL}, s AS (SELECT line, regexp_extract({_sq('line')}, '^([A-Za-z][A-Za-z /_\\-]{{0,40}}?) ?:?$', 1) AS k FROM lines) SELECT line, {_LABEL_CASE.format(x='k')} AS label FROM s WHERE {_LABEL_CASE.format(x='k')} IS NOT NULL",
    "order_lines": f"""WITH {_LINES_SQL}, m AS (SELECT line, regexp_matches(line, '{_CONT}') AS c, regexp_matches({_sq('line')}, '{_BOIL}') AS b FROM lines)
SELECT line, regexp_matches(line, '(?i)\\d ?mg([^A-Za-z]|$)|(^|[^A-Za-z])(?:tablets?|capsules?|therapy|cbt)([^A-Za-z]|$)') AND NOT b AND NOT c AS starts, c AS continues, b AS boilerplate FROM m""",
    "safe_names": r"""SELECT DISTINCT input_file, coalesce(nullif(regexp_replace(regexp_replace(input_file, '[^A-Za-z0-9._\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'upload.bin') AS safe_name,
regexp_replace(input_file, '\.[A-Za-z0-9]+$', '_rag.txt') AS rag_name, regexp_replace(input_file, '\.[A-Za-z0-9]+$', '_chunks.json') AS chunk_name FROM document_payloads""",
    "folded_texts": rf"""WITH e AS (SELECT DISTINCT document_id, ground_truth_text FROM evaluation_texts WHERE ground_truth_text IS NOT NULL),
f AS (SELECT document_id, {_sq("regexp_replace(lower(ground_truth_text), '[^\\p{L}\\p{N}_" + _WS + "]', ' ', 'g')")} AS folded FROM e), w AS (SELECT *, string_split(folded, ' ') AS w FROM f)
SELECT document_id, folded, CASE WHEN len(w) < 2 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(w)::BIGINT), lambda i: w[i] || ' ' || w[i + 1]))) END::INT AS bigrams,
CASE WHEN len(w) < 3 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(w)::BIGINT - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END::INT AS trigrams,
CASE WHEN folded = '' THEN 0.65 WHEN len(w) >= 20 THEN 0.85 WHEN len(w) >= 8 THEN 0.75 ELSE 0.65 END::DOUBLE AS confidence FROM w""",
    "fts_terms": f"""SELECT DISTINCT query_id, array_to_string(list_transform(list_filter(list_transform(string_split({_sq('query_text')}, ' '), lambda x: regexp_replace(x, '[^A-Za-z0-9]', '', 'g')), lambda x: x <> ''), lambda x: '"' || x || '"'), ' OR ') AS fts_query FROM (SELECT DISTINCT query_id, query_text FROM retrieval_queries WHERE query_text IS NOT NULL)""",
    "layout_labels": """SELECT DISTINCT b.metadata.layout_label AS layout_label, CASE lower(trim(b.metadata.layout_label)) WHEN 'table' THEN 'Table' WHEN 'header' THEN 'Header' WHEN 'footer' THEN 'Footer' WHEN 'figure' THEN 'Figure' WHEN 'image' THEN 'Figure' WHEN 'form' THEN 'Form' WHEN 'title' THEN 'Header' WHEN 'text' THEN 'Paragraph' WHEN 'paragraph' THEN 'Paragraph' WHEN 'list' THEN 'Paragraph' ELSE 'Other' END AS normal,
regexp_replace(regexp_replace(lower(b.metadata.layout_label), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM (SELECT unnest(p.blocks) AS b FROM (SELECT unnest(pages) AS p FROM document_payloads)) WHERE b.text IS NOT NULL""",
    "doc_context": """SELECT 'Ann_C' || c_custkey || '-Bo_S' || s_suppkey || '-North_Clinic-' || CASE WHEN c_custkey % 3 = 0 THEN 'East-' ELSE '' END || 'MRN' || c_custkey AS document_id, 'Ann C' || c_custkey AS patient, 'Dr. Bo S' || s_suppkey AS doctor, 'North Clinic' || CASE WHEN c_custkey % 3 = 0 THEN ' East' ELSE '' END AS hospital, 'MRN' || c_custkey AS mrn FROM customer JOIN supplier ON c_custkey % 100 = s_suppkey""",
    "consecutive_dedup": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type",
    "token_pack": f"""WITH RECURSIVE {_UNITS},
cut AS (SELECT doc_id, flatten(list_transform(u, lambda x: list_transform(range(greatest(ceil(len(string_split(x, ' ')) / 320.0), 1)::BIGINT), lambda i: array_to_string(string_split(x, ' ')[i * 320 + 1 : i * 320 + 320], ' ')))) AS u FROM units),
nums AS (SELECT doc_id, u, list_transform(u, lambda x: len(string_split(x, ' '))) AS n FROM cut WHERE len(u) > 0),
r AS (SELECT doc_id, u, n, 1 AS lo, 1 AS hi, n[1] AS total, 0 AS chunk_no, false AS done FROM nums
UNION ALL SELECT doc_id, u, n, CASE WHEN grow THEN lo ELSE back END, hi + 1, CASE WHEN grow THEN total + n[hi + 1] ELSE coalesce(list_sum(n[back : hi]), 0)::BIGINT + n[hi + 1] END, CASE WHEN grow THEN chunk_no ELSE chunk_no + 1 END, false
FROM (SELECT *, total + n[hi + 1] <= 220 AS grow, hi + 1 - coalesce(list_max(list_filter(range(1, (hi - lo + 2)::BIGINT), lambda k: list_sum(n[hi - k + 1 : hi]) <= 40)), 0) AS back FROM r WHERE hi < len(n))),
last AS (SELECT doc_id, chunk_no, u, lo, max(hi) AS hi FROM r GROUP BY ALL)
SELECT doc_id || ':chunk:' || lpad(chunk_no::VARCHAR, 4, '0') AS chunk_id, doc_id, chunk_no, array_to_string(u[lo : hi], ' ') AS chunk_text FROM last""",
    "section_prefix": """SELECT DISTINCT chunk_text, section, CASE WHEN section IS NULL OR section = '' THEN chunk_text WHEN starts_with(lower(chunk_text), lower(section)) THEN chunk_text ELSE array_to_string(list_transform(string_split(section, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ': ' || chunk_text END AS prefixed FROM medical_document_chunks WHERE chunk_text IS NOT NULL""",
    "label_values": rf"""WITH {_LINES_SQL}, kv AS (SELECT line, regexp_extract(line, '^([A-Za-z ]+?) ?[:\-] (.*)$', 1) AS k, {_sq("regexp_extract(line, '^([A-Za-z ]+?) ?[:\\-] (.*)$', 2)")} AS v, regexp_extract(line, '^([A-Za-z ]+?) ?[:\-] (.*)$', 2) AS raw FROM lines),
l AS (SELECT line, {_LABEL_CASE.format(x=_sq('k'))} AS label, v AS value, len(string_split(v, ' ')) AS w, regexp_matches(v, '(?i)\d{{1,4}}[/.\-]\d{{1,2}}[/.\-]\d{{1,4}}|^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)') AS dated FROM kv WHERE k <> '' AND raw <> '')
SELECT line, label, value, CASE label WHEN 'name' THEN regexp_matches(value, '^[\p{{L}} .''\-]+$') AND w >= 2
WHEN 'address' THEN NOT dated AND (regexp_matches(value, '(?i)(^|[^a-z])(street|st|road|rd|avenue|ave|lane|drive|court|row|way|close)([^a-z]|$)|,') OR (regexp_matches(value, '[0-9]') AND w >= 3))
WHEN 'dob' THEN dated WHEN 'date' THEN dated WHEN 'allergies' THEN regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '[0-9]')
WHEN 'weight' THEN regexp_matches(value, '(?i)\d+(?:\.\d+)? ?(?:kgs?|lbs?)([^a-z]|$)') WHEN 'mrn' THEN regexp_matches(value, '[0-9]') WHEN 'patient_id' THEN regexp_matches(value, '[0-9]')
ELSE regexp_matches(value, '(?i)\d ?(?:mg|mcg|ml)([^A-Za-z]|$)|tablet|capsule|(^|[^A-Za-z])(?:tab|cap|inj|syp)([^A-Za-z]|$)') END AS fits FROM l WHERE label IS NOT NULL""",
}
