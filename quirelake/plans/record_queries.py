"""Queries of privacy, audit, evaluation, chunk building, registries and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quirelake.functions import text as T
from quirelake.operators import audit as A
from quirelake.operators import chunk as C
from quirelake.operators import evaluate as V
from quirelake.operators import privacy as P
from quirelake.operators import registry as R
from quirelake.plans.extract_queries import _BLOCKS, _blocks
from quirelake.plans.layout_queries import label_pairing
from quirelake.plans.retrieval_queries import _cands, _queries
from quirelake.sources import read_table
from quirelake.streaming import ingest

KEY = b"quirelake-query-key"


def hmac_identity(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", P.identity(F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")), KEY).alias("digest"))


def redact_text(spark, sf_dir):
    """Chunk texts with labelled personal data masked."""
    c = read_table(spark, sf_dir, "medical_document_chunks").where("chunk_text IS NOT NULL").select("chunk_id", "chunk_text").distinct()
    picked = c.withColumn("spans", P.pick_spans(P.find_spans(F.col("chunk_text"))))
    return picked.select("chunk_id", F.size("spans").alias("spans"), P.redact(F.col("chunk_text"), F.col("spans")).alias("redacted"))


def generalize_placeholders(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    text = F.concat(F.lit("[PATIENT_NAME] born [DATE_OF_BIRTH], call [PHONE] or [EMAIL]; "), F.when(F.col("c_custkey") % 3 == 0, "[MRN]").when(F.col("c_custkey") % 3 == 1, "[UHID]").otherwise("[IP_NUMBER]"), F.lit(" of "), "c_name")
    return c.select("c_custkey", P.generalise(text).alias("text"))


def context_mask(spark, sf_dir):
    """Candidates of every query as its role may see their ids."""
    c = _cands(spark, sf_dir).join(_queries(spark, sf_dir), "query_id")
    ok = P.authorised(F.col("role"))
    return c.select("query_id", "chunk_id", ok.alias("authorized"), F.when(ok, F.col("document_id")).otherwise(P.masked_document(F.col("document_id"), KEY)).alias("document_ref"), F.when(ok, F.col("chunk_id")).otherwise(F.substring_index("chunk_id", ":", -1)).alias("chunk_ref"))


def context_rows(spark, sf_dir):
    """Contexts with their masked texts."""
    return P.context(_cands(spark, sf_dir).join(_queries(spark, sf_dir), "query_id"))


def _log(spark, sf_dir) -> DataFrame:
    q = _queries(spark, sf_dir).join(read_table(spark, sf_dir, "retrieval_queries").groupBy("query_id").agg(F.max("asked_at").alias("ts")), "query_id")
    return A.entries(q.select(F.col("query_id").alias("audit_id"), "ts", F.lit(" api ").alias("actor_name"), F.col("role").alias("actor_role"), "query_text", F.col("scope").alias("document_id"), F.lit("OK").alias("status"), F.lit(None).cast("string").alias("error")))


def audit_log(spark, sf_dir):
    return _log(spark, sf_dir).select("accessed_at", "accessed_day", "audit_id", "actor_name", "actor_role", "authorized", "status", "document_count", "error_masked")


def audit_masked(spark, sf_dir):
    return _log(spark, sf_dir).select("audit_id", "query_masked", "query_hash", "document_hash")


def audit_page(spark, sf_dir):
    """The second page of 25 rows, newest first, behind a key."""
    return A.page(_log(spark, sf_dir), 25, A.cursor_of("2026-01-01T00:00:00.000000Z#")).select("accessed_at", "actor_role")


def audit_range(spark, sf_dir):
    log = _log(spark, sf_dir).where(A.in_range(F.col("accessed_day"), "2025-03-01", "2025-06-30"))
    return log.groupBy("accessed_day", "actor_role").agg(F.count("*").alias("accesses"), F.count_if("authorized").alias("authorized"))


def props_json(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    m = e.withColumn("m", R.read_map(F.col("props")))
    return m.select("event_id", F.expr("try_cast(m['k'] AS bigint)").alias("k"), R.sorted_json(F.map_concat("m", F.create_map(F.lit("a"), F.col("event_type")))).alias("json"))


def phrase_recall(spark, sf_dir):
    """Key phrases found in the payloads of each document."""
    truth = read_table(spark, sf_dir, "evaluation_texts").where("document_id IS NOT NULL").groupBy("document_id").agg(F.max("key_phrases").alias("key_phrases"))
    b = read_table(spark, sf_dir, "document_payloads").select("document_id", F.explode("pages").alias("p")).select("document_id", F.explode("p.blocks").alias("b")).where("b.text IS NOT NULL")
    return V.phrase_recall(truth, b.select("document_id", F.col("b.text").alias("text")))


def recall_avg(spark, sf_dir):
    return phrase_recall(spark, sf_dir).agg(F.round(F.avg("accuracy"), 1).alias("mean_accuracy"), F.count("accuracy").alias("documents"))


def _asked(spark, sf_dir) -> DataFrame:
    keys = read_table(spark, sf_dir, "evaluation_texts").select("document_id", F.explode("answer_keys").alias("question", "expected")).where("expected IS NOT NULL").distinct()
    q = _queries(spark, sf_dir).where("query_text IS NOT NULL AND scope IS NOT NULL").select("query_id", "query_text", F.col("scope").alias("document_id"))
    return q.join(keys, "document_id")


def question_similarity(spark, sf_dir):
    return _asked(spark, sf_dir).select("query_id", "question", "expected", V.similarity(F.col("query_text"), F.col("question")).alias("similarity"))


def best_key(spark, sf_dir):
    """The answer key of the query's document whose question is most alike, from 0.35 on."""
    s = question_similarity(spark, sf_dir).where("similarity >= 0.35")
    return s.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "question", "expected"))).where("n = 1").drop("n")


def answer_score(spark, sf_dir):
    """Expected answers against the ground truth text as the answer."""
    e = read_table(spark, sf_dir, "evaluation_texts").select("document_id", "ground_truth_text", F.explode("answer_keys").alias("question", "expected")).distinct()
    return e.select("document_id", "question", "expected", V.answer_score(F.col("expected"), F.col("ground_truth_text")).alias("score"))


def proc_times(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    last = R.last_write(e, ["user_id"], ["ts", "event_id"])
    return last.select("user_id", F.round("value", 1).alias("seconds"))


def section_carry(spark, sf_dir):
    return C.with_sections(_blocks(spark, sf_dir)).select("record_id", "page_pos", "block_pos", "section", "body")


def _rx(spark, sf_dir) -> DataFrame:
    b = _blocks(spark, sf_dir).where("block.type = 'prescription_item' AND block.text IS NOT NULL")
    return b.select("record_id", "page_pos", "block_pos", F.posexplode(F.split("block.text", "\n")).alias("line_no", "line")).withColumn("at", F.struct("page_pos", "block_pos", "line_no"))


def rx_orders(spark, sf_dir):
    """Lines of the prescriptions of a record with the order they belong to."""
    return C.orders(_rx(spark, sf_dir), ["record_id"], "at", "line").select("record_id", "page_pos", "block_pos", "line_no", "order_no", "part")


def rx_summary(spark, sf_dir):
    """Each record's prescription lines, every line once."""
    return C.distinct_lines(_rx(spark, sf_dir).select("record_id", "at", "line").where("trim(line) <> ''"), ["record_id"], "at", "line")


def rx_order_texts(spark, sf_dir):
    return C.order_texts(C.orders(_rx(spark, sf_dir), ["record_id"], "at", "line"), ["record_id"], "at", "line")


def chunks(spark, sf_dir):
    """The chunk table of all payloads."""
    return C.build_chunks(_blocks(spark, sf_dir))


def upsert_lww(spark, sf_dir):
    """The chunk index after all writes: the last row of each id, blank texts left out."""
    c = read_table(spark, sf_dir, "medical_document_chunks").where("chunk_id IS NOT NULL AND trim(chunk_text) <> ''").select("chunk_id", "document_id", "chunk_text", "ingested_at")
    return R.last_write(c, ["chunk_id"], ["ingested_at", "chunk_text"]).drop("ingested_at")


def registry_dedup(spark, sf_dir):
    """Documents by the digest of their text: the first of each content, and how often it came."""
    d = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return d.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def registry_lookup(spark, sf_dir):
    """Documents not processed yet: the registry holds every content of the discharge summaries."""
    d = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", F.sha2("text", 256).alias("file_hash"))
    return R.unseen(d, d.where("source = 'discharge_summary'")).select("doc_id", "file_hash")


def artifact_keys(spark, sf_dir):
    p = read_table(spark, sf_dir, "document_payloads").select("document_id").distinct()
    uri = F.concat(F.lit("s3a://bucket/"), R.artifact_key(F.lit("/raw/"), F.col("document_id"), F.lit("chunks"), F.lit("0001.json")))
    u = p.select("document_id", uri.alias("uri"))
    return u.select("document_id", "uri", R.split_uri(F.col("uri")).alias("u")).select("document_id", "uri", "u.bucket", "u.key")


def identity_maps(spark, sf_dir):
    """The digests that an index document carries, as one row per name."""
    c = read_table(spark, sf_dir, "medical_document_chunks").select("chunk_id", F.explode("metadata.identity_hmacs").alias("name", "digest")).distinct()
    return c.groupBy("name").agg(F.count("*").alias("chunks"), F.countDistinct("digest").alias("digests"))


def index_documents(spark, sf_dir):
    """Chunks with the digests of the identities in their texts."""
    c = read_table(spark, sf_dir, "medical_document_chunks").where("chunk_text IS NOT NULL").select("chunk_id", "chunk_text").distinct()
    return P.index_documents(c, key=KEY).select("chunk_id", F.size("identity_list").alias("identities"), F.map_keys("identity_hmacs").alias("names"))


def form_field_chunks(spark, sf_dir):
    """Form fields and page profiles from paired labels and values."""
    return C.form_chunks(label_pairing(spark, sf_dir))


def stream_windows(spark, sf_dir):
    """Hourly counts by a stream over the events that have arrived, as closed by the watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.run_to_table(ingest.window_counts(stream), spark).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_arrivals(spark, sf_dir):
    """Documents arriving as a stream, repeats of a content dropped."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]").where("text IS NOT NULL").select(F.sha2("text", 256).alias("file_hash"), F.col("ingested_at").cast("timestamp").alias("arrived_at"))
    return ingest.run_to_table(ingest.first_arrivals(stream, within="3650 days"), spark).select("file_hash")


QUERIES = {f.__name__: f for f in (hmac_identity, redact_text, generalize_placeholders, context_mask, context_rows, audit_log, audit_masked, audit_page, audit_range, props_json, phrase_recall, recall_avg, question_similarity, best_key, answer_score, proc_times, section_carry, rx_orders, rx_summary, rx_order_texts, chunks, upsert_lww, registry_dedup, registry_lookup, artifact_keys, identity_maps, index_documents, form_field_chunks, stream_windows, stream_arrivals)}

_IPAD = bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0")).hex()
_OPAD = bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0")).hex()


def _hmac(x: str) -> str:
    return f"sha256(from_hex('{_OPAD}') || from_hex(sha256(from_hex('{_IPAD}') || encode({x}))))"


_WS = r" \t\n\r\f\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _fold(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_{_WS}]', ' ', 'g'), '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g')"


_Q = "q AS (SELECT query_id, max(query_text) AS query_text, max(role) AS role, max(document_id) AS scope, max(asked_at) AS ts FROM retrieval_queries WHERE query_id IS NOT NULL GROUP BY query_id)"
_LOG = f"""{_Q}, log AS (SELECT strftime(ts::TIMESTAMP, '%Y-%m-%dT%H:%M:%S.%f') || 'Z#' || query_id AS accessed_at, ts::TIMESTAMP::DATE AS accessed_day, query_id AS audit_id, 'api' AS actor_name, coalesce(nullif(lower(trim(role)), ''), 'unknown') AS actor_role, coalesce(lower(trim(role)) = 'doctor', false) AS authorized, 'ok' AS status, CASE WHEN trim(scope) <> '' THEN 1 ELSE 0 END AS document_count, '' AS error_masked FROM q)"""
_RECALL = f"""WITH t AS (SELECT DISTINCT document_id, {_fold('b.text')} AS body FROM (SELECT document_id, unnest(p.blocks) AS b FROM (SELECT document_id, unnest(pages) AS p FROM document_payloads)) WHERE b.text IS NOT NULL),
e AS (SELECT document_id, list_filter(list_transform(coalesce(max(key_phrases), []), lambda x: {_fold('x')}), lambda x: x <> '') AS p FROM evaluation_texts WHERE document_id IS NOT NULL GROUP BY document_id),
u AS (SELECT document_id, i, p[i] AS phrase FROM (SELECT document_id, p, unnest(range(1, len(p)::BIGINT + 1)) AS i FROM e)), h AS (SELECT document_id, count(DISTINCT i) AS found FROM u JOIN t USING (document_id) WHERE contains(body, phrase) GROUP BY document_id),
r AS (SELECT document_id, coalesce(found, 0)::INT AS found, len(p)::INT AS total, CASE WHEN len(p) > 0 THEN round(100.0::DOUBLE * coalesce(found, 0) / len(p), 1) END AS accuracy FROM e LEFT JOIN h USING (document_id))"""
_INTENT = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains({{x}}, '{m}')" for m in marks) + f" THEN '{name}' END" for name, marks in V.INTENTS.items()) + "], lambda v: v IS NOT NULL)"


def _jac(a, b):
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE ELSE 0 END"


_SIM = f"""WITH {_Q}, k AS (SELECT DISTINCT document_id, unnest(map_keys(answer_keys)) AS question, unnest(map_values(answer_keys)) AS expected FROM evaluation_texts),
p AS (SELECT query_id, question, expected, {_fold("query_text")} AS fa, {_fold("coalesce(question, '')")} AS fb FROM q JOIN k ON q.scope = k.document_id WHERE query_text IS NOT NULL AND expected IS NOT NULL),
w AS (SELECT *, list_filter(string_split(fa, ' '), lambda x: x <> '') AS wa, list_filter(string_split(fb, ' '), lambda x: x <> '') AS wb, {_INTENT.replace('{x}', 'fa')} AS ia, {_INTENT.replace('{x}', 'fb')} AS ib FROM p),
g AS (SELECT *, list_distinct(list_transform(range(1, greatest(len(wa)::BIGINT, 1)), lambda i: wa[i] || ' ' || wa[i + 1])) AS a2, list_distinct(list_transform(range(1, greatest(len(wb)::BIGINT, 1)), lambda i: wb[i] || ' ' || wb[i + 1])) AS b2, list_distinct(list_transform(range(1, greatest(len(wa)::BIGINT - 1, 1)), lambda i: wa[i] || ' ' || wa[i + 1] || ' ' || wa[i + 2])) AS a3, list_distinct(list_transform(range(1, greatest(len(wb)::BIGINT - 1, 1)), lambda i: wb[i] || ' ' || wb[i + 1] || ' ' || wb[i + 2])) AS b3 FROM w),
j AS (SELECT *, {_jac('list_distinct(wa)', 'list_distinct(wb)')} AS jw, {_jac('ia', 'ib')} AS ji, {_jac('a2', 'b2')} AS j2, {_jac('a3', 'b3')} AS j3 FROM g),
d AS (SELECT *, CASE WHEN len(ia) > 0 AND len(ib) > 0 AND ji = 0 THEN 0.35::DOUBLE ELSE 1 END AS damp, CASE WHEN j2 > 0 THEN j2 ELSE j3 END AS jp FROM j),
s AS (SELECT query_id, question, expected, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0 ELSE round(0.35::DOUBLE * jw * damp + 0.5::DOUBLE * ji + 0.15::DOUBLE * jp * damp, 4) END AS similarity FROM d)"""
_CONT = r"(?i)^[\-–— ]*(?:please take|take|dispense|refills?|schedule|monitor|watch|follow-up|continue|instructions?)([^A-Za-z]|$)"
_BOIL = T.BOILERPLATE
_RXL = f"""{_BLOCKS}, x AS (SELECT record_id, page_pos, block_pos, unnest(range(len(string_split(b.text, chr(10)))::BIGINT))::INT AS line_no, unnest(string_split(b.text, chr(10))) AS line FROM blocks WHERE b.type = 'prescription_item' AND b.text IS NOT NULL),
y AS (SELECT *, regexp_matches(line, '(?i)\\d ?mg([^A-Za-z]|$)|(^|[^A-Za-z])(?:tablets?|capsules?|therapy|cbt)([^A-Za-z]|$)') AND NOT regexp_matches(regexp_replace(regexp_replace(line, '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g'), '{_BOIL}') AND NOT regexp_matches(line, '{_CONT}') AS st, lag(line) OVER w AS before FROM x WINDOW w AS (PARTITION BY record_id ORDER BY page_pos, block_pos, line_no)),
z AS (SELECT *, sum(st::INT) OVER (PARTITION BY record_id ORDER BY page_pos, block_pos, line_no)::BIGINT AS order_no FROM y),
v AS (SELECT *, CASE WHEN st THEN 'start' WHEN order_no > 0 AND (regexp_matches(line, '{_CONT}') OR regexp_matches(coalesce(before, ''), '(?:of|to|for|with|and|,)$') OR regexp_matches(line, '^\\p{{Ll}}') OR (ends_with(line, '.') AND len(regexp_extract_all(line, '[^{_WS}]+')) <= 4)) THEN 'continuation' ELSE 'note' END AS part FROM z)"""
_NAMES = "|".join(sorted(T.SECTIONS, key=len, reverse=True))
_HEAD = rf"(?is)^[ \t\n\r]*({_NAMES})[ \t]*(?:\([^)\n]*\))?[ \t]*(?:[:\-]+|\r?\n|\r?\z)(.*)\z"
_ALIAS = "CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.SECTION_ALIASES.items()) + " ELSE {x} END"
_TITLE = f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b.title, '\\([^)]*\\)[ ]*:?[ ]*$', ''), '[:\\-][ ]*$', ''), '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g'))"
SQL = {
    "hmac_identity": f"SELECT c_custkey, {_hmac('lower(c_name)')} AS digest FROM customer",
    "generalize_placeholders": "SELECT c_custkey, '[PERSON] born [DATE], call [CONTACT] or [CONTACT]; [ID] of ' || c_name AS text FROM customer",
    "context_mask": f"""WITH {_Q}, c AS (SELECT query_id, chunk_id, max(document_id) AS document_id FROM candidates WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY query_id, chunk_id), j AS (SELECT *, coalesce(lower(trim(role)) = 'doctor', false) AS authorized FROM c JOIN q USING (query_id))
SELECT query_id, chunk_id, authorized, CASE WHEN authorized THEN document_id ELSE 'doc_' || substr({_hmac("nullif(lower(trim(document_id)), '')")}, 1, 12) END AS document_ref, CASE WHEN authorized THEN chunk_id ELSE string_split(chunk_id, ':')[-1] END AS chunk_ref FROM j""",
    "audit_log": f"WITH {_LOG} SELECT accessed_at, accessed_day, audit_id, actor_name, actor_role, authorized, status, document_count, error_masked FROM log",
    "audit_page": f"WITH {_LOG} SELECT accessed_at, actor_role FROM log WHERE accessed_at < '2026-01-01T00:00:00.000000Z#' ORDER BY accessed_at DESC LIMIT 25",
    "audit_range": f"WITH {_LOG} SELECT accessed_day, actor_role, count(*) AS accesses, count(*) FILTER (authorized) AS authorized FROM log WHERE accessed_day BETWEEN DATE '2025-03-01' AND DATE '2025-06-30' GROUP BY ALL",
    "props_json": """SELECT event_id, (props->>'k')::BIGINT AS k, '{"a":"' || event_type || '","k":"' || (props->>'k') || '"}' AS json FROM events""",
    "phrase_recall": _RECALL + " SELECT * FROM r",
    "recall_avg": _RECALL + " SELECT round(avg(accuracy), 1) AS mean_accuracy, count(accuracy) AS documents FROM r",
    "question_similarity": _SIM + " SELECT * FROM s",
    "best_key": _SIM + " SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, question, expected) AS n FROM s WHERE similarity >= 0.35) WHERE n = 1",
    "answer_score": f"""WITH e AS (SELECT DISTINCT document_id, ground_truth_text, unnest(map_keys(answer_keys)) AS question, unnest(map_values(answer_keys)) AS expected FROM evaluation_texts),
f AS (SELECT *, {_fold("coalesce(expected, '')")} AS x, {_fold("coalesce(ground_truth_text, '')")} AS a FROM e), w AS (SELECT *, list_filter(string_split(x, ' '), lambda v: length(v) > 2) AS w FROM f)
SELECT document_id, question, expected, CASE WHEN x = '' OR a = '' THEN 0 WHEN contains(a, x) THEN 100 WHEN len(w) > 0 THEN round(100.0::DOUBLE * len(list_filter(w, lambda v: contains(a, v))) / len(w), 1) ELSE 0 END::DOUBLE AS score FROM w""",
    "proc_times": "SELECT user_id, round(value, 1) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "section_carry": f"""WITH {_BLOCKS}, o AS (SELECT *, row_number() OVER (PARTITION BY record_id, page_pos ORDER BY coalesce(b.metadata.reading_order, 1000000000), coalesce(b.bbox[2], 1e9), coalesce(b.bbox[1], 1e9), block_pos) AS ord, lower(regexp_extract(coalesce(b.text, ''), '{_HEAD}', 1)) AS h, regexp_replace(regexp_extract(coalesce(b.text, ''), '{_HEAD}', 2), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS hb FROM blocks),
s AS (SELECT *, CASE WHEN h <> '' THEN {_ALIAS.replace('{x}', 'h')} END AS sec FROM o)
SELECT record_id, page_pos, block_pos, coalesce(last_value(sec IGNORE NULLS) OVER (PARTITION BY record_id, page_pos ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CASE b.type WHEN 'table' THEN 'table' WHEN 'form' THEN 'form' ELSE nullif({_ALIAS.replace('{x}', _TITLE)}, '') END) AS section, CASE WHEN h <> '' THEN hb ELSE coalesce(b.text, '') END AS body FROM s""",
    "rx_orders": f"WITH {_RXL} SELECT record_id, page_pos, block_pos, line_no, order_no, part FROM v",
    "rx_order_texts": f"WITH {_RXL} SELECT record_id, order_no, string_agg(line, ' ' ORDER BY page_pos, block_pos, line_no) AS order_text FROM v WHERE part <> 'note' GROUP BY ALL",
    "rx_summary": f"WITH {_RXL}, n AS (SELECT *, row_number() OVER (PARTITION BY record_id, lower(line) ORDER BY page_pos, block_pos, line_no) AS k FROM x WHERE trim(line) <> '') SELECT record_id, string_agg(line, chr(10) ORDER BY page_pos, block_pos, line_no) AS summary, count(*)::INT AS lines FROM n WHERE k = 1 GROUP BY record_id",
    "upsert_lww": "SELECT chunk_id, document_id, chunk_text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, chunk_text DESC) AS n FROM medical_document_chunks WHERE chunk_id IS NOT NULL AND trim(chunk_text, ' ') <> '') WHERE n = 1",
    "registry_dedup": "SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "registry_lookup": "SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'discharge_summary' AND text IS NOT NULL)",
    "artifact_keys": "SELECT DISTINCT document_id, 's3a://bucket/raw/' || coalesce(document_id || '/', '') || 'chunks/0001.json' AS uri, 'bucket' AS bucket, 'raw/' || coalesce(document_id || '/', '') || 'chunks/0001.json' AS key FROM document_payloads",
    "identity_maps": "SELECT name, count(*) AS chunks, count(DISTINCT digest) AS digests FROM (SELECT DISTINCT chunk_id, unnest(map_keys(metadata.identity_hmacs)) AS name, unnest(map_values(metadata.identity_hmacs)) AS digest FROM medical_document_chunks) GROUP BY name",
    "stream_windows": "WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events) SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= (SELECT mark FROM m)",
    "stream_arrivals": "SELECT DISTINCT sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL",
}
