"""Queries of search, fusion, boosts, reranking and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as PT

from quirelake.operators import retrieval as R
from quirelake.session import balanced
from quirelake.sources import read_table


def _queries(spark, sf_dir) -> DataFrame:
    q = read_table(spark, sf_dir, "retrieval_queries").where("query_id IS NOT NULL")
    return q.groupBy("query_id").agg(F.max("query_text").alias("query_text"), F.max("role").alias("role"), F.max("document_id").alias("scope"), F.max("candidate_k").alias("candidate_k"), F.max("top_k").alias("top_k"))


def _fiftieth(q: DataFrame) -> DataFrame:
    """The query set of the searches: every query whose number is divisible by 50."""
    return q.where(F.substring("query_id", 2, 20).cast("bigint") % 50 == 0)


def _cands(spark, sf_dir) -> DataFrame:
    c = read_table(spark, sf_dir, "candidates").where("query_id IS NOT NULL AND chunk_id IS NOT NULL")
    return c.groupBy("query_id", "chunk_id").agg(F.max("document").alias("text"), F.max("document_id").alias("document_id"), F.max("section").alias("section"), F.max("entity_focus").alias("entity_focus"), F.max("semantic_score").alias("semantic_score"), F.max("keyword_score").alias("keyword_score"))


def _boosted(spark, sf_dir) -> DataFrame:
    fused = R.reciprocal_rank(_cands(spark, sf_dir)).join(_queries(spark, sf_dir), "query_id")
    asked = R.asked_sections(F.col("query_text"))
    boosts = fused.withColumn("intent_boost", R.intent_boost(F.col("section"), F.col("entity_focus"), F.coalesce("text", F.lit("")), asked)).withColumn("affinity_boost", R.affinity_boost(F.col("query_text"), F.col("document_id")))
    return boosts.withColumn("hybrid", F.col("fused") + F.col("intent_boost") + F.col("affinity_boost"))


def bm25_topk(spark, sf_dir):
    docs = balanced(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    out = R.bm25(docs, _fiftieth(_queries(spark, sf_dir)), "doc_id", "text")
    return out.select("query_id", F.col("id").alias("doc_id"), F.round("score", 5).alias("score"), "rank")


def bm25_fts_profile(spark, sf_dir):
    docs = balanced(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    out = R.bm25(docs, _fiftieth(_queries(spark, sf_dir)), "doc_id", "text", k1=1.2)
    return out.select("query_id", F.col("id").alias("doc_id"), F.round("score", 5).alias("score"), "rank")


def vector_topk(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    out = R.vector_topk(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")))
    return out.select("query_id", F.col("id").alias("vec_id"), F.round("cosine", 5).alias("cosine"), "rank")


def vector_topk_scoped(spark, sf_dir):
    """Only vectors with the query's label, cut after the filter."""
    e = read_table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), F.col("label").alias("scope"))
    out = R.vector_topk(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("scope")), k=5)
    return out.select("query_id", F.col("id").alias("vec_id"), F.round("cosine", 5).alias("cosine"), "rank")


def vector_topk_postfiltered(spark, sf_dir):
    """The label filter after the cut, so that a query may keep fewer or none."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    top = vector_topk(spark, sf_dir)
    q, v = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), e
    return top.join(q, "query_id").join(v, "vec_id").where("ql = label").select("query_id", "vec_id", "rank")


def rrf_fusion(spark, sf_dir):
    f = R.reciprocal_rank(_cands(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("fused", 9)), "chunk_id"))
    return f.select("query_id", "chunk_id", "semantic_rank", "keyword_rank", F.round("fused", 6).alias("fused"), place.alias("place"))


def intent_sections(spark, sf_dir):
    return R.candidate_windows(_queries(spark, sf_dir)).select("query_id", F.array_join(R.asked_sections(F.col("query_text")), ",").alias("sections"), "candidate_window", "rerank_window")


def candidate_flags(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return _cands(spark, sf_dir).select("query_id", "chunk_id", R.like_medication(t).alias("medication"), R.like_instruction(t).alias("instruction"), R.like_boilerplate(t).alias("boilerplate"), R.is_order(F.col("text"), F.col("entity_focus")).alias("is_order"))


def boosts(spark, sf_dir):
    return _boosted(spark, sf_dir).select("query_id", "chunk_id", F.round("intent_boost", 6).alias("intent_boost"), F.round("affinity_boost", 6).alias("affinity_boost"), F.round("hybrid", 6).alias("hybrid"))


def cooccurrence(spark, sf_dir):
    """Name and document boosts with the last two words of the question as the phrase."""
    b = _cands(spark, sf_dir).join(_queries(spark, sf_dir), "query_id").where("query_text IS NOT NULL")
    b = b.withColumn("phrases", F.array(F.regexp_extract("query_text", r"([A-Za-z0-9]+ [A-Za-z0-9]+)[^A-Za-z0-9]*$", 1), F.regexp_extract("query_text", r"([A-Za-z0-9]+)[^A-Za-z0-9]*$", 1)))
    out = R.cooccurrence_boost(b.withColumn("name_boost", R.name_boost(F.col("text"), F.col("phrases"))), "text", "phrases")
    return out.select("query_id", "chunk_id", F.round("name_boost", 6).alias("name_boost"), F.round("co_boost", 6).alias("co_boost"))


def rerank_overlap(spark, sf_dir):
    out = R.rerank(R.candidate_windows(_boosted(spark, sf_dir)), "rerank_window")
    return out.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), F.round("combined", 6).alias("combined"), "ord")


def _final(spark, sf_dir) -> DataFrame:
    prepared = R.candidate_windows(_boosted(spark, sf_dir)).where("trim(text) <> ''")
    reranked = R.rerank(prepared, "rerank_window")
    return R.select_final(R.anchors(reranked, prepared), "top_k")


def final_select(spark, sf_dir):
    """The whole retrieval: fusion, boosts, reranking, anchors, selection."""
    return _final(spark, sf_dir).select("query_id", "chunk_id", "pool", "place")


def prompt_block(spark, sf_dir):
    """The context of each question: '[id]' and text of the selected chunks in order."""
    f = _final(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("["), "chunk_id", F.lit("]\n"), "text").alias("t")))).alias("c"))
    return f.select("query_id", F.array_join(F.transform("c", lambda x: x["t"]), "\n\n").alias("context"), F.size("c").alias("chunks"))


def query_names(spark, sf_dir):
    """Name phrases of the questions."""
    udf = F.pandas_udf(lambda s: s.map(R.name_phrases), PT.ArrayType(PT.StringType()))
    return _queries(spark, sf_dir).where("query_text IS NOT NULL").select("query_id", "query_text", udf("query_text").alias("phrases"))


def hash_embeddings(spark, sf_dir):
    """Model-free embeddings of the questions."""
    return _queries(spark, sf_dir).select("query_id", R.hash_embedding(F.col("query_text")).alias("embedding"))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_fts_profile, vector_topk, vector_topk_scoped, vector_topk_postfiltered, rrf_fusion, intent_sections, candidate_flags, boosts, cooccurrence, rerank_overlap, final_select, prompt_block, query_names, hash_embeddings)}


def _w(x: str) -> str:
    return f"(^|[^A-Za-z0-9_])(?:{x})([^A-Za-z0-9_]|$)"


_RX, _DX, _LX = _w("prescription|medication|medications|medicine|medicines|dose|dosage|tablet|tablets|capsule|capsules|rx|drug|drugs|treatment"), _w("diagnosis|diagnoses|condition|disease|disorder|assessment|impression"), _w("lab|labs|investigation|investigations|result|results|test|tests")
_MED = _w("\\d+mg|tablet|tablets|capsule|capsules|orally|dispense|refills|therapy|cbt|amlodipine|losartan|hydrochlorothiazide|sertraline|bupropion|once daily|twice daily")
_INS = _w("take|follow|instructions|daily|morning|evening|weekly|monitor|side effects|refills|dispense|schedule")
_BOI = _w("patient instructions?|instructions carefully|take care and stay healthy|prescribing physician|signature|page\\s+\\d+|hello|watch out|follow the dosage")
_Q = """q AS (SELECT query_id, max(query_text) AS query_text, max(role) AS role, max(document_id) AS scope, max(candidate_k) AS candidate_k, max(top_k) AS top_k FROM retrieval_queries WHERE query_id IS NOT NULL GROUP BY query_id)"""
_QA = _Q + f""", qa AS (SELECT *, regexp_matches(lower(coalesce(query_text, '')), '{_RX}') AS rx, regexp_matches(lower(coalesce(query_text, '')), '{_DX}') AS dx, regexp_matches(lower(coalesce(query_text, '')), '{_LX}') AS lx FROM q),
qw AS (SELECT *, greatest(coalesce(candidate_k, 20), CASE WHEN rx THEN 30 ELSE 0 END) AS candidate_window, greatest(coalesce(top_k, 5), CASE WHEN rx THEN 20 ELSE 0 END) AS rerank_window FROM qa)"""
_C = "c AS (SELECT query_id, chunk_id, max(document) AS text, max(document_id) AS document_id, max(section) AS section, max(entity_focus) AS entity_focus, max(semantic_score) AS semantic_score, max(keyword_score) AS keyword_score FROM candidates WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY query_id, chunk_id)"
_FUSED = _C + """, fused AS (SELECT *, CASE WHEN semantic_score IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC NULLS LAST, chunk_id) END AS semantic_rank,
 CASE WHEN keyword_score IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC NULLS LAST, chunk_id) END AS keyword_rank FROM c),
f AS (SELECT *, coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS fused FROM fused)"""
_FLAG = f"""g AS (SELECT *, regexp_matches(lower(coalesce(text, '')), '{_MED}') OR regexp_matches(lower(coalesce(text, '')), '(^|[^A-Za-z0-9_])\\d+\\.\\s*[a-z][a-z0-9-]*') AS med, regexp_matches(lower(coalesce(text, '')), '{_INS}') AS ins, regexp_matches(lower(coalesce(text, '')), '{_BOI}') AS boi FROM f),
h AS (SELECT *, lower(trim(coalesce(entity_focus, ''))) IN ('medication_order', 'prescription_summary') OR (NOT boi AND med) AS is_order FROM g)"""
_BOOST = f"""WITH {_QA}, {_FUSED}, {_FLAG},
t AS (SELECT h.*, qw.* EXCLUDE (query_id), list_transform(regexp_extract_all(coalesce(query_text, ''), '[A-Za-z0-9]+'), lambda x: lower(x)) AS qt, regexp_replace(lower(coalesce(document_id, '')), '[-_]', ' ', 'g') AS sp FROM h JOIN qw USING (query_id)),
u AS (SELECT *, len(list_intersect(qt, regexp_extract_all(sp, '[a-z0-9]+'))) AS common, list_filter(qt, lambda x: length(x) > 2) AS lg FROM t),
b AS (SELECT *, (CASE WHEN (rx AND lower(section) IN ('prescription', 'medications')) OR (dx AND lower(section) = 'diagnosis') OR (lx AND lower(section) = 'labs') THEN 0.25 ELSE 0 END + CASE WHEN rx THEN CASE WHEN lower(coalesce(entity_focus, '')) = 'prescription_summary' THEN 0.5 WHEN med THEN 0.2 ELSE 0 END + CASE WHEN boi THEN -0.2 ELSE 0 END ELSE 0 END)::DOUBLE AS intent_boost,
 CASE WHEN common = 0 THEN 0 ELSE common / greatest(len(list_distinct(qt)), 1)::DOUBLE * 0.35 + CASE WHEN len(lg) > 1 AND len(list_filter(range(1, len(lg)::BIGINT), lambda i: contains(sp, lg[i] || ' ' || lg[i + 1]))) > 0 THEN 0.35 ELSE 0 END END::DOUBLE AS affinity_boost FROM u),
hy AS (SELECT *, fused + intent_boost + affinity_boost AS hybrid FROM b)"""
_RERANK = _BOOST + """, pr AS (SELECT *, CASE WHEN len(list_distinct(qt)) > 0 THEN len(list_intersect(list_distinct(qt), list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x)))) / len(list_distinct(qt))::DOUBLE ELSE 0 END::DOUBLE AS rerank_score FROM hy {where}),
k AS (SELECT *, rerank_score + 0.35 * hybrid AS combined FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, round(hybrid, 9) DESC, chunk_id) AS r0 FROM pr) WHERE r0 <= rerank_window),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(combined, 9) DESC, chunk_id) AS ord FROM k)"""
_FINAL = _RERANK.replace("{where}", "WHERE trim(text) <> ''") + """, an AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid, 9) DESC, keyword_score DESC NULLS LAST, semantic_score DESC NULLS LAST, chunk_id) AS r1 FROM pr WHERE rx AND is_order) WHERE r1 <= 5),
al AS (SELECT query_id, chunk_id, text, rx, is_order, ins, boi, top_k, ord FROM o UNION ALL SELECT query_id, chunk_id, text, rx, is_order, ins, boi, top_k, 100000 + r1 FROM an WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.query_id = an.query_id AND o.chunk_id = an.chunk_id)),
po AS (SELECT *, CASE WHEN NOT rx THEN 3 WHEN is_order THEN 1 WHEN ins AND NOT boi THEN 2 ELSE 3 END AS pool FROM al),
fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pool, ord, chunk_id) AS place FROM po) WHERE place <= top_k)"""


def _bm25(k1: float) -> str:
    return f"""WITH {_Q}, d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, t, len(t) AS dl FROM d WHERE len(t) > 0), s AS (SELECT count(*) AS nd, avg(dl) AS avgdl FROM n),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, dl, unnest(t) AS term FROM n) GROUP BY ALL), i AS (SELECT term, ln(1 + (nd - count(*) + 0.5) / (count(*) + 0.5)) AS idf, avgdl FROM p, s GROUP BY term, nd, avgdl),
a AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, lower(unnest(regexp_extract_all(query_text, '[A-Za-z0-9]+'))) AS term FROM q WHERE substr(query_id, 2)::BIGINT % 50 = 0) GROUP BY ALL),
r AS (SELECT query_id, doc_id, sum(qtf * idf * tf * ({k1} + 1)::DOUBLE / (tf + {k1}::DOUBLE * (0.25 + 0.75 * dl / avgdl))) AS score FROM a JOIN i USING (term) JOIN p USING (term) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 5) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""


_VEC = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, q.label AS ql, v.label, list_cosine_similarity(q.e, v.e) AS cosine FROM v AS q, v WHERE q.vec_id % 50 = 0 {on})"""
SQL = {
    "bm25_topk": _bm25(1.5),
    "bm25_fts_profile": _bm25(1.2),
    "vector_topk": f"WITH {_VEC.replace('{on}', '')} SELECT query_id, vec_id, round(cosine, 5) AS cosine, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id::VARCHAR) AS rank FROM s) WHERE rank <= 10",
    "vector_topk_scoped": f"WITH {_VEC.replace('{on}', 'AND q.label = v.label')} SELECT query_id, vec_id, round(cosine, 5) AS cosine, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id::VARCHAR) AS rank FROM s) WHERE rank <= 5",
    "vector_topk_postfiltered": f"WITH {_VEC.replace('{on}', '')} SELECT query_id, vec_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id::VARCHAR) AS rank FROM s) WHERE rank <= 10 AND ql = label",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, chunk_id, semantic_rank::INT AS semantic_rank, keyword_rank::INT AS keyword_rank, round(fused, 6) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, chunk_id)::INT AS place FROM f",
    "intent_sections": f"WITH {_QA} SELECT query_id, array_to_string(list_filter([CASE WHEN rx THEN 'prescription' END, CASE WHEN rx THEN 'medications' END, CASE WHEN dx THEN 'diagnosis' END, CASE WHEN lx THEN 'labs' END], lambda x: x IS NOT NULL), ',') AS sections, candidate_window, rerank_window FROM qw",
    "candidate_flags": f"WITH {_FUSED}, {_FLAG} SELECT query_id, chunk_id, med AS medication, ins AS instruction, boi AS boilerplate, is_order FROM h",
    "boosts": _BOOST + " SELECT query_id, chunk_id, round(intent_boost, 6) AS intent_boost, round(affinity_boost, 6) AS affinity_boost, round(hybrid, 6) AS hybrid FROM hy",
    "cooccurrence": f"""WITH {_Q}, {_C}, p AS (SELECT c.*, regexp_replace(lower(coalesce(text, '')), '[.''’‘]', '', 'g') AS t, regexp_extract(query_text, '([A-Za-z0-9]+ [A-Za-z0-9]+)[^A-Za-z0-9]*$', 1) AS p2, regexp_extract(query_text, '([A-Za-z0-9]+)[^A-Za-z0-9]*$', 1) AS p1 FROM c JOIN q USING (query_id) WHERE query_text IS NOT NULL),
x AS (SELECT *, p2 <> '' AND contains(t, lower(p2)) AS h2, p1 <> '' AND contains(t, lower(p1)) AS h1 FROM p),
d AS (SELECT *, CASE WHEN document_id IS NULL THEN 0 ELSE max((h1 OR h2)::INT) OVER (PARTITION BY query_id, document_id) END AS doc FROM x), e AS (SELECT *, max(doc) OVER (PARTITION BY query_id) AS anyone FROM d)
SELECT query_id, chunk_id, CASE WHEN h2 THEN 1.1 WHEN h1 THEN 0.55 ELSE 0 END::DOUBLE AS name_boost, CASE WHEN anyone = 0 THEN 0 WHEN doc = 1 THEN 0.8 ELSE -0.3 END::DOUBLE AS co_boost FROM e""",
    "rerank_overlap": _RERANK.replace("{where}", "") + " SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, round(combined, 6) AS combined, ord::INT AS ord FROM o",
    "final_select": _FINAL + " SELECT query_id, chunk_id, pool, place::INT AS place FROM fi",
    "prompt_block": _FINAL + " SELECT query_id, string_agg('[' || chunk_id || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY place) AS context, count(*)::INT AS chunks FROM fi GROUP BY query_id",
}
