"""Keyword and vector search, rank fusion, boosts, reranking and selection; all for many queries at once."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quirelake.functions import text as T

# Words that tell what a question asks for, and what a chunk is about.
ASKS_PRESCRIPTION = "prescription medication medications medicine medicines dose dosage tablet tablets capsule capsules rx drug drugs treatment".split()
ASKS_DIAGNOSIS = "diagnosis diagnoses condition disease disorder assessment impression".split()
ASKS_LABS = "lab labs investigation investigations result results test tests".split()
MEDICATION_WORDS = ["\\d+mg", *"tablet tablets capsule capsules orally dispense refills therapy cbt amlodipine losartan hydrochlorothiazide sertraline bupropion".split(), "once daily", "twice daily"]
INSTRUCTION_WORDS = ["take", "follow", "instructions", "daily", "morning", "evening", "weekly", "monitor", "side effects", "refills", "dispense", "schedule"]
BOILERPLATE_WORDS = ["patient instructions?", "instructions carefully", "take care and stay healthy", "prescribing physician", "signature", "page\\s+\\d+", "hello", "watch out", "follow the dosage"]


def words(choices: list[str]) -> str:
    """A pattern of whole words in ASCII terms that Java and RE2 read alike."""
    return r"(^|[^A-Za-z0-9_])(?:" + "|".join(choices) + r")([^A-Za-z0-9_]|$)"


def asked_sections(question: Column) -> Column:
    """The sections that a question asks for; empty where it asks for none."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    return F.array_compact(
        F.array(
            F.when(q.rlike(words(ASKS_PRESCRIPTION)), "prescription"), F.when(q.rlike(words(ASKS_PRESCRIPTION)), "medications"),
            F.when(q.rlike(words(ASKS_DIAGNOSIS)), "diagnosis"), F.when(q.rlike(words(ASKS_LABS)), "labs"),
        )
    )


def like_medication(text: Column) -> Column:
    t = F.lower(text)
    return t.rlike(words(MEDICATION_WORDS)) | t.rlike(r"(^|[^A-Za-z0-9_])\d+\.\s*[a-z][a-z0-9-]*")


def like_instruction(text: Column) -> Column:
    return F.lower(text).rlike(words(INSTRUCTION_WORDS))


def like_boilerplate(text: Column) -> Column:
    return F.lower(text).rlike(words(BOILERPLATE_WORDS))


def candidate_windows(queries: DataFrame, base: int = 20, prescription: int = 30, most: int = 20) -> DataFrame:
    """Adds the candidate window and the rerank window of each query."""
    asks = F.array_contains(asked_sections(F.col("query_text")), "prescription")
    window = F.greatest(F.coalesce("candidate_k", F.lit(base)), F.when(asks, prescription).otherwise(0))
    return queries.withColumn("candidate_window", window).withColumn("rerank_window", F.greatest(F.coalesce("top_k", F.lit(5)), F.when(asks, most).otherwise(0)))


def postings(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, term, tf, dl, keep ...); texts without terms give no row."""
    terms = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), T.search_terms(F.col(text_col)).alias("t"), *keep).where(F.size("t") > 0)
    return terms.select("id", F.size("t").alias("dl"), F.explode("t").alias("term"), *keep).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), *[F.first(c).alias(c) for c in keep])


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int | str = 10, k1: float = 1.5, b: float = 0.75, scope: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best texts of every query; k is a number or a column of the queries.

    scope: a column of both sides; a query with a value there sees only texts of that value, before the cut.
    A term that a query repeats counts as often. The statistics are of all texts with a term. The postings meet the
    query terms in a join on the term: a term of a third of all texts is split by the adaptive skew join, and the score
    is pre-aggregated per (query, text) before the second shuffle.
    """
    post = postings(docs, id_col, text_col, *[scope] if scope else [])
    # Two numbers of the corpus; one small job.
    n_docs, avgdl = docs.where(F.col(text_col).isNotNull()).select(F.size(T.search_terms(F.col(text_col))).alias("n")).where("n > 0").agg(F.count("*"), F.avg("n")).head()
    avgdl = avgdl or 1.0
    own = [F.col(scope).alias("_scope")] if scope else []
    asked = queries.where("query_text IS NOT NULL").select("query_id", *own, F.explode(T.search_terms(F.col("query_text"))).alias("term")).groupBy("query_id", "term", *["_scope"] if scope else []).agg(F.count("*").alias("qtf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighted = asked.join(idf, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    met = post.join(weighted, "term")
    if scope:
        met = met.where(F.col("_scope").isNull() | (F.col("_scope") == F.col(scope)))
    scored = met.groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return _within(scored.withColumn("rank", F.row_number().over(best)), queries, k, _most(queries, k))


def _most(queries: DataFrame, k: int | str) -> int:
    """The largest k; of a column one small job."""
    return queries.agg(F.max(k)).head()[0] or 0 if isinstance(k, str) else k


def _within(ranked: DataFrame, queries: DataFrame, k: int | str, most: int) -> DataFrame:
    """The rows up to rank k, a number or a column of the queries; first up to the largest k, so that the sort is limited."""
    best = ranked.where(F.col("rank") <= most)
    if not isinstance(k, str):
        return best
    own = queries.groupBy("query_id").agg(F.max(k).alias("_k"))
    return best.join(own, "query_id").where(F.col("rank") <= F.col("_k")).drop("_k")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int | str = 10, query_block: int = 4096, vector_block: int = 65536, open_scope: bool = False) -> DataFrame:
    """(query_id, id, cosine, rank), exact: blocks of queries against blocks of vectors, best k of each block merged.

    k is a number or a column of the queries.
    queries: (query_id, vec [, scope]); vectors: (id, vec [, scope]). With a scope only vectors of the query's scope
    count (applied before the cut); with open_scope a query of null scope sees all vectors. Memory of a task is bounded by the two block sizes. Zero and null vectors take no part.
    """
    scoped = "scope" in queries.columns
    most = _most(queries, k)  # for each block; a query's own k is applied to the merged ranks
    nq, nv = queries.count(), vectors.count()
    bq, bv = max(1, -(-nq // query_block)), max(1, -(-nv // vector_block))
    scope = ["scope"] if scoped else []
    q = queries.where("vec IS NOT NULL").select(F.col("query_id").cast("string").alias("id"), "vec", *scope, F.pmod(F.xxhash64("query_id"), F.lit(bq)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(bv - 1))).alias("vb"), F.lit(True).alias("asks"))
    v = vectors.where("vec IS NOT NULL").select(F.col("id").cast("string").alias("id"), "vec", *scope, F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(bv)).alias("vb"), F.lit(False).alias("asks"))

    def best(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks"))
        ids = np.asarray(table.column("id").to_pandas(), object)
        scopes = np.asarray(table.column("scope").to_pandas(), object) if scoped else None
        vecs = table.column("vec").to_pylist()
        dim = max((len(x) for x in vecs), default=0)
        m = np.array([x if len(x) == dim else [0.0] * dim for x in vecs], np.float64).reshape(-1, dim)
        norm = np.linalg.norm(m, axis=1)
        live = norm > 0
        m = np.divide(m, norm[:, None], out=np.zeros_like(m), where=live[:, None])
        qi, vi = np.flatnonzero(asks & live), np.flatnonzero(~asks & live)
        out_q, out_v, out_s = [], [], []
        order = np.argsort(ids[vi].astype(str))
        vi = vi[order]
        for lo in range(0, len(qi), 256):
            s = m[qi[lo : lo + 256]] @ m[vi].T
            for row, i in zip(s, qi[lo : lo + 256]):
                on = np.flatnonzero(scopes[vi] == scopes[i]) if scoped and not (open_scope and pd.isna(scopes[i])) else np.arange(len(vi))
                r = np.round(row[on], 9)
                top = on[np.argsort(-r, kind="stable")[:most]] if len(on) <= 4 * most else on[_top(r, most)]
                out_q += [ids[i]] * len(top)
                out_v += ids[vi[top]].tolist()
                out_s += row[top].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.string()), "id": pa.array(out_v, pa.string()), "cosine": pa.array(out_s, pa.float64())})

    met = q.unionByName(v).groupBy("qb", "vb").applyInArrow(best, "query_id string, id string, cosine double")
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]
    met = met.select(F.col("query_id").cast(kinds[0]).alias("query_id"), F.col("id").cast(kinds[1]).alias("id"), "cosine")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), F.col("id").cast("string"))
    return _within(met.withColumn("rank", F.row_number().over(order)), queries, k, most)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the earlier place."""
    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
    at = np.flatnonzero(scores >= cut)
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def reciprocal_rank(cands: DataFrame, semantic: str = "semantic_score", keyword: str = "keyword_score", k: int = 60, w: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Adds the ranks of both sides and `fused` = sum of w / (k + rank); a side that lacks the candidate adds nothing."""
    out = cands
    for name, col in (("semantic_rank", semantic), ("keyword_rank", keyword)):
        r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(col).desc_nulls_last(), "chunk_id"))
        out = out.withColumn(name, F.when(F.col(col).isNotNull(), r))
    part = [F.coalesce(F.lit(x) / (k + F.col(n)), F.lit(0.0)) for n, x in zip(("semantic_rank", "keyword_rank"), w)]
    return out.withColumn("fused", part[0] + part[1])


def intent_boost(section: Column, focus: Column, text: Column, asked: Column) -> Column:
    """Section asked for +0.25; on a prescription question a summary +0.50, else a medication +0.20, boilerplate -0.20."""
    on_section = F.when(F.array_contains(asked, F.lower(F.coalesce(section, F.lit("")))), 0.25).otherwise(0.0)
    asks = F.array_contains(asked, "prescription")
    medication = F.when(F.lower(F.coalesce(focus, F.lit(""))) == "prescription_summary", 0.50).when(like_medication(text), 0.20).otherwise(0.0)
    plain = F.when(like_boilerplate(text), -0.20).otherwise(0.0)
    return on_section + F.when(asks, F.coalesce(medication, F.lit(0.0)) + F.coalesce(plain, F.lit(0.0))).otherwise(0.0)


def affinity_boost(question: Column, document_id: Column, weight: float = 0.35, phrase_weight: float = 0.35) -> Column:
    """Share of the question's terms that the document's id holds, and once more where two neighbouring terms follow each other in it."""
    asked = T.search_terms(F.coalesce(question, F.lit("")))
    spoken = F.regexp_replace(F.lower(F.coalesce(document_id, F.lit(""))), "[-_]", " ")
    common = F.size(F.array_intersect(asked, T.search_terms(spoken)))
    long = F.filter(asked, lambda x: F.length(x) > 2)
    pairs = T.ngrams(long, 2)
    share = common / F.greatest(F.size(F.array_distinct(asked)), F.lit(1)) * weight
    return F.when(common == 0, 0.0).otherwise(share + F.when(F.exists(pairs, lambda p: F.contains(spoken, p)), phrase_weight).otherwise(0.0))


def bare(text: Column) -> Column:
    """Lower case without full stops and apostrophes."""
    return F.regexp_replace(F.lower(text), "[.'’‘]", "")


def name_boost(text: Column, phrases: Column, weight: float = 0.55) -> Column:
    """The best of weight * min(words, 3) over the phrases that the text holds."""
    t = bare(F.coalesce(text, F.lit("")))
    scores = F.transform(phrases, lambda p: F.when((p != "") & F.contains(t, bare(p)), weight * F.least(F.size(F.split(T.squeeze(p), " ")), F.lit(3))).otherwise(0.0))
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def cooccurrence_boost(cands: DataFrame, text: str, phrases: str, up: float = 0.80, down: float = 0.30) -> DataFrame:
    """Adds `co_boost`: +up for all chunks of a document one of whose chunks holds a phrase, -down for the others of the query.

    Nothing changes for a query without any such chunk. Two maxima over windows; no join.
    """
    t = bare(F.coalesce(F.col(text), F.lit("")))
    hit = F.exists(F.col(phrases), lambda p: (p != "") & F.contains(t, bare(p))).cast("int")
    doc = F.when(F.col("document_id").isNotNull(), F.max("_hit").over(Window.partitionBy("query_id", "document_id"))).otherwise(0)
    anyone = F.max("_doc").over(Window.partitionBy("query_id"))
    out = cands.withColumn("_hit", F.coalesce(hit, F.lit(0))).withColumn("_doc", doc).withColumn("_any", anyone)
    return out.withColumn("co_boost", F.when(F.col("_any") == 0, 0.0).when(F.col("_doc") == 1, up).otherwise(-down)).drop("_hit", "_doc", "_any")


_STOP = frozenset("the a an and or of for to in on at by with from is was are were what which who whom whose when where how why did does do has have had his her their its this that these those patient patients list show give tell me all any there about prescribed latest value trend history follow up plan dose name names doctor report reports chunk result results test tests".split())
_NAME_TITLE = re.compile(r"\b(?:mr|mrs|ms|dr|prof|doctor|nurse)\.?\s+", re.I)


def name_phrases(question: str | None) -> list[str]:
    """Phrases of a question that may name a person: titled names, capitalised runs, else lower-case runs of two content words."""
    if not question or not question.strip():
        return []
    q = re.sub(r"['’]s\b", "", question)
    found: list[str] = []

    def run(tokens: list[str]) -> list[str]:
        out = []
        for t in tokens:
            if t.lower() in _STOP:
                break
            out.append(t)
        return out

    for m in _NAME_TITLE.finditer(q):
        name = run(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", q[m.end() :]))[:3]
        if name:
            found += [m[0].strip() + " " + " ".join(name), " ".join(name)]
    if not found:
        for m in re.finditer(r"(?:[A-ZÀ-Þ][\w'-]+)(?:\s+[A-ZÀ-Þ][\w'-]+)+", q):
            name = [t for t in m[0].split() if t.lower() not in _STOP]
            if len(name) >= 2:
                found.append(" ".join(name))
    if not found:
        now: list[str] = []
        for t in [*re.findall(r"[^\W\d_]+", q), ""]:
            if t and t.lower() not in _STOP:
                now.append(t)
            else:
                if len(now) >= 2:
                    found.append(" ".join(now))
                now = []
    seen: dict[str, str] = {}
    for p in found:
        seen.setdefault(p.lower(), p)
    return list(seen.values())


def overlap_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct terms that a text holds: the default scorer of the reranking."""
    asked = F.array_distinct(T.search_terms(F.coalesce(question, F.lit(""))))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, T.search_terms(F.coalesce(text, F.lit(""))))) / F.size(asked)).otherwise(0.0)


def rerank(cands: DataFrame, top_k: str, blend: float = 0.35, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The best `top_k` of each query by rerank score, then ordered by rerank + blend * hybrid.

    scorer: a function that adds `rerank_score` to (query_text, text, ...), such as a model in mapInPandas; the default
    is the share of common terms.
    """
    scored = scorer(cands) if scorer else cands.withColumn("rerank_score", overlap_score(F.col("query_text"), F.col("text")))
    first = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), F.desc(F.round("hybrid", 9)), "chunk_id")
    kept = scored.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= F.col(top_k)).drop("_r")
    kept = kept.withColumn("combined", F.col("rerank_score") + blend * F.col("hybrid"))
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("combined", 9)), "chunk_id")))


def is_order(text: Column, focus: Column) -> Column:
    """Whether a chunk is a medication order."""
    f = F.lower(F.trim(F.coalesce(focus, F.lit(""))))
    t = F.coalesce(text, F.lit(""))
    return f.isin("medication_order", "prescription_summary") | (~like_boilerplate(t) & like_medication(t))


def anchors(reranked: DataFrame, prepared: DataFrame, n: int = 5) -> DataFrame:
    """On prescription questions the n best medication orders that reranking dropped, appended behind, rerank score := hybrid."""
    asks = F.array_contains(asked_sections(F.col("query_text")), "prescription")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("hybrid", 9)), F.col("keyword_score").desc_nulls_last(), F.col("semantic_score").desc_nulls_last(), "chunk_id")
    orders = prepared.where(asks & is_order(F.col("text"), F.col("entity_focus"))).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n)
    missing = orders.join(reranked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    extra = missing.withColumn("rerank_score", F.col("hybrid")).withColumn("combined", F.col("hybrid")).withColumn("ord", 100_000 + F.col("_r")).drop("_r")
    return reranked.unionByName(extra.select(*reranked.columns))


def select_final(cands: DataFrame, top_k: str) -> DataFrame:
    """The final candidates in order: on prescription questions orders, then instructions, then the rest; else by rank."""
    asks = F.array_contains(asked_sections(F.col("query_text")), "prescription")
    text = F.coalesce("text", F.lit(""))
    pool = F.when(~asks, 3).when(is_order(text, F.col("entity_focus")), 1).when(like_instruction(text) & ~like_boilerplate(text), 2).otherwise(3)
    placed = cands.withColumn("pool", pool)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pool", "ord", "chunk_id"))
    return placed.withColumn("place", place).where(F.col("place") <= F.col(top_k))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic vector of a text without a model: hashed term counts of unit length; null for a text without terms."""
    terms = T.search_terms(F.coalesce(text, F.lit("")))
    slot = F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slot, lambda s: s == i)).cast("double"))
    return F.when(F.size(terms) > 0, l2_normalise(counts))


def l2_normalise(vec: Column) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vec, lambda x: x.cast("double") / norm))


def keyword_index(docs: DataFrame, id_col: str, text_col: str) -> dict[str, DataFrame]:
    """The tables of a keyword index: postings (id, term, tf, dl), term_stats (term, df, cf), corpus_stats (n_docs, avgdl)."""
    post = postings(docs, id_col, text_col)
    sizes = post.groupBy("id").agg(F.max("dl").alias("dl"))
    return {"postings": post, "term_stats": post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), "corpus_stats": sizes.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))}


def save_index(index: dict[str, DataFrame], path: str, partitions: int = 64) -> None:
    """Writes an index; postings are laid out by term, so that a search reads the files of its terms."""
    for name, df in index.items():
        out = df.repartitionByRange(partitions, "term").sortWithinPartitions("term") if name == "postings" else df
        out.write.mode("overwrite").parquet(f"{path}/{name}")
