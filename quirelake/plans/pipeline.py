"""The whole way: files to chunks to answers, as lazy plans and as batch and stream jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirelake.operators import audit, chunk, privacy
from quirelake.operators import retrieval as R
from quirelake.operators.registry import replace_documents, unseen

VERSION = "0.1.0"


def ingest(payloads: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Chunks of the payloads whose content is not registered yet, with version and time."""
    d = payloads.withColumn("file_hash", F.sha2(F.to_json(F.struct("pages")), 256))
    if registry is not None:
        d = unseen(d, registry)
    pages = d.dropDuplicates(["record_id"]).select("record_id", F.posexplode("pages").alias("page_pos", "page"))
    blocks = pages.select("record_id", "page_pos", "page.page_number", "page.page_type", F.posexplode("page.blocks").alias("block_pos", "block")).where("block IS NOT NULL")
    return chunk.build_chunks(blocks).withColumn("extraction_version", F.lit(VERSION)).withColumn("created_at", F.current_timestamp())


def refresh(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """An index with all chunks of the newly processed records replaced."""
    return replace_documents(index, chunks, "record_id")


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 20, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, scorer: Callable | None = None) -> DataFrame:
    """Final chunks of every question: keyword and, where vectors are given, vector search, fused, boosted, reranked, selected.

    queries: (query_id, query_text, role, document_id, candidate_k, top_k); chunks: (chunk_id, document_id, section,
    entity_focus, text); vectors: (id, vec) with id a chunk_id; query_vectors: (query_id, vec). A question with a document id sees only that document's chunks, before the cut.
    Each side keeps the candidate window of its question: candidate_k, else k, and 30 at least where it asks for a prescription.
    """
    queries = R.candidate_windows(queries, base=k)
    texts = chunks.select("chunk_id", "text", "document_id")
    found = R.bm25(texts, queries, "chunk_id", "text", k="candidate_window", scope="document_id").select("query_id", F.col("id").alias("chunk_id"), F.col("score").alias("keyword_score"))
    if vectors is not None and query_vectors is not None:
        asks = query_vectors.select("query_id", "vec").join(queries.select("query_id", F.col("document_id").alias("scope"), "candidate_window"), "query_id")
        known = vectors.select("id", "vec").join(chunks.select(F.col("chunk_id").alias("id"), F.col("document_id").alias("scope")), "id")
        near = R.vector_topk(asks, known, k="candidate_window", open_scope=True).select("query_id", F.col("id").alias("chunk_id"), F.col("cosine").alias("semantic_score"))
        found = found.join(near, ["query_id", "chunk_id"], "full_outer")
    else:
        found = found.withColumn("semantic_score", F.lit(None).cast("double"))
    asked_of = queries.select("query_id", "query_text", "role", F.col("document_id").alias("scope"), "candidate_k", "top_k", "candidate_window", "rerank_window")
    cands = found.join(chunks, "chunk_id").join(asked_of, "query_id")
    fused = R.reciprocal_rank(cands)
    asked = R.asked_sections(F.col("query_text"))
    boosted = fused.withColumn("hybrid", F.col("fused") + R.intent_boost(F.col("section"), F.col("entity_focus"), F.coalesce("text", F.lit("")), asked) + R.affinity_boost(F.col("query_text"), F.col("document_id")))
    prepared = boosted.where("trim(text) <> ''")
    return R.select_final(R.anchors(R.rerank(prepared, "rerank_window", scorer=scorer), prepared), "top_k")


def instruction(question: Column, authorised: Column) -> Column:
    """What the answer is asked to do, by the kind of question and the right to see names."""
    asks = F.array_contains(R.asked_sections(question), "prescription")
    return (
        F.when(asks & authorised, "Name each medication found in the passages with its dose, route, frequency and directions; go through all of them.")
        .when(asks, "Name each medication found in the passages with dose and directions in general words; keep placeholders as they stand; go through all of them.")
        .otherwise("Use the passages alone for the answer.")
    )


def prompts(final: DataFrame) -> DataFrame:
    """(query_id, prompt, sources): instruction, passages '[id]' and text in order, and the question; masked for roles without the right."""
    ctx = privacy.context(final, keep=("place", "query_text", "role")).withColumnRenamed("chunk_ref", "ref")
    g = ctx.groupBy("query_id").agg(F.max("query_text").alias("q"), F.max("role").alias("role"), F.array_sort(F.collect_list(F.struct("place", "ref", "content"))).alias("c"))
    block = F.array_join(F.transform("c", lambda x: F.concat(F.lit("["), x["ref"], F.lit("]\n"), x["content"])), "\n\n")
    prompt = F.concat_ws("\n\n", instruction(F.col("q"), privacy.authorised(F.col("role"))), block, F.concat(F.lit("Question: "), "q"))
    return g.select("query_id", prompt.alias("prompt"), F.transform("c", lambda x: x["ref"]).alias("sources"), F.get("c", F.lit(0))["content"].alias("first"))


def ask(queries: DataFrame, chunks: DataFrame, answer: Callable[[DataFrame], DataFrame] | None = None, **search) -> DataFrame:
    """(query_id, answer, sources) of every question.

    answer: adds `answer` to (query_id, prompt, ...), such as a model in mapInPandas; the default is the first passage.
    """
    p = prompts(retrieve(queries, chunks, **search))
    return (answer(p) if answer else p.withColumn("answer", F.col("first"))).select("query_id", "answer", "sources")


def logged(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Audit rows of the questions, with the status of their answers."""
    a = queries.join(answers.select("query_id", F.lit("ok").alias("s")), "query_id", "left")
    rows = a.select(F.col("query_id").alias("audit_id"), F.current_timestamp().alias("ts"), F.lit("batch").alias("actor_name"), F.col("role").alias("actor_role"), "query_text", "document_id", F.coalesce("s", F.lit("no_answer")).alias("status"), F.lit(None).cast("string").alias("error"))
    return audit.entries(rows)


def semantic_groups(sentences: DataFrame, cut: float = 0.72) -> DataFrame:
    """Numbers the groups of a document's sentences: a new one where the cosine of neighbours is below the cut.

    sentences: (doc_id, n, vec of unit length). The first sentence opens group 0; a null vector opens a group.
    """
    w = Window.partitionBy("doc_id").orderBy("n")
    before = F.lag("vec").over(w)
    d = sentences.withColumn("_p", before)
    dot = F.aggregate(F.zip_with("vec", "_p", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    new = F.when(F.col("_p").isNull(), F.when(F.row_number().over(w) == 1, 0).otherwise(1)).when(dot >= cut, 0).otherwise(1)
    return d.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_p", "_new")
