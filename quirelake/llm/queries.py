"""Queries of the llm problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quirelake.llm import moderate, neighbours, pack, pii, rank, repair, split, tokens
from quirelake.llm.texts import chunk_texts, payload_texts, truth_texts
from quirelake.session import balanced, durable
from quirelake.sources import read_table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pieces of every oversized chunk text and block text."""
    return split.split_oversized(chunk_texts(spark, sf_dir).unionByName(payload_texts(spark, sf_dir)))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that had to be cut."""
    return p1_pieces(spark, sf_dir).where("n_pieces > 1 AND piece_no = 0").select("field", "item_id")


def _close(spark: SparkSession, sf_dir: str) -> neighbours.Result:
    chunks = read_table(spark, sf_dir, "medical_document_chunks")
    return neighbours.search(chunks, "chunk_id", "embedding", k=5, floor=0.9, recall=0.99)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of cosine 0.9 and more: neighbours of representatives, and members of a class with each other."""
    r = _close(spark, sf_dir)
    return neighbours.expand(r, "chunk_id").where("id_a < id_b").select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b")).distinct()


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar other chunks of every representative of equal embeddings."""
    chunks = read_table(spark, sf_dir, "medical_document_chunks")
    r = neighbours.search(chunks, "chunk_id", "embedding", k=5, recall=0.93)
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return r.pairs.select(F.col("a").alias("chunk_id"), F.col("b").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), place.alias("place"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with a valid embedding, its class of equal embeddings and the class's number of close neighbours."""
    r = _close(spark, sf_dir)
    links = r.pairs.groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("links"))
    return r.classes.join(links, "class_id", "left").select(F.col("id").alias("chunk_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_texts(spark, sf_dir).unionByName(payload_texts(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of personal information in a chunk text or block text."""
    texts = _personal(spark, sf_dir)
    return pii.mentions(texts, pii.learn_names(texts)).select("field", "item_id", "pii_type", "start_at").distinct()


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with every mention replaced by a placeholder of its type."""
    texts = _personal(spark, sf_dir)
    return pii.redact(texts, pii.learn_names(texts))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_texts(spark, sf_dir).unionByName(truth_texts(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every noisy line of a block text or ground truth text."""
    texts = _scanned(spark, sf_dir)
    return repair.noisy_lines(texts, repair.fit(texts))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block texts and ground truth texts as continuous paragraphs."""
    texts = _scanned(spark, sf_dir)
    return repair.repair(texts, repair.fit(texts))


SCORES = ["semantic_score", "keyword_score", "hybrid_score", "rerank_score"]


def p7_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every query in one order."""
    return rank.median_rank(read_table(spark, sf_dir, "candidates"), "query_id", "chunk_id", SCORES)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of every query."""
    return p7_ranking(spark, sf_dir).where("position = 1").select("query_id", "chunk_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.encode_column(balanced(docs, "doc_id"), "doc_id", "text")


def p9_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return durable(tokens.encode_column(balanced(docs, "doc_id"), "doc_id", "text", counts_only=True))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or part of a document over the capacity, with its container."""
    return pack.pack(p9_sizes(spark, sf_dir))


def p9_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share; the bound is the least number of containers any packing needs."""
    per = p9_containers(spark, sf_dir).groupBy("container").agg(F.sum("size").alias("used"))
    total = per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.select("containers", "tokens", "fullest", F.ceil(F.col("tokens") / pack.CAPACITY).alias("bound"), (1 - F.col("tokens") / (F.col("containers") * pack.CAPACITY)).alias("unused"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three scores of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return moderate.score_documents(docs, moderate.fit_from(read_table(spark, sf_dir, "content_examples"), docs))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and category it holds."""
    held = F.array_compact(F.array(*[F.when(F.col(c) > moderate.THRESHOLDS[c], F.lit(c)) for c in moderate.CATEGORIES]))
    return p10_scores(spark, sf_dir).select("doc_id", F.explode(held).alias("category"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, those over the threshold in each category and in any, and their rate."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    scored = p10_scores(spark, sf_dir).join(docs, "doc_id")
    over = {c: F.col(c) > moderate.THRESHOLDS[c] for c in moderate.CATEGORIES}
    any_over = over["abusive"] | over["hateful"] | over["sexual"]
    out = scored.groupBy("source").agg(F.count("*").alias("documents"), *[F.count_if(x).alias(c) for c, x in over.items()], F.count_if(any_over).alias("flagged"))
    return out.withColumn("rate", F.col("flagged") / F.col("documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_neighbours, p3_classes, p6_found, p6_redacted, p5_found, p5_repaired, p7_found, p7_ranking, p8_ids, p9_containers, p9_summary, p10_found, p10_scores, p10_rates)}

_RANKS = """
WITH base AS (SELECT query_id, chunk_id, max(semantic_score) AS a, max(keyword_score) AS b, max(hybrid_score) AS c, max(rerank_score) AS d FROM candidates WHERE chunk_id IS NOT NULL GROUP BY ALL),
ranked AS (SELECT query_id, chunk_id, a IS NULL AND b IS NULL AND c IS NULL AND d IS NULL AS none,
  rank() OVER (PARTITION BY query_id ORDER BY a DESC NULLS LAST) AS semantic_score_rank, rank() OVER (PARTITION BY query_id ORDER BY b DESC NULLS LAST) AS keyword_score_rank,
  rank() OVER (PARTITION BY query_id ORDER BY c DESC NULLS LAST) AS hybrid_score_rank, rank() OVER (PARTITION BY query_id ORDER BY d DESC NULLS LAST) AS rerank_score_rank FROM base),
scored AS (SELECT *, list_sort([semantic_score_rank, keyword_score_rank, hybrid_score_rank, rerank_score_rank]) AS r FROM ranked),
placed AS (SELECT *, (r[2] + r[3]) / 2.0::DOUBLE AS median_rank, (r[1] + r[2] + r[3] + r[4]) / 4.0::DOUBLE AS mean_rank FROM scored),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY none, median_rank, mean_rank, chunk_id) AS position FROM placed)
"""
SQL = {
    "p1_found": """SELECT DISTINCT 'chunk_text' AS field, chunk_id AS item_id FROM medical_document_chunks WHERE length(chunk_text) > 1200
UNION ALL SELECT DISTINCT 'block_text', record_id || ':' || (i - 1) || ':' || (j - 1) FROM (
  SELECT record_id, i, j, p.blocks[j] AS b FROM (SELECT record_id, i, pages[i] AS p, unnest(range(1, len(pages[i].blocks) + 1)) AS j FROM (SELECT record_id, pages, unnest(range(1, len(pages) + 1)) AS i FROM document_payloads)))
WHERE length(b.text) > 1200""",
    "p7_found": _RANKS + "SELECT query_id, chunk_id FROM ordered WHERE position = 1",
    "p7_ranking": _RANKS + "SELECT query_id, chunk_id, semantic_score_rank, keyword_score_rank, hybrid_score_rank, rerank_score_rank, median_rank, mean_rank, position FROM ordered",
}
