"""Questions to cited evidence: recall in both channels, fusion, expansion, decision and evidence in one plan."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import spread
from ..functions.tokens import word_tokenizer
from ..operators import blocks as blk
from ..operators import chunks as chk
from ..operators import evidence as ev
from ..operators import lexical as lx
from ..operators import ranking as rk
from ..operators import vectors as vec
from ..session import durable
from .registry import table

DIM = 64


def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Parents and children of every document, one block per line."""
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), "lang", "text"), "version_id")
    blocks = blk.text_blocks(docs, separator="\n")
    drafts = chk.chunk_generic(blocks)
    key = F.col("version_id").cast("string")
    return drafts.select(
        "version_id", "kind", "content", F.concat_ws(":", key, "local_id").alias("chunk_id"),
        F.when(F.col("kind") == "child", F.concat_ws(":", key, "parent_local_id")).alias("parent_chunk_id"),
        F.concat(F.lit("doc "), key).alias("title"))


def benchmark_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.array_join(word_tokenizer(F.col("text")), " ").alias("query"))


def lexical_hits(chunks: DataFrame, questions: DataFrame, k: int = 40) -> DataFrame:
    children = chunks.where("kind = 'child'").select("chunk_id", F.col("content").alias("text"))
    return lx.bm25_search(children, questions, k).withColumn("source", F.lit("bm25"))


def grounded_retrieval(spark: SparkSession, d: str) -> DataFrame:
    chunks = durable(line_chunks(spark, d))  # the chunk table: recall, expansion and evidence all read it
    questions = benchmark_questions(spark, d)
    lexical = lexical_hits(chunks, questions)
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding", F.lit(0).alias("domain"))
    asks = vectors.join(questions.select(F.col("query_id").alias("vec_id")), "vec_id").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "domain")
    near = vec.vector_search(vectors, asks, 40)
    # A vector stands for the first child of the document of the same number.
    semantic = near.select("query_id", F.concat(F.col("chunk_id").cast("string"), F.lit(":child-0-0")).alias("chunk_id"), "score", "rank",
                           F.lit("vector").alias("source"))
    hits = lexical.select("query_id", "chunk_id", "score", "rank", "source").unionByName(semantic).withColumns(
        {c: F.split("chunk_id", ":")[0] for c in rk.IDENTITY})
    fused = durable(rk.rrf(hits))
    plans, _ = rk.small_to_big(fused, chunks, stored=True)
    views, _ = rk.expand_parents(durable(plans), chunks, stored=True)
    scored = ev.score_kind(views.select(
        "query_id", F.lit("hybrid").alias("mode"), "rank", "best_score", F.lit(False).alias("rerank_applied"), F.lit(None).cast("double").alias("rerank_score")))
    decisions = ev.decide_quality(scored.withColumn("missing", F.array().cast("array<string>")), ev.score_bands(spark))
    evidence = ev.build_evidence(views.select(
        F.col("query_id").alias("question_id"), F.lit(0).alias("domain_position"), F.lit("corpus").alias("domain"), "rank",
        F.col("parent_chunk_id").alias("parent_id"), "title", "content", F.col("best_score").alias("score"),
        F.array().cast("array<string>").alias("heading_path"), F.array().cast("array<int>").alias("page_numbers")))
    return evidence.join(decisions.select(F.col("query_id").alias("question_id"), "decision", "reason_code"), "question_id").select(
        "question_id", "decision", "reason_code", "evidence_id", "parent_id", F.round("score", 6).alias("score"), "title", "excerpt")
