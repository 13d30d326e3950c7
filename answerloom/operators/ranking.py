"""Fusion of channel rankings, expansion of child hits to parents, reranking.

Groups here are one query's hits, bounded by the recall depth (at most 100 per channel)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scale import fits_broadcast, grouped_list, small_side, top_k
from ..functions.tokens import bigram_tokenizer

IDENTITY = ("document_id", "version_id", "index_version_id")
MAX_RECALL = 100


def rrf(hits: DataFrame, k: int = 60) -> DataFrame:
    """FUS-1: sum of 1/(k+rank) over channels, one evidence entry per channel; every hit of every channel stays.

    ``hits``: query_id, source, rank, score, chunk_id and the identity columns. ``conflict`` marks a chunk two channels
    describe differently.
    """
    first = hits.groupBy("query_id", "chunk_id", "source").agg(
        F.min("rank").alias("rank"), F.min_by(F.struct("score", *IDENTITY), F.col("rank")).alias("_h"),
        F.min(F.struct(*IDENTITY)).alias("_low"), F.max(F.struct(*IDENTITY)).alias("_high"))
    gain = 1.0 / (k + F.col("rank"))
    fused = first.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(gain), 9).alias("score"), F.min("rank").alias("best_rank"),
        F.array_sort(F.collect_list(F.struct("source", "rank", F.col("_h.score").alias("raw_score"), gain.alias("contribution")))).alias("evidence"),
        F.min_by("_h", F.struct("rank", "source")).alias("_h"), (F.min("_low") != F.max("_high")).alias("conflict"))
    out = fused.select("query_id", "chunk_id", "score", "best_rank", "evidence", *[F.col(f"_h.{c}").alias(c) for c in IDENTITY], "conflict")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "best_rank", "chunk_id")
    return out.withColumn("rank", F.row_number().over(order))


def hybrid_recall(hits: DataFrame, status: DataFrame, child_top_k: int = 20, k: int = 60) -> tuple[DataFrame, DataFrame]:
    """FUS-2: over-fetched channels fused; a failed channel leaves the other one's own ranking and scores.

    ``status``: query_id, vector_failed, bm25_failed. Returns (hits, per-query outcome); both channels down is an error.
    """
    depth = min(2 * child_top_k, MAX_RECALL)
    outcome = status.select(
        "query_id", F.col("vector_failed") | F.col("bm25_failed"), F.array_compact(F.array(
            F.when(F.col("vector_failed"), "vector"), F.when(F.col("bm25_failed"), "bm25"))),
        F.when(F.col("vector_failed") & F.col("bm25_failed"), "SERVICE_NOT_READY"),
    ).toDF("query_id", "degraded", "failed_sources", "error_code")
    alive = hits.where(F.col("rank") <= depth).join(small_side(outcome), "query_id").where(
        ~F.array_contains("failed_sources", F.col("source")))
    both = rrf(alive.where(~F.col("degraded")), k).select("query_id", "chunk_id", "rank", "score", *IDENTITY)
    single = alive.where(F.col("degraded")).select("query_id", "chunk_id", "rank", "score", *IDENTITY)
    return both.unionByName(single), outcome


def _wanted(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks with one of the ids; where these fit a broadcast, the others go before the chunk table is shuffled."""
    return chunks.join(F.broadcast(ids), "chunk_id", "left_semi") if fits_broadcast(ids) else chunks


def small_to_big(hits: DataFrame, chunks: DataFrame, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """EXP-1: (parent plans, errors). Duplicate children keep their first rank; ranks keep counting over duplicates.

    ``stored`` says that the hits are a written table, so they may be measured to cut the chunk table down first.
    """
    first = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    chunks = _wanted(chunks, hits.select("chunk_id").distinct()) if stored else chunks
    linked = first.join(chunks.select("chunk_id", "parent_chunk_id", "version_id"), "chunk_id", "left")
    finite = ~F.isnan("score") & (F.abs("score") != float("inf"))
    error = F.when(F.col("parent_chunk_id").isNull(), "missing_parent").when(~F.coalesce(finite, F.lit(False)), "bad_score")
    marked = linked.withColumn("error", error)
    plans = marked.where("error is null").groupBy("query_id", "parent_chunk_id").agg(
        grouped_list(F.col("chunk_id"), F.col("rank")).alias("child_ids"), F.max("score").alias("best_score"),
        F.min("rank").alias("first_rank"), F.first("version_id").alias("version_id"))
    order = W.partitionBy("query_id").orderBy("first_rank")
    return plans.withColumn("plan_rank", F.row_number().over(order)), marked.where("error is not null").select("query_id", "chunk_id", "error")


def expand_parents(plans: DataFrame, chunks: DataFrame, k: int = 5, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """EXP-2: the cut comes before the check, so fewer than k may survive. Returns (views, dropped per query). ``stored`` as
    in ``small_to_big``."""
    if stored:
        chunks = _wanted(chunks, plans.where(F.col("plan_rank") <= k).select(F.col("parent_chunk_id").alias("chunk_id")).distinct())
    parents = chunks.where(F.col("kind") == "parent").select(
        F.col("chunk_id").alias("parent_chunk_id"), F.col("version_id").alias("_v"), "title", "content", F.lit(True).alias("_found"))
    cut = plans.where(F.col("plan_rank") <= k).join(parents, "parent_chunk_id", "left").withColumn(
        "_ok", F.coalesce(F.col("_found") & (F.col("_v") == F.col("version_id")), F.lit(False)))
    dropped = cut.groupBy("query_id").agg(F.count_if(~F.col("_ok")).alias("dropped"))
    order = W.partitionBy("query_id").orderBy("plan_rank")
    return cut.where("_ok").withColumn("rank", F.row_number().over(order)).drop("_v", "_found", "_ok"), dropped


def check_expansion(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """EXP-3: per request the ids that are no child of the version and the parents that are missing or no parent."""
    children = chunks.where((F.col("kind") == "child") & F.col("parent_chunk_id").isNotNull()).select("version_id", "chunk_id", "parent_chunk_id")
    parents = chunks.where(F.col("kind") == "parent").select("version_id", F.col("chunk_id").alias("parent_chunk_id"))
    bad = hits.join(children, ["version_id", "chunk_id"], "left_anti").select("request_id", F.lit("invalid_child").alias("problem"), F.col("chunk_id").alias("id"))
    lost = hits.join(children, ["version_id", "chunk_id"]).join(parents, ["version_id", "parent_chunk_id"], "left_anti").select(
        "request_id", F.lit("missing_parent").alias("problem"), F.col("parent_chunk_id").alias("id"))
    return bad.unionByName(lost).distinct()


def rerank_overlap(queries: DataFrame, parents: DataFrame, top_n: int, tokenizer=None) -> DataFrame:
    """RRK-1: share of the query's tokens found in title and content, content cut to an equal share of the budget."""
    tokenize = tokenizer or bigram_tokenizer()
    asked = queries.select("query_id", F.array_distinct(tokenize(F.col("query"))).alias("_q"))
    counted = parents.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("query_id"))).join(small_side(asked), "query_id")
    budget = F.least(F.lit(1000), F.greatest(F.lit(1), F.floor(8000 / F.col("_n")))).cast("int")
    text = F.concat(F.col("title"), F.lit("\n"), F.substring(F.col("content"), F.lit(1), budget))
    scored = counted.withColumn("_t", tokenize(text)).withColumn("rerank_score", F.when(
        F.size("_q") > 0, F.size(F.array_intersect("_q", "_t")) / F.size("_q")).otherwise(F.lit(0.0))).drop("_q", "_t", "_n")
    order = [F.round("rerank_score", 9).desc(), F.col("rank"), F.col("parent_id")]
    return top_k(scored, ["query_id"], order, top_n, "rerank_rank")


def rerank_apply(parents: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """RRK-2: external scores per parent. A response counts only when it covers the candidates exactly, ranks 1..n and
    never rises; otherwise the original order stays and the query is degraded."""
    got = scores.select("query_id", "parent_id", F.col("score").alias("_s"), F.col("rank").alias("_r"), F.lit(1).alias("_in"))
    joined = parents.join(got, ["query_id", "parent_id"], "full")
    by_rank = W.partitionBy("query_id").orderBy("_r")
    checked = joined.withColumn("_prev", F.lag("_s").over(by_rank)).withColumn("_pos", F.row_number().over(by_rank))
    fine = (
        F.col("_in").isNotNull() & F.col("rank").isNotNull() & F.col("_s").between(0.0, 1.0) & (F.col("_r") == F.col("_pos"))
        & (F.col("_prev").isNull() | (F.col("_prev") >= F.col("_s")))
    )
    verdict = checked.groupBy("query_id").agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("applied"),
                                              F.bool_or(F.col("_in").isNotNull()).alias("_answered"))
    unique = got.dropDuplicates(["query_id", "parent_id"])
    out = parents.join(unique.drop("_in"), ["query_id", "parent_id"], "left").join(verdict, "query_id")
    final = F.when(F.col("applied"), F.col("_r")).otherwise(F.col("rank"))
    kept = top_k(out.withColumn("_o", final), ["query_id"], [F.col("_o"), F.col("parent_id")], top_n, "final_rank")
    return kept.select(
        *parents.columns, "final_rank", F.when(F.col("applied"), F.col("_s")).alias("rerank_score"), "applied", (~F.col("applied")).alias("degraded"),
        F.when(~F.col("applied"), F.when(F.col("_answered"), "invalid_response").otherwise("provider_unavailable")).alias("error_code"))
