"""Audit log analytics. Latest rows come from combining aggregates, so a hot conversation or execution is no bottleneck."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions.scale import last_per_key


def latest_call(calls: DataFrame) -> DataFrame:
    """AUD-1: newest model call per (conversation, request)."""
    return last_per_key(calls, ["conversation_id", "request_id"], [F.col("created_at"), F.col("call_id")])


def usage_totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """AUD-2: tokens over all attempts of a request."""
    sums = calls.groupBy(*keys).agg(
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"))
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def operation_label(calls: DataFrame, base: str = "operation", target: str = "target") -> DataFrame:
    """AUD-3: base:target, or base:routing_error when no route exists."""
    return calls.withColumn("operation", F.concat_ws(":", F.col(base), F.coalesce(F.col(target), F.lit("routing_error"))))


def execution_timeline(steps: DataFrame) -> DataFrame:
    """AUD-4: node-level facts only, oldest first; any payload column is dropped."""
    return steps.select(
        "execution_id", "step", "source", "current_node", "next_nodes", F.array_sort("written_nodes").alias("written_nodes"),
        F.array_sort("failed_nodes").alias("failed_nodes"), "interrupted").orderBy("execution_id", "step")


def _latest_step(steps: DataFrame) -> DataFrame:
    return last_per_key(steps, ["execution_id"], [F.col("step")], keep=["step", "interrupted", "failed_nodes", "status"])


def execution_status(steps: DataFrame) -> DataFrame:
    """AUD-5: interrupted, failed or completed, from the latest step."""
    failed = (F.size("failed_nodes") > 0) | F.coalesce(F.col("status") == "failed", F.lit(False))
    return _latest_step(steps).withColumn("execution_status", F.when(F.col("interrupted"), "interrupted").when(failed, "failed").otherwise("completed"))


def recovery_advice(steps: DataFrame, codes: DataFrame, retryable=lex.RETRYABLE_CODES) -> DataFrame:
    """AUD-6. ``codes``: execution_id, error_code of its newest audit row."""
    j = _latest_step(steps).join(codes, "execution_id", "left")
    action = (
        F.when(F.col("interrupted"), "resume_review")
        .when((F.size("failed_nodes") > 0) & F.coalesce(F.col("error_code").isin(*retryable), F.lit(False)), "retry_checkpoint")
        .when(F.size("failed_nodes") > 0, "operator_inspect").when(F.col("status") == "failed", "correct_input").otherwise("none"))
    return j.withColumn("action", action).withColumn("retryable", F.col("action") == "retry_checkpoint")


def review_queue(events: DataFrame) -> DataFrame:
    """AUD-7: executions whose last review event is pending, oldest first."""
    state = events.groupBy("execution_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.min("ts").alias("created_at"))
    return state.where(F.col("status") == "pending").orderBy("created_at", "execution_id")
