"""Evaluation of retrieval, policy, chunking, intents, answers and verifiers. Case rows in, case rows or one metric row out."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions.scale import exact_percentiles
from ..functions.text import fold, ratio
from ..session import durable


def _mean(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def _share(flag: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("double")), F.lit(0.0))


LATENCIES = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95}


def _with_latencies(metrics: DataFrame, rows: DataFrame, by: list[str] | None, value: str) -> DataFrame:
    """Nearest-rank percentiles beside the other metrics; 0 where no latency is given."""
    keys = by or []
    ranks = exact_percentiles(rows, keys, value, LATENCIES)
    aliased = ranks.select(*[F.col(k).alias(f"_p_{k}") for k in keys], *LATENCIES)
    same = [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in keys] or [F.lit(True)]
    last = [c for c in metrics.columns if c in ("positive_cases", "negative_cases")]
    return metrics.join(aliased, same, "left").select(
        *[c for c in metrics.columns if c not in last], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in LATENCIES], *last)


def retrieval_cases(cases: DataFrame, parents: DataFrame) -> DataFrame:
    """EVL-1. ``cases``: case_id, expect_empty, relevant array<struct<relevance_id, document_title, markers>>, latency_ms,
    execution_error, rerank_degraded; ``parents``: case_id, rank, title, content (the top five of a case)."""
    items = cases.where(~F.col("expect_empty")).select("case_id", F.explode("relevant").alias("_r")).select("case_id", "_r.*")
    text = fold("content")
    hit = (F.col("document_title").isNull() | (F.col("document_title") == F.col("title"))) & F.forall(
        "markers", lambda m: F.contains(F.col("_text"), fold(m)))
    ranks = items.join(parents.withColumn("_text", text), "case_id").where(hit).groupBy("case_id", "relevance_id").agg(F.min("rank").alias("rank"))
    scored = items.join(ranks, ["case_id", "relevance_id"], "left").groupBy("case_id").agg(
        *[F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_at_{k}") for k in (1, 3, 5)],
        F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))
    shown = parents.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    j = cases.join(scored, "case_id", "left").join(shown, "case_id", "left")
    failed = F.coalesce("execution_error", F.lit(False))
    zero = lambda c: F.when(failed, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    out = j.withColumns({c: zero(c) for c in ("recall_at_1", "recall_at_3", "recall_at_5", "reciprocal_rank")})
    failure = F.when(failed, "execution_error").when(F.col("expect_empty"), F.when(F.col("_n") > 0, "unexpected_parent")).when(
        F.col("recall_at_5") < 1.0, "relevant_parent_missed")
    return out.withColumn("failure", failure).drop("_n", "relevant")


def retrieval_metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EVL-2: macro means over positives, negative accuracy, nearest-rank latency percentiles; an empty mean is 0."""
    pos, neg = ~F.col("expect_empty"), F.col("expect_empty")
    ran = scored.withColumn("_ok_latency", F.when(F.coalesce(F.col("failure") != "execution_error", F.lit(True)), F.col("latency_ms")))
    means = ran.groupBy(*(by or [])).agg(
        *[_mean(F.when(pos, F.col(f"recall_at_{k}"))).alias(f"recall_at_{k}") for k in (1, 3, 5)], _mean(F.when(pos, F.col("reciprocal_rank"))).alias("mrr_at_5"),
        _mean(F.when(neg, F.col("failure").isNull().cast("double"))).alias("negative_accuracy"), _share(F.col("failure") == "execution_error").alias("execution_failure_rate"),
        _share(F.col("rerank_degraded")).alias("rerank_degradation_rate"), F.count_if(pos).alias("positive_cases"), F.count_if(neg).alias("negative_cases"))
    return _with_latencies(means, ran, by, "_ok_latency")


def policy_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EVL-3. ``results``: expect_empty, decision, coverage_ratio, supplemental, latency_ms, error_code."""
    ok = F.col("error_code").isNull()
    want = F.when(F.col("expect_empty"), "refuse").otherwise("answer")
    passed = F.coalesce(ok & (F.col("decision") == want), F.lit(False))
    answered = F.coalesce(F.col("decision") == "answer", F.lit(False))
    r = results.withColumns({"_passed": passed, "_answered": answered, "_lat": F.when(ok, F.col("latency_ms"))})
    neg = F.col("expect_empty")
    means = r.groupBy(*(by or [])).agg(
        _share(F.col("_passed")).alias("decision_accuracy"), _mean(F.when(F.col("_answered"), F.col("_passed").cast("double"))).alias("answer_precision"),
        _mean(F.when(neg, F.col("_answered").cast("double"))).alias("false_answer_rate"),
        _mean(F.when(neg, F.coalesce(F.col("decision") == "refuse", F.lit(False)).cast("double"))).alias("refusal_recall"),
        _mean(F.when(ok, F.col("coverage_ratio"))).alias("mean_entity_coverage"), _mean(F.when(ok, F.col("supplemental").cast("double"))).alias("supplemental_query_rate"),
        _share(~ok).alias("execution_failure_rate"))
    return _with_latencies(means, r, by, "_lat")


def chunk_cases(cases: DataFrame, chunks: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """EVL-4. ``cases``: mode, case_id, ordinals, child_terms, parent_terms array<array<string>>, strategies, min/max_parents,
    min/max_children; ``chunks``: mode, case_id and draft columns; ``errors``: mode, case_id of failed chunking."""
    key = ["mode", "case_id"]
    # Written once: chunks are read five times below and cases four times, which would chunk every text as often.
    chunks = durable(chunks.select(*key, "kind", "strategy", "content", "local_id", "parent_local_id", "source_block_ordinal"))
    cases = durable(cases)
    size = chunks.groupBy(*key).agg(
        F.count_if(F.col("kind") == "parent").alias("parent_count"), F.count_if(F.col("kind") == "child").alias("child_count"),
        F.collect_set(F.when(F.col("kind") == "child", F.col("strategy"))).alias("_strategies"))

    def groups(column: str, kind: str) -> DataFrame:
        wanted = cases.select(*key, F.posexplode(column).alias("_g", "_terms")).withColumn(
            "_longest", F.coalesce(F.array_max(F.transform("_terms", F.length)), F.lit(0)))
        body = chunks.where(F.col("kind") == kind).select(*[F.col(c).alias(f"_c_{c}") for c in key], "content")
        # Long terms meet only chunks that can hold them, so no pair is larger than twice its chunk.
        same = [F.col(c) == F.col(f"_c_{c}") for c in key]
        met = wanted.join(body, [*same, F.length("content") >= F.col("_longest")], "left").groupBy(*key, "_g").agg(F.bool_or(F.coalesce(
            F.forall("_terms", lambda t: F.contains(F.col("content"), t)), F.lit(False))).alias("_met"))
        return met.groupBy(*key).agg(F.count(F.lit(1)).alias(f"{kind}_total"), F.count_if("_met").alias(f"{kind}_passed"))

    parents = chunks.where(F.col("kind") == "parent").select(*key, F.col("local_id").alias("parent_local_id"), F.lit(True).alias("_has"))
    linked = chunks.join(parents, [*key, "parent_local_id"], "left").join(cases.select(*key, "ordinals"), key)
    valid = F.array_contains("ordinals", F.col("source_block_ordinal")) & F.when(
        F.col("kind") == "parent", F.col("parent_local_id").isNull()).otherwise(F.coalesce("_has", F.lit(False)))
    traced = linked.groupBy(*key).agg(F.count_if(valid).alias("traceable"))
    j = cases.join(size, key, "left").join(groups("child_terms", "child"), key, "left").join(groups("parent_terms", "parent"), key, "left").join(traced, key, "left")
    j = j.fillna(0, ["parent_count", "child_count", "child_total", "child_passed", "parent_total", "parent_passed", "traceable"])
    have = F.coalesce("_strategies", F.array().cast("array<string>"))
    j = j.withColumn("strategy_total", F.size("strategies")).withColumn("strategy_passed", F.size(F.filter("strategies", lambda s: F.array_contains(have, s))))
    broken = errors.select(*key).distinct().withColumn("_broken", F.lit(True)) if errors is not None else None
    j = j.join(broken, key, "left") if broken is not None else j.withColumn("_broken", F.lit(None).cast("boolean"))
    dead = F.coalesce("_broken", F.lit(False))
    for c in ("parent_count", "child_count", "child_passed", "parent_passed", "strategy_passed", "traceable"):
        j = j.withColumn(c, F.when(dead, 0).otherwise(F.col(c)))
    out_of_range = lambda n, lo, hi: (F.col(n) < F.col(lo)) | F.coalesce(F.col(n) > F.col(hi), F.lit(False))
    failures = F.when(dead, F.array(F.lit("strategy_execution"))).otherwise(F.array_compact(F.array(
        F.when(F.col("child_passed") < F.col("child_total"), "child_semantic_unit"), F.when(F.col("parent_passed") < F.col("parent_total"), "parent_context"),
        F.when(F.col("strategy_passed") < F.col("strategy_total"), "strategy_selection"),
        F.when(F.col("traceable") < F.col("parent_count") + F.col("child_count"), "parent_child_integrity"),
        F.when(out_of_range("parent_count", "min_parents", "max_parents") | out_of_range("child_count", "min_children", "max_children"), "chunk_count"))))
    return j.select(*key, "parent_count", "child_count", "child_total", "child_passed", "parent_total", "parent_passed", "strategy_total", "strategy_passed",
                    "traceable", failures.alias("failures"))


def chunk_metrics(scored: DataFrame) -> DataFrame:
    """EVL-5: micro ratios per mode; nothing expected counts as 1.0."""
    def micro(a: str, b: str) -> Column:
        return ratio(F.sum(a), F.sum(b), 1.0)

    sized = scored.withColumn("_chunks", F.col("parent_count") + F.col("child_count"))
    return sized.groupBy("mode").agg(
        _share(F.size("failures") == 0).alias("case_pass_rate"), micro("child_passed", "child_total").alias("child_semantic_recall"),
        micro("parent_passed", "parent_total").alias("parent_context_recall"), micro("strategy_passed", "strategy_total").alias("strategy_match_rate"),
        micro("traceable", "_chunks").alias("traceability_rate"), F.avg("parent_count").alias("average_parent_count"), F.avg("child_count").alias("average_child_count"))


def _intent_keys(c: str) -> Column:
    return F.array_distinct(F.transform(c, lambda i: F.concat_ws("/", i["domain"], i["action"])))


def intent_cases(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """EVL-6; a case without a prediction fails as ``structured_output``. ``gold``: case_id, route, intents, risk, needs_clarification; ``predictions``: case_id, decision, rule_id, error_code."""
    want = gold.select("case_id", F.col("route").alias("gold_route"), _intent_keys("intents").alias("gold_keys"), F.col("risk").alias("gold_risk"),
                       F.col("needs_clarification").alias("gold_clarification"))
    j = want.join(predictions.select("case_id", "decision", "rule_id", "error_code"), "case_id", "left")
    d = F.col("decision")
    none = F.array().cast("array<string>")
    j = j.withColumn("pred_keys", F.when(d.isNotNull(), _intent_keys("decision.intents")).otherwise(none))
    other_keys = (F.size(F.array_except("gold_keys", "pred_keys")) > 0) | (F.size(F.array_except("pred_keys", "gold_keys")) > 0)
    wrong_route = d["route"] != F.col("gold_route")
    failures = F.when(d.isNull(), F.array(F.lit("structured_output"))).otherwise(F.array_compact(F.array(
        F.when(wrong_route, "route"), F.when(other_keys, "sub_intent"), F.when(d["risk"] != F.col("gold_risk"), "risk"),
        F.when(d["needs_clarification"] != F.col("gold_clarification"), "clarification"),
        F.when(F.col("rule_id").isNotNull() & (wrong_route | other_keys), "rule_misroute"))))
    return j.withColumn("failures", failures)


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0)
    return p, r, ratio(2 * tp, 2 * tp + fp + fn, 0.0)


def intent_route_metrics(scored: DataFrame, routes=lex.ROUTES) -> DataFrame:
    """EVL-7: precision, recall, F1 and support of every route; one pass, the routes are columns until the end."""
    got = F.coalesce(F.col("decision.route"), F.lit(""))
    cells = []
    for r in routes:
        g, p = F.col("gold_route") == r, got == r
        cells.append(F.struct(F.lit(r).alias("route"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(g).alias("support")))
    rows = scored.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return rows.select("route", p.alias("precision"), r.alias("recall"), f.alias("f1"), "support")


def intent_metrics(scored: DataFrame, routes=lex.ROUTES) -> DataFrame:
    """EVL-7: the whole metric row from one aggregation of case rows (denominator 0 gives 0)."""
    d = F.col("decision")
    got = F.coalesce(d["route"], F.lit(""))
    valid = d.isNotNull()
    same = (F.size(F.array_except("gold_keys", "pred_keys")) == 0) & (F.size(F.array_except("pred_keys", "gold_keys")) == 0)
    supported, high = F.col("gold_route") == "supported", F.col("gold_risk").isin("high", "critical")
    ruled = F.col("rule_id").isNotNull()
    asks = F.coalesce(d["needs_clarification"], F.lit(False))
    count = F.count_if
    route_cells = []
    for i, r in enumerate(routes):
        g, p = F.col("gold_route") == r, got == r
        route_cells += [count(g & p).alias(f"_tp{i}"), count(~g & p).alias(f"_fp{i}"), count(g & ~p).alias(f"_fn{i}")]
    sums = scored.agg(
        *route_cells, F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.sum(F.size(F.array_intersect("gold_keys", "pred_keys"))), F.lit(0)).alias("_tp"), F.coalesce(F.sum(F.size(F.array_except("pred_keys", "gold_keys"))), F.lit(0)).alias("_fp"),
        F.coalesce(F.sum(F.size(F.array_except("gold_keys", "pred_keys"))), F.lit(0)).alias("_fn"), count(supported).alias("_sup"), count(supported & same).alias("_exact"),
        count(ruled).alias("_rules"), count(ruled & valid & (got == F.col("gold_route")) & same).alias("_rules_ok"), count(supported & (got != "supported")).alias("_rejected"),
        count(high).alias("_high"), count(high & ~F.coalesce(d["risk"].isin("high", "critical"), F.lit(False))).alias("_missed"),
        count(F.col("gold_clarification") & asks).alias("_ctp"), count(~F.col("gold_clarification") & asks).alias("_cfp"), count(F.col("gold_clarification") & ~asks).alias("_cfn"), count(~valid).alias("_invalid"))
    f1s = [_prf(F.col(f"_tp{i}"), F.col(f"_fp{i}"), F.col(f"_fn{i}"))[2] for i in range(len(routes))]
    macro = sum(f1s[1:], f1s[0]) / len(routes)
    c = F.col
    cp, cr, cf = _prf(c("_ctp"), c("_cfp"), c("_cfn"))
    return sums.select(
        macro.alias("route_macro_f1"), _prf(c("_tp"), c("_fp"), c("_fn"))[2].alias("sub_intent_micro_f1"), ratio(c("_exact"), c("_sup"), 0.0).alias("sub_intent_exact_match"),
        ratio(c("_rules"), c("_n"), 0.0).alias("rule_coverage"), ratio(c("_rules_ok"), c("_rules"), 0.0).alias("rule_precision"),
        ratio(c("_rejected"), c("_sup"), 0.0).alias("false_rejection_rate"), ratio(c("_missed"), c("_high"), 0.0).alias("high_risk_miss_rate"),
        cp.alias("clarification_precision"), cr.alias("clarification_recall"), cf.alias("clarification_f1"), ratio(c("_invalid"), c("_n"), 0.0).alias("structured_failure_rate"))


def rag_cases(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """EVL-8. ``cases``: case_id, expected_decision, decision, answer (NULL when none), used_ids, allowed_ids, expected_ids,
    required_terms, retrieval_error, generation_error, judge_uncertain; ``claims``: answer_id (= case_id), status."""
    support = claims.groupBy(F.col("answer_id").alias("case_id")).agg(F.avg((F.col("status") == "supported").cast("double")).alias("_f"))
    j = cases.join(support, "case_id", "left")
    has = F.col("answer").isNotNull()
    used = F.col("used_ids")
    size = lambda c: F.size(c)
    said = F.filter("required_terms", lambda t: F.contains(F.col("_text"), fold(t)))
    j = j.withColumn("_text", fold(F.coalesce("answer", F.lit("")))).withColumns({
        "faithfulness": F.when(has, F.coalesce("_f", F.lit(0.0))).otherwise(1.0),
        "citation_precision": F.when(has, ratio(size(F.array_intersect(used, "allowed_ids")), size(F.array_distinct(used)), 0.0)).otherwise(1.0),
        "citation_recall": F.when(has, ratio(size(F.array_intersect(used, "expected_ids")), size(F.array_distinct("expected_ids")), 1.0)).otherwise(1.0),
        "answer_relevancy": F.when(has, ratio(size(said), size("required_terms"), 1.0)).otherwise(1.0)})
    invented = has & ((size("allowed_ids") == 0) | (size(F.array_except(used, "allowed_ids")) > 0))
    cites_badly = (F.col("citation_precision") < 1) | (F.col("citation_recall") < 1)
    vague = F.col("answer_relevancy") < 1
    failures = F.array_distinct(F.array_compact(F.array(
        F.when(F.col("decision") != F.col("expected_decision"), "decision_mismatch"), F.when(F.col("retrieval_error").isNotNull(), "retrieval_failure"),
        F.when(F.col("generation_error").isNotNull(), "generation_failure"), F.when(F.col("judge_uncertain"), "judge_uncertain"), F.when(invented, "citation_failure"),
        F.when(F.col("faithfulness") < 1, "faithfulness_failure"), F.when(cites_badly, "citation_failure"), F.when(vague, "answer_relevancy_failure"), F.when(vague, "incomplete_answer"))))
    return j.select("case_id", "expected_decision", "decision", "faithfulness", "answer_relevancy", "citation_precision", "citation_recall", failures.alias("failures"))


def rag_metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EVL-9."""
    return scored.groupBy(*(by or [])).agg(
        _share(F.col("decision") == F.col("expected_decision")).alias("decision_accuracy"),
        *[F.avg(c).alias(c) for c in ("faithfulness", "answer_relevancy", "citation_precision", "citation_recall")],
        _share(F.size("failures") == 0).alias("pass_rate"), F.count(F.lit(1)).alias("case_count"))


def verifier_gate(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EVL-10. ``rows``: expected, actual, latency_ms. Gate: accuracy >= .90, nothing unsafe accepted, conflict recall >= .90."""
    conflict = F.col("expected") == "conflict"
    m = rows.groupBy(*(by or [])).agg(
        _share(F.col("expected") == F.col("actual")).alias("accuracy"), F.count_if((F.col("expected") != "supported") & (F.col("actual") == "supported")).alias("unsafe_acceptances"),
        ratio(F.count_if(conflict & (F.col("actual") == "conflict")), F.count_if(conflict), 1.0).alias("conflict_recall"), F.avg("latency_ms").alias("mean_latency_ms"))
    return m.withColumn("accepted", (F.col("accuracy") >= 0.90) & (F.col("unsafe_acceptances") == 0) & (F.col("conflict_recall") >= 0.90))


def compare_runs(metrics: DataFrame, run: str, baseline: str) -> DataFrame:
    """EVL-11: long (run, metric, value, delta to the baseline run); one row per run and metric."""
    names = [c for c, t in metrics.dtypes if c != run and t in ("double", "bigint", "int")]
    rows = metrics.select(run, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("_m")).select(run, "_m.*")
    base = rows.where(F.col(run) == baseline).select("metric", F.col("value").alias("_b"))
    return rows.join(base, "metric", "left").select(run, "metric", "value", (F.col("value") - F.col("_b")).alias("delta"))


def run_summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """EVL-12: how many decisions were valid, made by rules or the model, or failed, per run and gold route."""
    valid, ruled = F.col("decision").isNotNull(), F.col("rule_id").isNotNull()
    return scored.groupBy(*(by or []), "gold_route").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(valid).alias("valid"), F.count_if(ruled).alias("by_rule"), F.count_if(valid & ~ruled).alias("by_model"), F.count_if(~valid).alias("failed"))


def failed_cases(scored: DataFrame) -> DataFrame:
    """EVL-12: failed cases with their categories and the predicted route or error."""
    return scored.where(F.size("failures") > 0).select(
        "case_id", F.array_join("failures", ", ").alias("failures"), F.coalesce("decision.route", F.concat(F.lit("error:"), "error_code")).alias("predicted_route"),
        F.coalesce("rule_id", F.lit("-")).alias("rule_id"))


def failure_counts(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scored.select(*(by or []), F.explode("failures").alias("category")).groupBy(*(by or []), "category").agg(F.count(F.lit(1)).alias("cases"))


