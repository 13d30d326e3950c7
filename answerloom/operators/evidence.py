"""Coverage of required entities, retrieval policies, and cited evidence under a character budget.

Every group is one question (bounded by the parents a policy lets through)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions.scale import first_per_key, grouped_list, small_side, top_k
from ..functions.text import clip, fold, is_blank, rstrip, squeeze, strip
from ..session import durable
from .dictionary import alias_list, scan_column

NO_NAMES = "array<string>"


# --- coverage ---------------------------------------------------------------------------------------------------------

def alias_registry(spark: SparkSession, published: DataFrame | None = None, builtin: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Canonical names with their surfaces; a published entry replaces the built-in one of the same name."""
    rows = [(n, list(a)) for n, a in (lex.PRODUCT_ALIASES if builtin is None else builtin).items()]
    base = spark.createDataFrame(rows, "name string, aliases array<string>")
    if published is None:
        return base
    new = published.select(F.col("term").alias("name"), F.array_distinct(F.concat(F.array("term"), "aliases")).alias("aliases"))
    return base.join(new.select("name"), "name", "left_anti").unionByName(new)


def required_entities(queries: DataFrame, registry: Column | None = None) -> DataFrame:
    """COV-1: product entities of the intent, then names found in the question, deduped in order.

    ``queries``: query_id, question, entities array<struct<type, raw_value, normalized_value>>; ``registry`` is an
    array<struct<canonical, surface>> column (the bounded alias list of the question's domain).
    """
    aliases = registry if registry is not None else alias_list(lex.PRODUCT_ALIASES)
    products = F.filter("entities", lambda e: e["type"] == "product")
    named = F.transform(products, lambda e: F.coalesce(F.nullif(e["normalized_value"], F.lit("")), e["raw_value"]))
    names = F.array_distinct(F.concat(named, scan_column(F.col("question"), aliases)))
    rows = queries.withColumn("_aliases", aliases).select("query_id", "_aliases", F.posexplode(names).alias("position", "name"))
    own = F.transform(F.filter("_aliases", lambda a: a["canonical"] == F.col("name")), lambda a: a["surface"])
    return rows.select("query_id", "position", "name", F.when(F.size(own) > 0, own).otherwise(F.array(fold("name"))).alias("aliases"))


def _per_parent(required: DataFrame, parents: DataFrame) -> DataFrame:
    wanted = required.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "name", "aliases"))).alias("_wanted"))
    text = fold(F.concat(F.col("title"), F.lit("\n"), F.col("content")))
    return parents.join(wanted, "query_id").withColumn("_text", text).withColumn("_hit", F.filter(
        "_wanted", lambda e: F.exists(e["aliases"], lambda a: F.contains(F.col("_text"), fold(a))))).drop("_text")


def coverage(queries: DataFrame, required: DataFrame, parents: DataFrame) -> DataFrame:
    """COV-2: covered and missing names in entity order, ratio 1.0 when nothing is required."""
    found = _per_parent(required, parents).select("query_id", F.explode("_hit.name").alias("name")).distinct()
    state = required.join(found.withColumn("_c", F.lit(True)), ["query_id", "name"], "left").groupBy("query_id").agg(
        F.array_compact(grouped_list(F.when(F.col("_c"), F.col("name")), F.col("position"))).alias("covered"),
        F.array_compact(grouped_list(F.when(F.col("_c").isNull(), F.col("name")), F.col("position"))).alias("missing"))
    empty = F.array().cast(NO_NAMES)
    out = queries.select("query_id").join(state, "query_id", "left").select(
        "query_id", F.coalesce("covered", empty).alias("covered"), F.coalesce("missing", empty).alias("missing"))
    n = F.size("covered") + F.size("missing")
    return out.withColumn("ratio", F.when(n == 0, 1.0).otherwise(F.size("covered") / n))


def coverage_order(required: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """COV-3: first covering parent of each entity in entity order, then the rest in rank order."""
    firsts = _per_parent(required, parents).select("query_id", "parent_id", "rank", F.explode("_hit.position").alias("position"))
    lead = firsts.groupBy("query_id", "position").agg(F.min_by("parent_id", "rank").alias("parent_id")).groupBy(
        "query_id", "parent_id").agg(F.min("position").alias("_lead"))
    ordered = parents.join(lead, ["query_id", "parent_id"], "left")
    return top_k(ordered, ["query_id"], [F.col("_lead").asc_nulls_last(), F.col("rank")], k, "final_rank").drop("_lead")


def supplemental_queries(queries: DataFrame, cover: DataFrame, limit: int = 1) -> DataFrame:
    """COV-4: the questions with missing entities, asked again with those names spelled out."""
    again = queries.join(cover.where(F.size("missing") > 0).select("query_id", "missing"), "query_id").where(F.lit(limit > 0))
    text = F.concat(F.col("question"), F.lit(lex.SUPPLEMENT_LINE), F.array_join("missing", "、"))
    return again.withColumn("supplemental_query", text).drop("missing")


def merge_supplement(first: DataFrame, second: DataFrame, kinds: DataFrame, bands: DataFrame) -> DataFrame:
    """COV-4: second-run parents are appended (first view of a parent wins) only if their top score reaches the clarify line.

    ``kinds``: query_id, score_kind, score of the second run.
    """
    good = kinds.join(bands, "score_kind").where(F.col("score") >= F.col("clarify")).select("query_id")
    both = first.withColumn("_run", F.lit(0)).unionByName(second.join(good, "query_id", "left_semi").withColumn("_run", F.lit(1)))
    names = [c for c in first.columns if c not in ("query_id", "parent_id", "rank")]
    kept = both.groupBy("query_id", "parent_id").agg(F.min(F.struct("_run", "rank")).alias("_o"), F.min_by(F.struct(*names), F.struct("_run", "rank")).alias("_v"))
    order = W.partitionBy("query_id").orderBy("_o")
    return kept.withColumn("rank", F.row_number().over(order)).select("query_id", "parent_id", "rank", *[F.col("_v")[c].alias(c) for c in names])


# --- policy -----------------------------------------------------------------------------------------------------------

def score_bands(spark: SparkSession, bands=lex.SCORE_BANDS) -> DataFrame:
    return spark.createDataFrame(list(bands), "score_kind string, answer double, clarify double")


def policy_table(spark: SparkSession, policies=lex.POLICIES) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(policies)]
    return spark.createDataFrame(rows, "policy_position int, policy_id string, version int, policy_domain string, policy_action string")


def select_policy(queries: DataFrame, policies: DataFrame) -> DataFrame:
    """POL-1: (domain, action) in action order, then the domain, then the global policy, else the last one.

    A query asks for each of its keys in order of priority, so policies are found by an equality join of any size: by a broadcast if they
    are few, which is measured, since many queries ask for the same key. What is aggregated by query is one number, place of the wish before
    place of the policy.
    """
    last = policies.agg(F.max_by(F.struct("policy_id", "version"), "policy_position").alias("_last"))
    keys = ["policy_domain", "policy_action"]
    place = F.row_number().over(W.orderBy("policy_position", *keys)).cast("long")
    known = durable(first_per_key(policies, keys, [F.col("policy_position")]).withColumn("_n", place))
    wish = "struct<d:string,a:string,p:int>"
    exact = F.transform("actions", lambda a, i: F.struct(F.col("domain").alias("d"), a.alias("a"), (i + 1).alias("p")).cast(wish))
    own = F.filter(exact, lambda w: w["a"].isNotNull())
    own = F.concat(F.coalesce(own, F.array().cast(f"array<{wish}>")), F.array(F.struct(F.col("domain").alias("d"), F.lit(None).alias("a"), F.lit(1 << 30).alias("p")).cast(wish)))
    anywhere = F.array(F.struct(F.lit(None).alias("d"), F.lit(None).alias("a"), F.lit((1 << 30) + 1).alias("p")).cast(wish))
    asked = queries.select("query_id", F.explode(F.when(F.col("domain").isNull(), anywhere).otherwise(F.concat(own, anywhere))).alias("_w"))
    found = asked.join(small_side(known.select(*keys, "_n")), F.col("_w.d").eqNullSafe(F.col("policy_domain")) & F.col("_w.a").eqNullSafe(F.col("policy_action")), "left")
    base = 1 << 32
    best = found.groupBy("query_id").agg(F.min(F.col("_w.p").cast("long") * F.lit(base) + F.col("_n")).alias("_at")).withColumn("_n", F.col("_at") % base)
    named = best.join(small_side(known.select("_n", F.struct("policy_id", "version").alias("_b"))), "_n", "left")
    chosen = F.coalesce("_b", "_last")
    return named.crossJoin(F.broadcast(last)).where(F.col("_last").isNotNull()).select(  # one row
        "query_id", chosen["policy_id"].alias("policy_id"), chosen["version"].alias("version"))


def score_kind(views: DataFrame) -> DataFrame:
    """POL-2: kind and value of the score that decided the first parent. ``views``: query_id, mode, rank,
    best_score, rerank_applied, rerank_score; queries without parents have one row with a NULL rank."""
    top = views.groupBy("query_id").agg(
        F.min_by(F.struct("mode", "best_score", "rerank_applied", "rerank_score", "rank"), F.coalesce("rank", F.lit(1 << 30))).alias("_t"),
        F.count("rank").alias("evidence_count")).select("query_id", "evidence_count", "_t.*")
    reranked = F.col("rerank_applied") & F.col("rerank_score").isNotNull()
    kind = F.when(F.col("rank").isNull(), F.lit(None)).when(reranked, "rerank").when(F.col("mode") == "vector", "vector_cosine").when(
        F.col("mode") == "bm25", "bm25_okapi").otherwise("hybrid_rrf")
    score = F.when(F.col("rank").isNull(), F.lit(None)).when(reranked, F.col("rerank_score")).otherwise(F.col("best_score"))
    return top.select("query_id", "evidence_count", kind.alias("score_kind"), score.alias("score"))


def decide_quality(scored: DataFrame, bands: DataFrame, minimum: int = 1) -> DataFrame:
    """POL-3: ``scored``: query_id, evidence_count, score_kind, score, missing."""
    j = scored.join(bands, "score_kind", "left")
    reason = (
        F.when((F.col("evidence_count") < minimum) | F.col("score").isNull(), "no_evidence")
        .when(F.size("missing") > 0, "missing_entity_coverage")
        .when(F.col("clarify").isNull() | (F.col("score") < F.col("clarify")), "low_quality")
        .when(F.col("score") < F.col("answer"), "weak_evidence").otherwise("quality_accepted"))
    out = j.withColumn("reason_code", reason)
    decision = F.when(F.col("reason_code").isin("no_evidence", "low_quality"), "refuse").when(
        F.col("reason_code") == "quality_accepted", "answer").otherwise("clarify")
    ask = F.when(F.col("reason_code") == "missing_entity_coverage", F.concat(
        F.lit(lex.UNCOVERED_BEFORE), F.array_join("missing", "、"), F.lit(lex.UNCOVERED_AFTER))).when(
        F.col("reason_code") == "weak_evidence", lex.ASK_WEAK)
    return out.withColumn("decision", decision).withColumn("clarification_question", ask).drop("answer", "clarify")


def combine_domains(decisions: DataFrame) -> DataFrame:
    """POL-4: the strictest decision of a question, the first one on ties."""
    severity = F.when(F.col("decision") == "refuse", 2).when(F.col("decision") == "clarify", 1).otherwise(0)
    value = [c for c in decisions.columns if c != "question_id"]
    return decisions.groupBy("question_id").agg(
        F.max_by(F.struct(*value), F.struct(severity, -F.col("position"))).alias("_d")).select("question_id", "_d.*")


def fallback_reason(routes: DataFrame, status: DataFrame) -> DataFrame:
    """POL-5: why a knowledge question has no retrieval. ``status``: question_id, store_error, failed."""
    j = routes.where(F.col("target") == "knowledge_rag").join(status, "question_id", "left")
    code = (
        F.when(F.size("domains") == 0, "missing_business_domain").when(~F.col("has_decision"), "missing_intent_decision")
        .when(F.col("store_error").isNotNull(), F.col("store_error")).when(F.col("failed"), "knowledge_retrieval_failed"))
    return j.withColumn("error_code", code).where("error_code is not null").select(
        "question_id", "domains", "error_code", F.lit(0).alias("child_hit_count"), F.lit(0).alias("evidence_count"))


# --- evidence ---------------------------------------------------------------------------------------------------------

def excerpt(content: Column | str, n: int = 180) -> Column:
    """EVI-2."""
    text = squeeze(content)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(rstrip(clip(text, n - 1)), F.lit("…")))


def build_evidence(views: DataFrame, max_parents: int = 5, max_chars: int = 2000, max_total: int = 6000) -> DataFrame:
    """EVI-1: parents of all domains, first occurrence wins, numbered E1.. while the character budget lasts.

    ``views``: question_id, domain_position, domain, rank, parent_id, title, content, score, heading_path, page_numbers.
    One fold per question over parents already cut to ``max_chars``.
    """
    cut = views.withColumn("content", clip("content", max_chars))
    value = ["domain", "parent_id", "title", "content", "score", "heading_path", "page_numbers"]
    first = cut.groupBy("question_id", "parent_id").agg(F.min_by(F.struct("domain_position", "rank", *value), F.struct("domain_position", "rank")).alias("_v"))
    lists = first.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("_v.domain_position", "_v.rank", "_v.parent_id", "_v"))).alias("_l"))

    def step(acc: Column, x: Column) -> Column:
        take = F.least(F.length(x["_v"]["content"]), max_total - acc["used"])
        room = (acc["count"] < max_parents) & (take > 0)
        keep = room & ~is_blank(F.substring(x["_v"]["content"], F.lit(1), take))
        return F.struct(
            F.concat(acc["takes"], F.array(F.when(keep, take).otherwise(0))).alias("takes"),
            (acc["used"] + F.when(keep, take).otherwise(0)).alias("used"),
            (acc["count"] + keep.cast("int")).alias("count"))

    start = F.struct(F.array().cast("array<int>").alias("takes"), F.lit(0).alias("used"), F.lit(0).alias("count"))
    taken = lists.withColumn("_takes", F.aggregate("_l", start, step, lambda a: a["takes"]))
    picked = F.filter(F.arrays_zip(F.col("_l").alias("item"), F.col("_takes").alias("take")), lambda z: z["take"] > 0)
    rows = taken.select("question_id", F.posexplode(picked).alias("_p", "_z")).select(
        "question_id", F.concat(F.lit("E"), (F.col("_p") + 1).cast("string")).alias("evidence_id"), (F.col("_p") + 1).alias("evidence_rank"),
        "_z.item._v.*", F.col("_z.take").alias("_take"))
    content = F.substring(F.col("content"), F.lit(1), F.col("_take"))
    path = F.filter(F.transform("heading_path", lambda h: strip(h)), lambda h: F.length(h) > 0)
    pages = F.array_distinct(F.filter("page_numbers", lambda p: p > 0))
    return rows.withColumn("content", content).withColumns({
        "excerpt": excerpt(F.col("content")), "heading_path": path, "page_numbers": pages,
        "section_title": F.when(F.size("heading_path") > 0, F.element_at("heading_path", -1))}).drop("_take", "domain_position", "rank")


EVIDENCE_SCHEMA = "struct<evidence:array<struct<evidence_id:string,document_title:string,business_domain:string,content:string>>>"


def evidence_json(evidence: DataFrame) -> DataFrame:
    """EVI-3: the compact JSON context of a question."""
    item = F.struct("evidence_id", F.col("title").alias("document_title"), F.col("domain").alias("business_domain"), "content")
    return evidence.groupBy("question_id").agg(
        F.to_json(F.struct(grouped_list(item, F.col("evidence_rank")).alias("evidence"))).alias("context_json"))


def parse_evidence(contexts: DataFrame) -> DataFrame:
    """EVI-3 backwards; damaged JSON yields no rows."""
    parsed = F.from_json("context_json", EVIDENCE_SCHEMA)
    rows = contexts.select("question_id", F.explode(parsed["evidence"]).alias("_e")).select("question_id", "_e.*")
    return rows.where(F.rlike("evidence_id", F.lit("^E[1-9][0-9]*$")) & (F.length("content") > 0))


def trace_rollup(views: DataFrame) -> DataFrame:
    """EVI-4: per question domains and failed sources in order, any degraded, rerank flags, summed counts and latency.

    ``views``: question_id, position, domain, failed_sources, degraded, child_hits, rerank_enabled, rerank_applied,
    rerank_candidates, rerank_latency_ms."""
    def in_order(rows: DataFrame, name: str, out: str) -> DataFrame:
        """Names by first place: one row per name meets in the list, not one per view."""
        first = rows.groupBy("question_id", name).agg(F.min("_at").alias("_at"))
        return first.groupBy("question_id").agg(grouped_list(F.col(name), F.col("_at")).alias(out))

    domains = in_order(views.select("question_id", "domain", F.col("position").alias("_at")), "domain", "domains")
    failed = views.select("question_id", "position", F.posexplode("failed_sources").alias("_p", "_s")).select("question_id", "_s", F.struct("position", "_p").alias("_at"))
    sums = views.groupBy("question_id").agg(
        F.bool_or("degraded").alias("degraded"), F.sum("child_hits").alias("child_hits"), F.bool_or("rerank_enabled").alias("rerank_enabled"),
        F.coalesce(F.bool_and(F.when(F.col("rerank_enabled"), F.col("rerank_applied"))), F.lit(False)).alias("rerank_applied"),
        F.sum("rerank_candidates").alias("rerank_candidates"), F.sum(F.coalesce("rerank_latency_ms", F.lit(0.0))).alias("rerank_latency_ms"))
    out = sums.join(domains, "question_id").join(in_order(failed, "_s", "failed_sources"), "question_id", "left")
    return out.withColumn("failed_sources", F.coalesce("failed_sources", F.array().cast(NO_NAMES)))


def attach_grounding(traces: DataFrame, verdicts: DataFrame) -> DataFrame:
    """EVI-5: used ids, verdict and grounding error written back, only where a trace exists."""
    return traces.join(verdicts.select("question_id", "used_evidence_ids", "verdict", "grounding_error_code"), "question_id", "left").withColumn(
        "used_evidence_ids", F.coalesce("used_evidence_ids", F.array().cast(NO_NAMES)))
