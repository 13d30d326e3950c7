"""Registered queries: fusion, expansion, rerank, coverage, policy, evidence. Line items stand for hits (supplier = query,
part = chunk, ten parts share a parent)."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scale import top_k
from ..operators import evidence as ev
from ..operators import ranking as rk
from .flagship import grounded_retrieval
from .registry import query, table

DEPTH = 40
HITS = f"""rh AS (SELECT * FROM (SELECT CAST(l_suppkey AS BIGINT) AS query_id, CASE WHEN l_linestatus = 'O' THEN 'vector' ELSE 'bm25' END AS source, l_partkey AS part, l_extendedprice AS score,
   row_number() OVER (PARTITION BY l_suppkey, l_linestatus = 'O' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= {DEPTH}),
fh AS (SELECT query_id, part, source, min(rank) AS rank, arg_min(score, rank) AS score FROM rh GROUP BY ALL),
fs AS (SELECT query_id, part, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS best, string_agg(source || '#' || rank, ',' ORDER BY source) AS evidence FROM fh GROUP BY ALL),
fused AS (SELECT query_id, 'c' || part AS chunk_id, part, score, best, evidence, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, 'c' || part) AS rank FROM fs)"""


def hits(spark, d):
    w = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    items = table(spark, d, "lineitem").withColumn("query_id", F.col("l_suppkey").cast("long")).withColumn(
        "source", F.when(F.col("l_linestatus") == "O", "vector").otherwise("bm25"))
    part = F.col("l_partkey")
    return top_k(items, ["query_id", "source"], w, DEPTH).select(
        "query_id", "source", "rank", F.concat(F.lit("c"), part.cast("string")).alias("chunk_id"), F.col("l_extendedprice").alias("score"),
        (part % 97).alias("document_id"), (part % 89).alias("version_id"), F.lit("ix").alias("index_version_id"))


@query("rrf", f"WITH {HITS} SELECT query_id, chunk_id, rank, score, evidence FROM fused")
def q_rrf(spark, d):
    ev_text = F.array_join(F.transform("evidence", lambda e: F.concat_ws("#", e["source"], e["rank"].cast("string"))), ",")
    return rk.rrf(hits(spark, d)).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score", ev_text.alias("evidence"))


HYBRID = f"""{HITS}, st AS (SELECT CAST(s_suppkey AS BIGINT) AS query_id, s_suppkey % 4 IN (1, 3) AS vf, s_suppkey % 4 IN (2, 3) AS bf FROM supplier),
hr AS (SELECT f.query_id, chunk_id, rank, score FROM (SELECT fs2.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, chunk_id) AS rank FROM
    (SELECT query_id, 'c' || part AS chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) AS best FROM (SELECT query_id, part, source, min(rank) AS rank FROM rh WHERE rank <= 30 GROUP BY ALL) GROUP BY ALL) fs2) f JOIN st USING (query_id) WHERE NOT vf AND NOT bf
  UNION ALL SELECT r.query_id, 'c' || part, rank, score FROM rh r JOIN st USING (query_id) WHERE rank <= 30 AND ((vf AND NOT bf AND source = 'bm25') OR (bf AND NOT vf AND source = 'vector')))"""


def status(spark, d):
    m = F.col("s_suppkey") % 4
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("query_id"), m.isin(1, 3).alias("vector_failed"), m.isin(2, 3).alias("bm25_failed"))


@query("hybrid_recall", f"WITH {HYBRID} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hr")
def q_hybrid(spark, d):
    out, _ = rk.hybrid_recall(hits(spark, d), status(spark, d), 15)
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("hybrid_outcome", f"""WITH {HYBRID} SELECT query_id, vf OR bf AS degraded, array_to_string(list_filter([CASE WHEN vf THEN 'vector' END, CASE WHEN bf THEN 'bm25' END], lambda x: x IS NOT NULL), ',') AS failed_sources,
 CASE WHEN vf AND bf THEN 'SERVICE_NOT_READY' ELSE '' END AS error_code FROM st""")
def q_hybrid_outcome(spark, d):
    out = rk.hybrid_recall(hits(spark, d), status(spark, d), 15)[1]
    return out.select("query_id", "degraded", F.array_join("failed_sources", ",").alias("failed_sources"), F.coalesce("error_code", F.lit("")).alias("error_code"))


def parts_as_chunks(spark, d):
    key = F.col("p_partkey")
    group = F.floor(key / 10).cast("long")
    parts = table(spark, d, "part")
    child = parts.select(
        F.concat(F.lit("c"), key.cast("string")).alias("chunk_id"), F.lit("child").alias("kind"),
        F.when(key % 13 != 0, F.concat(F.lit("p"), group.cast("string"))).alias("parent_chunk_id"), (group % 89).alias("version_id"),
        F.col("p_name").alias("title"), F.col("p_type").alias("content"))
    parent = parts.groupBy(group.alias("g")).agg(F.min("p_name").alias("title"), F.concat_ws(" ", F.array_sort(F.collect_list(F.concat_ws(" ", "p_name", "p_brand", "p_type")))).alias("content"))
    return child.unionByName(parent.select(
        F.concat(F.lit("p"), F.col("g").cast("string")).alias("chunk_id"), F.when(F.col("g") % 11 == 0, "child").otherwise("parent").alias("kind"), F.lit(None).cast("string").alias("parent_chunk_id"),
        F.when(F.col("g") % 7 == 0, -1).otherwise(F.col("g") % 89).alias("version_id"), "title", "content"))


PLANS = f"""{HITS}, lk AS (SELECT query_id, chunk_id, part, part // 10 AS g, rank, score FROM fused),
plans AS (SELECT query_id, g, string_agg(chunk_id, ',' ORDER BY rank) AS child_ids, max(score) AS best_score, min(rank) AS first_rank, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS plan_rank
  FROM lk WHERE part % 13 <> 0 GROUP BY query_id, g),
pc AS (SELECT p_partkey // 10 AS g, min(p_name) AS title, string_agg(p_name || ' ' || p_brand || ' ' || p_type, ' ' ORDER BY p_name || ' ' || p_brand || ' ' || p_type) AS content FROM part GROUP BY 1),
cut AS (SELECT p.*, pc.title, pc.content, p.g % 11 <> 0 AND p.g % 7 <> 0 AS ok FROM plans p JOIN pc USING (g) WHERE plan_rank <= 5),
views AS (SELECT *, 'p' || g AS parent_id, row_number() OVER (PARTITION BY query_id ORDER BY plan_rank) AS rank FROM cut WHERE ok)"""


@query("small_to_big", f"WITH {PLANS} SELECT query_id, 'p' || g AS parent_chunk_id, child_ids, round(best_score, 6) AS best_score, first_rank, plan_rank FROM plans")
def q_small_to_big(spark, d):
    plans, _ = rk.small_to_big(rk.rrf(hits(spark, d)), parts_as_chunks(spark, d))
    return plans.select("query_id", "parent_chunk_id", F.array_join("child_ids", ",").alias("child_ids"), F.round("best_score", 6).alias("best_score"),
                        F.col("first_rank").cast("long").alias("first_rank"), F.col("plan_rank").cast("long").alias("plan_rank"))


@query("small_to_big_errors", f"WITH {PLANS} SELECT query_id, chunk_id, 'missing_parent' AS error FROM lk WHERE part % 13 = 0")
def q_small_to_big_errors(spark, d):
    return rk.small_to_big(rk.rrf(hits(spark, d)), parts_as_chunks(spark, d))[1]


def views(spark, d):
    chunks = parts_as_chunks(spark, d)
    plans, _ = rk.small_to_big(rk.rrf(hits(spark, d)), chunks)
    return rk.expand_parents(plans, chunks, 5)


@query("expand_parents", f"WITH {PLANS} SELECT query_id, parent_id, rank, title FROM views")
def q_expand(spark, d):
    return views(spark, d)[0].select("query_id", F.col("parent_chunk_id").alias("parent_id"), F.col("rank").cast("long").alias("rank"), "title")


@query("expand_parents_dropped", f"WITH {PLANS} SELECT query_id, count(*) FILTER (NOT ok) AS dropped FROM cut GROUP BY query_id")
def q_expand_dropped(spark, d):
    return views(spark, d)[1]


@query("check_expansion", f"""WITH {HITS} SELECT DISTINCT query_id AS request_id, CASE WHEN part % 13 = 0 THEN 'invalid_child' ELSE 'missing_parent' END AS problem, CASE WHEN part % 13 = 0 THEN 'c' || part ELSE 'p' || (part // 10) END AS id
 FROM rh WHERE part % 13 = 0 OR (part // 10) % 11 = 0 OR (part // 10) % 7 = 0""")
def q_check_expansion(spark, d):
    asked = hits(spark, d).select(F.col("query_id").alias("request_id"), "chunk_id", (F.floor(F.substring("chunk_id", 2, 20).cast("long") / 10).cast("long") % 89).alias("version_id"))
    return rk.check_expansion(asked, parts_as_chunks(spark, d))


def ask(spark, d):
    words = F.split(F.lit("small ring red widget blue bolt hot gear gizmo economy"), " ")
    key = F.col("s_suppkey")
    pick = lambda n: F.element_at(words, (key * n % 10 + 1).cast("int"))
    return table(spark, d, "supplier").select(key.cast("long").alias("query_id"), F.concat_ws(" ", pick(1), pick(3), pick(7), F.lit("zzz")).alias("query"))


ASK = """aw AS (SELECT string_split('small ring red widget blue bolt hot gear gizmo economy', ' ') AS w),
ask AS (SELECT CAST(s_suppkey AS BIGINT) AS query_id, w[s_suppkey % 10 + 1] || ' ' || w[s_suppkey * 3 % 10 + 1] || ' ' || w[s_suppkey * 7 % 10 + 1] || ' zzz' AS query FROM supplier, aw)"""


def parents(spark, d):
    return views(spark, d)[0].select("query_id", F.col("parent_chunk_id").alias("parent_id"), "rank", "title", "content", "best_score")


RERANK = rf"""{PLANS}, {ASK}, rs AS (SELECT v.query_id, parent_id, rank, list_distinct(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS q,
   regexp_extract_all(lower(title || chr(10) || substr(content, 1, least(1000, 8000 // count(*) OVER (PARTITION BY v.query_id)))), '[a-z0-9_]+') AS t FROM views v JOIN ask USING (query_id)),
rx AS (SELECT query_id, parent_id, rank, len(list_intersect(q, t)) / len(q) AS s FROM rs)"""


@query("rerank_overlap", f"""WITH {RERANK} SELECT * FROM (SELECT query_id, parent_id, round(s, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, rank, parent_id) AS rerank_rank FROM rx) WHERE rerank_rank <= 3""")
def q_rerank_overlap(spark, d):
    out = rk.rerank_overlap(ask(spark, d), parents(spark, d), 3)
    return out.select("query_id", "parent_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("rerank_rank").cast("long").alias("rerank_rank"))


@query("rerank_apply", f"""WITH {PLANS}, c AS (SELECT query_id, parent_id, rank, count(*) OVER (PARTITION BY query_id) AS n, query_id % 3 = 0 AS good FROM views)
SELECT * FROM (SELECT query_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN good THEN n - rank + 1 ELSE rank END) AS final_rank, CASE WHEN good THEN round(1.0 / (n - rank + 1), 6) ELSE -1 END AS rerank_score,
 NOT good AS degraded, CASE WHEN good THEN '' WHEN query_id % 3 = 1 THEN 'invalid_response' ELSE 'provider_unavailable' END AS error_code FROM c) WHERE final_rank <= 3""")
def q_rerank_apply(spark, d):
    base = parents(spark, d)
    n = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    turned = base.withColumn("_n", n).withColumn("new", F.col("_n") - F.col("rank") + 1)
    scores = turned.where("query_id % 3 <> 2").select("query_id", "parent_id", F.col("new").alias("rank"),
        F.when(F.col("query_id") % 3 == 0, 1.0 / F.col("new")).otherwise(1.0 + F.col("new")).alias("score"))
    out = rk.rerank_apply(base, scores, 3)
    return out.select("query_id", "parent_id", F.col("final_rank").cast("long").alias("final_rank"), F.round(F.coalesce("rerank_score", F.lit(-1.0)), 6).alias("rerank_score"),
                      "degraded", F.coalesce("error_code", F.lit("")).alias("error_code"))


# --- coverage ---------------------------------------------------------------------------------------------------------

SURFACES = {"ring": ("ring", "red"), "widget": ("widget",), "bolt": ("bolt", "brand#1"), "gear": ("gear", "gizmo"), "zzz": ("zzz",)}


def required(spark, d):
    none = F.expr("array(named_struct('type', 'product', 'raw_value', 'blue', 'normalized_value', ''))")
    q = ask(spark, d).withColumnRenamed("query", "question").withColumn("entities", F.when(F.col("query_id") % 2 == 0, none).otherwise(F.slice(none, 1, 0)))
    return q, ev.required_entities(q, ev.alias_list(SURFACES))


REQ = f"""{PLANS}, {ASK}, sf(canonical, surface) AS (VALUES ('ring','ring'), ('ring','red'), ('widget','widget'), ('bolt','bolt'), ('bolt','brand#1'), ('gear','gear'), ('gear','gizmo'), ('zzz','zzz')),
rn AS (SELECT query_id, canonical AS name, min(position(surface IN query)) AS p FROM ask JOIN sf ON contains(query, surface) GROUP BY ALL
   UNION ALL SELECT query_id, 'blue', 0 FROM ask WHERE query_id % 2 = 0),
req AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS position FROM rn),
al AS (SELECT canonical AS name, surface FROM sf UNION ALL SELECT 'blue', 'blue'),
cv AS (SELECT DISTINCT r.query_id, r.name, r.position, v.parent_id, v.rank FROM req r JOIN al USING (name) JOIN views v ON v.query_id = r.query_id AND contains(lower(v.title || chr(10) || v.content), surface))"""


@query("required_entities", f"WITH {REQ} SELECT query_id, CAST(position AS INT) AS position, name FROM req")
def q_required(spark, d):
    return required(spark, d)[1].select("query_id", "position", "name")


COVER = f"""{REQ}, co AS (SELECT a.query_id, coalesce(string_agg(r.name, '|' ORDER BY r.position) FILTER (EXISTS (SELECT 1 FROM cv WHERE cv.query_id = r.query_id AND cv.name = r.name)), '') AS covered,
   coalesce(string_agg(r.name, '|' ORDER BY r.position) FILTER (NOT EXISTS (SELECT 1 FROM cv WHERE cv.query_id = r.query_id AND cv.name = r.name)), '') AS missing,
   count(r.name) AS n, count(r.name) FILTER (EXISTS (SELECT 1 FROM cv WHERE cv.query_id = r.query_id AND cv.name = r.name)) AS k FROM ask a LEFT JOIN req r ON r.query_id = a.query_id GROUP BY a.query_id)"""


@query("coverage", f"WITH {COVER} SELECT query_id, covered, missing, round(CASE WHEN n = 0 THEN 1.0 ELSE k / n END, 6) AS ratio FROM co")
def q_coverage(spark, d):
    q, req = required(spark, d)
    out = ev.coverage(q, req, parents(spark, d))
    return out.select("query_id", F.array_join("covered", "|").alias("covered"), F.array_join("missing", "|").alias("missing"), F.round("ratio", 6).alias("ratio"))


@query("coverage_order", f"""WITH {REQ}, fp AS (SELECT query_id, position, arg_min(parent_id, rank) AS parent_id FROM cv GROUP BY ALL), ld AS (SELECT query_id, parent_id, min(position) AS lead FROM fp GROUP BY ALL)
SELECT * FROM (SELECT v.query_id, v.parent_id, row_number() OVER (PARTITION BY v.query_id ORDER BY lead NULLS LAST, rank) AS final_rank FROM views v LEFT JOIN ld ON ld.query_id = v.query_id AND ld.parent_id = v.parent_id) WHERE final_rank <= 4""")
def q_coverage_order(spark, d):
    _, req = required(spark, d)
    return ev.coverage_order(req, parents(spark, d), 4).select("query_id", "parent_id", F.col("final_rank").cast("long").alias("final_rank"))


@query("supplemental_queries", f"WITH {COVER} SELECT query_id, query || chr(10) || '重点检索对象：' || replace(missing, '|', '、') AS supplemental_query FROM co JOIN ask USING (query_id) WHERE missing <> ''")
def q_supplemental(spark, d):
    q, req = required(spark, d)
    return ev.supplemental_queries(q, ev.coverage(q, req, parents(spark, d))).select("query_id", "supplemental_query")


@query("merge_supplement", f"""WITH {PLANS}, sec AS (SELECT (query_id + 1) AS query_id, parent_id, rank FROM views WHERE (query_id + 1) % 2 = 0),
 al AS (SELECT query_id, parent_id, 0 AS run, rank FROM views UNION ALL SELECT query_id, parent_id, 1, rank FROM sec), fi AS (SELECT query_id, parent_id, min(run * 1000 + rank) AS o FROM al GROUP BY ALL)
SELECT query_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY o) AS rank FROM fi""")
def q_merge_supplement(spark, d):
    first = parents(spark, d)
    second = first.withColumn("query_id", F.col("query_id") + 1)
    kinds = second.select("query_id").distinct().select("query_id", F.lit("hybrid_rrf").alias("score_kind"), F.when(F.col("query_id") % 2 == 0, 0.0296).otherwise(0.0294).alias("score"))
    return ev.merge_supplement(first, second, kinds, ev.score_bands(spark)).select("query_id", "parent_id", F.col("rank").cast("long").alias("rank"))


# --- policy -----------------------------------------------------------------------------------------------------------

TABLE = (("m-q", 1, "membership", "query"), ("m-r", 1, "membership", "refund"), ("o", 1, "order", None), ("g", 1, None, None))


def intents(spark, d):
    k = F.col("o_orderkey")
    doms = F.array(*[F.lit(x) for x in ("membership", "order", "account")])
    acts = F.array(*[F.lit(x) for x in ("query", "refund", "cancel")])
    return table(spark, d, "orders").select(k.alias("query_id"), F.element_at(doms, (k % 3 + 1).cast("int")).alias("domain"),
        F.array(F.element_at(acts, (k % 2 + 2).cast("int")), F.element_at(acts, (k % 3 + 1).cast("int"))).alias("actions"))


@query("select_policy", """SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'm-r' ELSE 'm-q' END WHEN o_orderkey % 3 = 1 THEN 'o' ELSE 'g' END AS policy_id FROM orders""")
def q_select_policy(spark, d):
    return ev.select_policy(intents(spark, d), ev.policy_table(spark, TABLE)).select("query_id", "policy_id")


MODES = "CASE query_id % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'bm25' ELSE 'hybrid' END"
SCORED = f"""{PLANS}, sk AS (SELECT CAST(s_suppkey AS BIGINT) AS query_id, (SELECT count(*) FROM views v WHERE v.query_id = s_suppkey) AS evidence_count, (SELECT best_score FROM views v WHERE v.query_id = s_suppkey AND rank = 1) AS b FROM supplier),
sq AS (SELECT query_id, evidence_count, CASE WHEN b IS NULL THEN '' WHEN query_id % 5 = 0 THEN 'rerank' WHEN query_id % 3 = 0 THEN 'vector_cosine' WHEN query_id % 3 = 1 THEN 'bm25_okapi' ELSE 'hybrid_rrf' END AS score_kind,
  CASE WHEN b IS NULL THEN -1 WHEN query_id % 5 = 0 THEN b * 25 ELSE b END AS score FROM sk)"""


def scored(spark, d):
    key = F.col("query_id")
    mode = F.when(key % 3 == 0, "vector").when(key % 3 == 1, "bm25").otherwise("hybrid")
    all_queries = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("query_id"))
    v = all_queries.join(parents(spark, d), "query_id", "left").select(
        "query_id", mode.alias("mode"), "rank", "best_score", (key % 5 == 0).alias("rerank_applied"), F.when(key % 5 == 0, F.col("best_score") * 25).alias("rerank_score"))
    return ev.score_kind(v)


@query("score_kind", f"WITH {SCORED} SELECT query_id, evidence_count, score_kind, round(score, 6) AS score FROM sq")
def q_score_kind(spark, d):
    return scored(spark, d).select("query_id", "evidence_count", F.coalesce("score_kind", F.lit("")).alias("score_kind"), F.round(F.coalesce("score", F.lit(-1.0)), 6).alias("score"))


DECIDED = f"""{SCORED}, dq AS (SELECT query_id, CASE WHEN evidence_count < 1 THEN 'no_evidence' WHEN query_id % 7 = 0 THEN 'missing_entity_coverage'
  WHEN score < CASE score_kind WHEN 'hybrid_rrf' THEN 0.0295 WHEN 'vector_cosine' THEN 0.6 WHEN 'bm25_okapi' THEN 1.0 ELSE 0.5 END THEN 'low_quality'
  WHEN score < CASE score_kind WHEN 'hybrid_rrf' THEN 0.03 WHEN 'vector_cosine' THEN 0.75 WHEN 'bm25_okapi' THEN 2.0 ELSE 0.75 END THEN 'weak_evidence' ELSE 'quality_accepted' END AS reason_code FROM sq),
dd AS (SELECT query_id, reason_code, CASE WHEN reason_code IN ('no_evidence', 'low_quality') THEN 'refuse' WHEN reason_code = 'quality_accepted' THEN 'answer' ELSE 'clarify' END AS decision FROM dq)"""


def decided(spark, d):
    missing = F.when(F.col("query_id") % 7 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return ev.decide_quality(scored(spark, d).withColumn("missing", missing), ev.score_bands(spark))


@query("decide_quality", f"WITH {DECIDED} SELECT query_id, reason_code, decision FROM dd")
def q_decide(spark, d):
    return decided(spark, d).select("query_id", "reason_code", "decision")


@query("combine_domains", f"""WITH {DECIDED}, g AS (SELECT query_id // 4 AS question_id, query_id % 4 AS position, decision, reason_code, CASE decision WHEN 'refuse' THEN 2 WHEN 'clarify' THEN 1 ELSE 0 END AS sev FROM dd)
SELECT question_id, decision, reason_code, position FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sev DESC, position) AS rn FROM g) WHERE rn = 1""")
def q_combine(spark, d):
    rows = decided(spark, d).select(F.floor(F.col("query_id") / 4).cast("long").alias("question_id"), (F.col("query_id") % 4).alias("position"), "decision", "reason_code")
    return ev.combine_domains(rows).select("question_id", "decision", "reason_code", "position")


@query("fallback_reason", """SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_business_domain' WHEN o_orderkey % 7 = 0 THEN 'missing_intent_decision' WHEN o_orderstatus = 'P' THEN 'STORE_DOWN' ELSE 'knowledge_retrieval_failed' END AS error_code
 FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderstatus IN ('P', 'F'))""")
def q_fallback(spark, d):
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    routes = orders.select(k.alias("question_id"), F.when(k % 2 == 0, "knowledge_rag").otherwise("safety").alias("target"),
                           F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("order"))).alias("domains"), (k % 7 != 0).alias("has_decision"))
    state = orders.where("o_orderstatus <> 'O'").select(k.alias("question_id"), F.when(F.col("o_orderstatus") == "P", "STORE_DOWN").alias("store_error"), F.lit(True).alias("failed"))
    return ev.fallback_reason(routes, state).select("question_id", "error_code")


# --- evidence ---------------------------------------------------------------------------------------------------------

def evidence_views(spark, d):
    """Eight documents are the parents of a question; the language is the domain."""
    key = F.col("doc_id")
    langs = F.array(*[F.lit(x) for x in ("en", "fr", "es", "de")])
    docs = table(spark, d, "documents").select(
        F.floor(key / 8).cast("long").alias("question_id"), (F.array_position(langs, F.col("lang")) - 1).alias("domain_position"), F.col("lang").alias("domain"), key.alias("rank"),
        F.concat(F.lit("d"), F.floor(key / 2).cast("long").cast("string")).alias("parent_id"), F.concat(F.lit("doc "), key.cast("string")).alias("title"), F.col("text").alias("content"),
        F.lit(0.5).alias("score"), F.array(F.col("source"), F.lit(" ")).alias("heading_path"), F.array(F.lit(0), F.lit(3), F.lit(3)).alias("page_numbers"))
    return docs


EVI = r"""ec AS (SELECT doc_id // 8 AS question_id, list_position(['en','fr','es','de'], lang) AS dp, lang, doc_id, 'd' || (doc_id // 2) AS parent_id, text FROM documents),
ed AS (SELECT question_id, parent_id, arg_min({'dp': dp, 'lang': lang, 'doc': doc_id, 'c': substr(text, 1, 2000)}, dp::BIGINT * 1000000000 + doc_id) AS v FROM ec GROUP BY ALL),
eo AS (SELECT *, row_number() OVER w AS k, coalesce(sum(length(v.c)) OVER (PARTITION BY question_id ORDER BY v.dp, v.doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ed WINDOW w AS (PARTITION BY question_id ORDER BY v.dp, v.doc)),
evd AS (SELECT question_id, 'E' || k AS evidence_id, k, parent_id, v.lang AS domain, 'doc ' || v.doc AS title, substr(v.c, 1, CAST(6000 - before AS BIGINT)) AS content FROM eo WHERE k <= 5 AND before < 6000)"""


@query("build_evidence", f"WITH {EVI} SELECT question_id, evidence_id, parent_id, domain, title, content FROM evd")
def q_build_evidence(spark, d):
    return ev.build_evidence(evidence_views(spark, d)).select("question_id", "evidence_id", "parent_id", "domain", "title", "content")


@query("excerpt", r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(substr(t, 1, 179)) || '…' END AS excerpt FROM c""")
def q_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", ev.excerpt("text").alias("excerpt"))


@query("evidence_json", f"""WITH {EVI} SELECT question_id, evidence_id, title AS document_title, domain AS business_domain, content FROM evd""")
def q_evidence_json(spark, d):
    """To JSON and back."""
    return ev.parse_evidence(ev.evidence_json(ev.build_evidence(evidence_views(spark, d))))


@query("trace_rollup", """WITH e AS (SELECT user_id AS question_id, event_id AS position, event_type AS domain, CASE WHEN event_type = 'error' THEN ['vector'] WHEN event_id % 9 = 0 THEN ['bm25', 'vector'] ELSE []::VARCHAR[] END AS fs, value FROM events),
 f AS (SELECT question_id, x, min(position * 10 + i) AS o FROM (SELECT question_id, position, unnest(fs) AS x, unnest(range(len(fs))) AS i FROM e) GROUP BY ALL),
 g AS (SELECT question_id, domain, min(position) AS o FROM e GROUP BY ALL)
SELECT question_id, (SELECT string_agg(domain, ',' ORDER BY o) FROM g WHERE g.question_id = e.question_id) AS domains, coalesce((SELECT string_agg(x, ',' ORDER BY o) FROM f WHERE f.question_id = e.question_id), '') AS failed_sources,
 bool_or(len(fs) > 0) AS degraded, count(*) AS child_hits, bool_or(domain IN ('click', 'view')) AS rerank_enabled, coalesce(bool_and(domain = 'click') FILTER (domain IN ('click', 'view')), FALSE) AS rerank_applied, round(sum(value), 4) AS rerank_latency_ms FROM e GROUP BY question_id""")
def q_trace_rollup(spark, d):
    kind = F.col("event_type")
    none = F.array().cast("array<string>")
    failed = F.when(kind == "error", F.array(F.lit("vector"))).when(F.col("event_id") % 9 == 0, F.array(F.lit("bm25"), F.lit("vector"))).otherwise(none)
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("question_id"), F.col("event_id").alias("position"), kind.alias("domain"), failed.alias("failed_sources"), (F.size(failed) > 0).alias("degraded"), F.lit(1).alias("child_hits"),
        kind.isin("click", "view").alias("rerank_enabled"), (kind == "click").alias("rerank_applied"), F.lit(1).alias("rerank_candidates"), F.col("value").alias("rerank_latency_ms"))
    out = ev.trace_rollup(rows)
    return out.select("question_id", F.array_join("domains", ",").alias("domains"), F.array_join("failed_sources", ",").alias("failed_sources"), "degraded", "child_hits",
                      "rerank_enabled", "rerank_applied", F.round("rerank_latency_ms", 4).alias("rerank_latency_ms"))


@query("attach_grounding", """SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 3 = 0 THEN 'E1,E2' ELSE '' END AS used, CASE WHEN o_orderkey % 3 = 0 THEN 'pass' ELSE '' END AS verdict FROM orders""")
def q_attach(spark, d):
    key = F.col("o_orderkey").alias("question_id")
    orders = table(spark, d, "orders")
    verdicts = orders.where("o_orderkey % 3 = 0").select(key, F.array(F.lit("E1"), F.lit("E2")).alias("used_evidence_ids"), F.lit("pass").alias("verdict"), F.lit(None).cast("string").alias("grounding_error_code"))
    stray = verdicts.withColumn("question_id", -F.col("question_id") - 1)
    out = ev.attach_grounding(orders.select(key), verdicts.unionByName(stray))
    return out.select("question_id", F.array_join("used_evidence_ids", ",").alias("used"), F.coalesce("verdict", F.lit("")).alias("verdict"))


@query("grounded_retrieval")
def q_grounded(spark, d):
    return grounded_retrieval(spark, d)
