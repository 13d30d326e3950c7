"""Registered queries: claim checks and evaluation metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scale import spread
from ..operators import chunks as chk
from ..operators import claims as cl
from ..operators import lexical as lx
from ..operators import metrics as me
from .q_blocks import PACK, WHOLE, whole_blocks
from .q_conversation import INTENT_SQL, KEY, merged
from .q_retrieval import BM25, GAIN, corpus, questions
from ..session import durable
from .registry import query, table

FOLD = "replace(lower({0}), 'ß', 'ss')"
TOKENS = r"list_distinct(list_concat(list_transform(range(1, greatest(length(regexp_replace(" + FOLD + r", '[^\x{{4e00}}-\x{{9fff}}]+', '', 'g')), 1)), lambda i: substr(regexp_replace(" + FOLD + r", '[^\x{{4e00}}-\x{{9fff}}]+', '', 'g'), i, 2)), regexp_extract_all(" + FOLD + ", '[a-z0-9]+')))"


def tokens_sql(x):
    return TOKENS.replace("{{", "{").replace("}}", "}").replace("{0}", x)


# Every document is the evidence of an answer; its claims are made from the whole text.
CLAIMS = rf"""fl AS MATERIALIZED (SELECT doc_id AS answer_id, text AS line, '支持退款。' || text AS content, {tokens_sql("('支持退款。' || text)")} AS own, regexp_replace({FOLD.format("'支持退款。' || text")}, '[^\p{{L}}\p{{N}}]+', '', 'g') AS plain FROM documents),
cs AS (SELECT answer_id, content, own, plain, unnest([line, line || ' 77777元', array_to_string(list_reverse(string_split(line, ' ')), ' '), '不支持退款 ' || line, line, array_to_string(list_reverse(string_split(line, ' ')), ' ') || ' qqq wwq eeq rrq ttq']) AS claim, unnest([0, 1, 2, 3, 4, 5]) AS claim_no FROM fl),
ct AS (SELECT answer_id, claim_no, claim, CASE WHEN claim_no = 4 THEN '' ELSE content END AS ev, {tokens_sql('claim')} AS a, CASE WHEN claim_no = 4 THEN [] ELSE own END AS b, regexp_replace({FOLD.format('claim')}, '[^\p{{L}}\p{{N}}]+', '', 'g') AS nc, CASE WHEN claim_no = 4 THEN '' ELSE plain END AS ne FROM cs),
cc AS (SELECT answer_id, claim_no, claim, nc, ne, ev, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END AS coverage FROM ct),
hr AS (SELECT answer_id, claim_no, claim, coverage, CASE WHEN ev = '' THEN 'missing_evidence_content' WHEN nc <> '' AND contains(ne, nc) THEN 'exact_match' WHEN claim_no = 1 AND NOT contains(ev, '77777') THEN 'numeric_fact_missing'
   WHEN claim_no = 3 AND coverage >= 0.55 THEN 'negation_conflict' ELSE '' END AS reason FROM cc),
hs AS (SELECT *, CASE reason WHEN 'exact_match' THEN 'supported' WHEN 'negation_conflict' THEN 'conflict' WHEN '' THEN '' ELSE 'unsupported' END AS status FROM hr),
cw AS (SELECT *, CASE WHEN status <> '' THEN status WHEN coverage >= 0.55 THEN 'supported' WHEN coverage >= 0.35 THEN 'partial' ELSE 'unsupported' END AS final, CASE WHEN reason <> '' THEN reason WHEN coverage >= 0.55 THEN 'token_coverage_supported' WHEN coverage >= 0.35 THEN 'token_coverage_partial' ELSE 'insufficient_token_coverage' END AS why FROM hs)"""


def docs(spark, d):
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("answer_id"), "text"), "answer_id")


def claim_rows(spark, d):
    line = F.col("text")
    turned = F.array_join(F.reverse(F.split("_line", " ")), " ")
    base = docs(spark, d).select("answer_id", line.alias("_line"))
    made = F.array(F.col("_line"), F.concat("_line", F.lit(" 77777元")), turned, F.concat(F.lit("不支持退款 "), F.col("_line")), F.col("_line"), F.concat(turned, F.lit(" qqq wwq eeq rrq ttq")))
    return base.select("answer_id", F.posexplode(made).alias("claim_no", "claim")).withColumn("evidence_ids", F.when(F.col("claim_no") == 4, F.array(F.lit("E9"))).otherwise(F.array(F.lit("E1"))))


def checked(spark, d):
    evidence = docs(spark, d).select("answer_id", F.lit("E1").alias("evidence_id"), F.concat(F.lit("支持退款。"), F.col("text")).alias("content"))
    return cl.hard_rules(cl.attach_evidence(claim_rows(spark, d), evidence))


def shown(df, *cols):
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in ("status", "reason_code") else F.col(c) for c in cols])


@query("check_answer", """WITH a AS (SELECT doc_id AS answer_id, CASE doc_id % 7 WHEN 1 THEN ['E1', 'X2'] WHEN 2 THEN ['E1', 'E1'] ELSE ['E1', 'E2'] END AS used, doc_id % 7 AS m FROM documents)
SELECT answer_id, CASE m WHEN 0 THEN 'blank_text' WHEN 1 THEN 'malformed_evidence_id' WHEN 2 THEN 'repeated_evidence_id' WHEN 3 THEN 'claims_differ_from_used' WHEN 4 THEN 'answer_differs_from_used' WHEN 5 THEN CASE WHEN answer_id % 2 = 0 THEN 'empty_allowed_evidence' ELSE 'unknown_evidence_id' END ELSE '' END AS error_code FROM a""")
def q_check_answer(spark, d):
    m = F.col("doc_id") % 7
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    used = F.when(m == 1, ids("E1", "X2")).when(m == 2, ids("E1", "E1")).otherwise(ids("E1", "E2"))
    plain = F.regexp_replace("text", r"\[E\d+\]", "")
    rows = table(spark, d, "documents").select(
        F.col("doc_id").alias("answer_id"), F.when(m == 0, " ").when(m == 4, F.concat(plain, F.lit("[E1]"))).otherwise(F.concat(plain, F.lit("[E1] and [E2]"))).alias("answer"),
        F.when(m == 3, F.array(F.struct(F.lit("c").alias("text"), ids("E1").alias("evidence_ids")))).otherwise(F.array(F.struct(F.lit("c").alias("text"), used.alias("evidence_ids")))).alias("claims"),
        used.alias("used_evidence_ids"), F.when(m == 5, F.when(F.col("doc_id") % 2 == 0, ids()).otherwise(ids("E1"))).otherwise(ids("E1", "E2", "E3")).cast("array<string>").alias("allowed_ids"))
    return cl.check_answer(rows).select("answer_id", F.coalesce("error_code", F.lit("")).alias("error_code"))


@query("hard_rules", f"WITH {CLAIMS} SELECT answer_id, claim_no, round(coverage, 6) AS coverage, reason AS reason_code, status FROM hs")
def q_hard_rules(spark, d):
    return shown(checked(spark, d).withColumn("coverage", F.round("coverage", 6)), "answer_id", "claim_no", "coverage", "reason_code", "status")


@query("polarity", """SELECT doc_id, doc_id % 3 = 0 AS conflict FROM documents""")
def q_polarity(spark, d):
    """A negated predicate in one text and only affirmed ones in the other, unless a sentence end stands between."""
    key = F.col("doc_id") % 3
    plain = F.regexp_replace("text", "[退款支持]", "")
    claim = F.concat(plain, F.lit("。不能退款。"))
    evidence = F.when(key == 0, F.concat(plain, F.lit("。不能。退款，再退款。"))).when(key == 1, F.concat(plain, F.lit("。无法退款；退款。"))).otherwise(F.concat(plain, F.lit("。未必可退款。")))
    return table(spark, d, "documents").select("doc_id", cl.polarity_conflict(claim, evidence).alias("conflict"))


@query("coverage_verdict", f"WITH {CLAIMS} SELECT answer_id, claim_no, final AS status, why AS reason_code FROM cw")
def q_coverage_verdict(spark, d):
    return shown(cl.coverage_verdict(checked(spark, d)), "answer_id", "claim_no", "status", "reason_code")


def nli(spark, d):
    k = F.col("answer_id") % 5
    return claim_rows(spark, d).where("claim_no <> 5 or answer_id % 2 = 0").select(
        "answer_id", "claim_no", F.when(k == 0, 0.9).when(k == 1, 0.2).otherwise(0.5).alias("entailment"), F.lit(0.1).alias("neutral"), F.when(k == 1, 0.8).when(k == 0, 0.7).otherwise(0.3).alias("contradiction"))


@query("score_verdict", f"""WITH {CLAIMS} SELECT answer_id, claim_no, CASE WHEN status <> '' THEN status WHEN claim_no = 5 AND answer_id % 2 = 1 THEN 'unknown' WHEN answer_id % 5 = 0 THEN 'supported' WHEN answer_id % 5 = 1 THEN 'conflict' ELSE 'unknown' END AS status,
  CASE WHEN status <> '' THEN reason WHEN claim_no = 5 AND answer_id % 2 = 1 THEN 'nli_verifier_unavailable' WHEN answer_id % 5 = 0 THEN 'nli_entailment' WHEN answer_id % 5 = 1 THEN 'nli_contradiction' ELSE 'nli_inconclusive' END AS reason_code FROM hs""")
def q_score_verdict(spark, d):
    return shown(cl.score_verdict(checked(spark, d), nli(spark, d)), "answer_id", "claim_no", "status", "reason_code")


# Answers keep a different subset of their claims, so every verdict occurs.
KEEP = "(claim_no = 0 OR (answer_id % 4 = 1 AND claim_no = 2) OR (answer_id % 4 = 2 AND claim_no = 5) OR (answer_id % 4 = 3 AND claim_no IN (1, 3, 4))) AND answer_id % 11 <> 0"
VERDICT = f"""{CLAIMS}, kp AS (SELECT * FROM cw WHERE {KEEP}), av AS (SELECT doc_id AS answer_id, count(claim_no) AS claims, count(*) FILTER (final = 'supported') AS supported, count(*) FILTER (final = 'partial') AS partial, count(*) FILTER (final = 'unsupported') AS unsupported, count(*) FILTER (final = 'conflict') AS conflict,
   coalesce(bool_or(why IN ('missing_evidence_content', 'numeric_fact_missing', 'negation_conflict')), FALSE) AS hard FROM documents LEFT JOIN kp ON kp.answer_id = doc_id GROUP BY doc_id),
vd AS (SELECT *, CASE WHEN claims = 0 OR conflict > 0 OR unsupported > 0 THEN 'reject' WHEN partial > 0 OR answer_id % 3 = 0 THEN 'degrade' ELSE 'pass' END AS verdict FROM av)"""


def judged(spark, d):
    # Written once: two consumers read the rows, and a filter on a verdict is not pushed into the rules that make it.
    rows = durable(cl.coverage_verdict(checked(spark, d)).where(KEEP).drop("evidence_text"))
    answers = docs(spark, d).select("answer_id", F.concat(F.lit("answer "), F.col("answer_id").cast("string")).alias("answer"), F.when(F.col("answer_id") % 3 == 0, "partial").otherwise("complete").alias("completeness"),
        F.when(F.col("answer_id") % 13 == 0, "unknown_evidence_id").alias("error_code"), F.when(F.col("answer_id") % 17 == 0, "shadow").otherwise("enforce").alias("mode"))
    return cl.answer_verdict(answers, rows), rows


@query("answer_verdict", f"WITH {VERDICT} SELECT answer_id, claims, supported, unsupported, conflict, hard AS hard_failure, verdict FROM vd")
def q_answer_verdict(spark, d):
    return judged(spark, d)[0].select("answer_id", "claims", "supported", "unsupported", "conflict", "hard_failure", "verdict")


@query("publish_text", rf"""WITH {VERDICT}, sf AS (SELECT answer_id, string_agg(regexp_replace(claim, '[。！？； ]+$', '') || '[E1]。', '' ORDER BY claim_no) AS safe FROM kp WHERE final = 'supported' GROUP BY 1)
SELECT v.answer_id, CASE WHEN v.answer_id % 13 = 0 THEN '知识回答未通过结构或引用校验，本次没有展示未经验证的模型内容。请换一种描述重试，或转人工核查。' WHEN v.answer_id % 17 = 0 AND NOT hard OR verdict = 'pass' THEN 'answer ' || v.answer_id WHEN safe IS NOT NULL AND NOT hard THEN safe || '其余内容证据不足，建议补充信息或转人工核查。'
  WHEN verdict = 'degrade' THEN '当前证据或语义校验不足，无法形成可靠回答。请缩小问题范围或转人工核查。' ELSE '当前生成内容存在缺少证据支持或证据冲突，本次已安全拦截。请补充信息或转人工核查。' END AS published FROM vd v LEFT JOIN sf USING (answer_id)""")
def q_publish_text(spark, d):
    return cl.publish_text(*judged(spark, d)).select("answer_id", "published")


# --- retrieval evaluation ---------------------------------------------------------------------------------------------

def eval_cases(spark, d):
    k = F.col("item_id")
    item = lambda name, m: F.struct(F.lit(name).alias("relevance_id"), F.lit(None).cast("string").alias("document_title"), F.array(m).alias("markers"))
    return table(spark, d, "benchmark").select(
        k.alias("case_id"), (k % 5 == 0).alias("expect_empty"), F.array(item("a", F.upper("text")), item("b", F.element_at(F.split("text", " "), -1))).alias("relevant"), (k * 1.5).alias("latency_ms"),
        (k % 9 == 0).alias("execution_error"), (k % 4 == 0).alias("rerank_degraded"))


RCASES = f"""{BM25}, st AS (SELECT count(*) AS n, avg(length) AS avg_length FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 sc AS (SELECT query_id, chunk_id, round(sum({GAIN}), 9) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), st GROUP BY ALL),
 top AS (SELECT query_id AS case_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc WHERE score > 0),
 shown AS (SELECT case_id, rank, {FOLD.format('text')} AS t FROM top JOIN documents ON doc_id = chunk_id WHERE rank <= 5 AND case_id % 5 <> 0 OR rank <= case_id % 2),
 it AS (SELECT item_id AS case_id, unnest(['a', 'b']) AS rid, unnest([{FOLD.format('upper(text)')}, {FOLD.format("string_split(text, ' ')[-1]")}]) AS m FROM benchmark WHERE item_id % 5 <> 0),
 rnk AS (SELECT it.case_id, rid, min(rank) FILTER (contains(t, m)) AS rank FROM it LEFT JOIN shown USING (case_id) GROUP BY ALL),
 pc AS (SELECT case_id, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS r1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END) AS r3, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS r5, coalesce(1.0 / min(rank), 0) AS rr FROM rnk GROUP BY 1),
 cse AS (SELECT item_id AS case_id, item_id % 5 = 0 AS neg, item_id % 9 = 0 AS err, item_id % 4 = 0 AS deg, (item_id * 1.5)::DOUBLE AS lat, CASE WHEN item_id % 9 = 0 THEN 0 ELSE coalesce(r1, 0) END AS r1, CASE WHEN item_id % 9 = 0 THEN 0 ELSE coalesce(r3, 0) END AS r3, CASE WHEN item_id % 9 = 0 THEN 0 ELSE coalesce(r5, 0) END AS r5,
   CASE WHEN item_id % 9 = 0 THEN 0 ELSE coalesce(rr, 0) END AS rr, CASE WHEN item_id % 9 = 0 THEN 'execution_error' WHEN item_id % 5 = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM shown WHERE shown.case_id = item_id) THEN 'unexpected_parent' ELSE '' END WHEN coalesce(r5, 0) < 1 THEN 'relevant_parent_missed' ELSE '' END AS failure
   FROM benchmark LEFT JOIN pc ON pc.case_id = item_id)"""


def eval_scored(spark, d):
    hits = lx.bm25_search(corpus(spark, d), questions(spark, d), 5)
    shown_ = hits.where("query_id % 5 <> 0 or rank <= query_id % 2").join(corpus(spark, d).select("chunk_id", "text"), "chunk_id")
    return me.retrieval_cases(eval_cases(spark, d), shown_.select(F.col("query_id").alias("case_id"), "rank", F.lit("t").alias("title"), F.col("text").alias("content")))


@query("retrieval_cases", f"WITH {RCASES} SELECT case_id, round(r1, 6) AS recall_at_1, round(r3, 6) AS recall_at_3, round(r5, 6) AS recall_at_5, round(rr, 6) AS reciprocal_rank, failure FROM cse")
def q_retrieval_cases(spark, d):
    out = eval_scored(spark, d)
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_3", "recall_at_5", "reciprocal_rank")], F.coalesce("failure", F.lit("")).alias("failure"))


@query("retrieval_metrics", f"""WITH {RCASES} SELECT round(coalesce(avg(r1) FILTER (NOT neg), 0), 6) AS recall_at_1, round(coalesce(avg(r3) FILTER (NOT neg), 0), 6) AS recall_at_3, round(coalesce(avg(r5) FILTER (NOT neg), 0), 6) AS recall_at_5,
 round(coalesce(avg(rr) FILTER (NOT neg), 0), 6) AS mrr_at_5, round(coalesce(avg(CASE WHEN failure = '' THEN 1.0 ELSE 0 END) FILTER (neg), 0), 6) AS negative_accuracy, round(avg(CASE WHEN err THEN 1.0 ELSE 0 END), 6) AS execution_failure_rate, round(avg(CASE WHEN deg THEN 1.0 ELSE 0 END), 6) AS rerank_degradation_rate,
 quantile_disc(lat, 0.5) FILTER (NOT err) AS latency_p50_ms, quantile_disc(lat, 0.95) FILTER (NOT err) AS latency_p95_ms, count(*) FILTER (NOT neg) AS positive_cases, count(*) FILTER (neg) AS negative_cases FROM cse""")
def q_retrieval_metrics(spark, d):
    m = me.retrieval_metrics(eval_scored(spark, d))
    return m.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


POLICY = """pr AS (SELECT o_orderkey, o_orderpriority AS run, o_orderkey % 3 = 0 AS neg, CASE WHEN o_orderkey % 10 = 0 THEN 'x' END AS err, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'answer' WHEN o_orderstatus = 'O' THEN 'refuse' ELSE 'clarify' END AS dec,
   (o_orderkey % 5) / 4.0 AS cov, o_orderkey % 4 = 0 AS sup, o_totalprice AS lat FROM orders),
pm AS (SELECT run, avg(CASE WHEN err IS NULL AND dec = CASE WHEN neg THEN 'refuse' ELSE 'answer' END THEN 1.0 ELSE 0 END) AS decision_accuracy, coalesce(avg(CASE WHEN NOT neg THEN 1.0 ELSE 0 END) FILTER (dec = 'answer'), 0) AS answer_precision,
  coalesce(avg(CASE WHEN dec = 'answer' THEN 1.0 ELSE 0 END) FILTER (neg), 0) AS false_answer_rate, coalesce(avg(CASE WHEN dec = 'refuse' THEN 1.0 ELSE 0 END) FILTER (neg), 0) AS refusal_recall, avg(cov) FILTER (err IS NULL) AS mean_entity_coverage,
  avg(CASE WHEN sup THEN 1.0 ELSE 0 END) FILTER (err IS NULL) AS supplemental_query_rate, avg(CASE WHEN err IS NULL THEN 0.0 ELSE 1 END) AS execution_failure_rate, quantile_disc(lat, 0.5) FILTER (err IS NULL) AS latency_p50_ms, quantile_disc(lat, 0.95) FILTER (err IS NULL) AS latency_p95_ms FROM pr GROUP BY run)"""
PM_COLS = ("decision_accuracy", "answer_precision", "false_answer_rate", "refusal_recall", "mean_entity_coverage", "supplemental_query_rate", "execution_failure_rate", "latency_p50_ms", "latency_p95_ms")


def policy_runs(spark, d):
    k = F.col("o_orderkey")
    err = F.when(k % 10 == 0, "x")
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("run"), (k % 3 == 0).alias("expect_empty"), err.alias("error_code"),
        F.when(err.isNotNull(), F.lit(None)).when(F.col("o_orderstatus") == "F", "answer").when(F.col("o_orderstatus") == "O", "refuse").otherwise("clarify").alias("decision"),
        ((k % 5) / 4.0).alias("coverage_ratio"), (k % 4 == 0).alias("supplemental"), F.col("o_totalprice").alias("latency_ms"))
    return me.policy_metrics(rows, ["run"])


@query("policy_metrics", f"WITH {POLICY} SELECT run, {', '.join(f'round({c}, 6) AS {c}' for c in PM_COLS)} FROM pm")
def q_policy_metrics(spark, d):
    return policy_runs(spark, d).select("run", *[F.round(c, 6).alias(c) for c in PM_COLS])


@query("compare_runs", f"WITH {POLICY.replace('pm AS (', 'pm AS MATERIALIZED (')}, u AS MATERIALIZED ({' UNION ALL '.join(f'''SELECT run, '{c}' AS metric, {c} AS value FROM pm''' for c in PM_COLS)}) SELECT u.run, u.metric, round(u.value, 6) AS value, round(u.value - b.value, 6) AS delta FROM u JOIN u b ON b.metric = u.metric AND b.run = '1-URGENT'")
def q_compare_runs(spark, d):
    out = me.compare_runs(policy_runs(spark, d), "run", "1-URGENT")
    return out.select("run", "metric", F.round("value", 6).alias("value"), F.round("delta", 6).alias("delta"))


# --- chunk evaluation: does the first line stay in one child, and does the parent hold first and last line ---------------

CHUNKEV = f"""{WHOLE}, {PACK}, ln AS (SELECT version_id, content, string_split(content, chr(10)) AS l FROM whole), m AS (SELECT unnest(['packed', 'parents_only']) AS mode),
g AS (SELECT mode, m2.* FROM m, generic m2 WHERE mode = 'packed' OR kind = 'parent'),
ce AS (SELECT mode, ln.version_id AS case_id, count(*) FILTER (kind = 'parent') AS parent_count, count(*) FILTER (kind = 'child') AS child_count,
  CAST(coalesce(bool_or(kind = 'child' AND contains(g.content, l[1])), FALSE) AS BIGINT) AS child_passed, CAST(coalesce(bool_or(kind = 'parent' AND contains(g.content, l[1]) AND contains(g.content, l[-1])), FALSE) AS BIGINT) AS parent_passed
  FROM ln JOIN g USING (version_id) GROUP BY mode, ln.version_id),
cx AS (SELECT *, array_to_string(list_filter([CASE WHEN child_passed = 0 THEN 'child_semantic_unit' END, CASE WHEN mode = 'parents_only' THEN 'strategy_selection' END, CASE WHEN child_count > 30 THEN 'chunk_count' END], lambda x: x IS NOT NULL), ',') AS failures FROM ce)"""


def chunk_eval(spark, d):
    blocks = whole_blocks(spark, d)
    drafts = chk.chunk_generic(blocks).withColumnRenamed("version_id", "case_id")
    both = drafts.withColumn("mode", F.lit("packed")).unionByName(drafts.where("kind = 'parent'").withColumn("mode", F.lit("parents_only")))
    lines = F.split("content", "\n")
    base = blocks.select(F.col("version_id").alias("case_id"), F.array(F.lit(0)).alias("ordinals"), F.array(F.array(lines[0])).alias("child_terms"), F.array(F.array(lines[0], F.element_at(lines, -1))).alias("parent_terms"),
        F.array(F.lit("generic")).alias("strategies"), F.lit(1).alias("min_parents"), F.lit(1).alias("max_parents"), F.lit(0).alias("min_children"), F.lit(30).alias("max_children"))
    cases = base.withColumn("mode", F.explode(F.array(F.lit("packed"), F.lit("parents_only"))))
    return me.chunk_cases(cases, both)


@query("chunk_cases", f"WITH {CHUNKEV} SELECT mode, case_id, parent_count, child_count, child_passed, parent_passed, failures FROM cx")
def q_chunk_cases(spark, d):
    return chunk_eval(spark, d).select("mode", "case_id", "parent_count", "child_count", "child_passed", "parent_passed", F.array_join("failures", ",").alias("failures"))


@query("chunk_metrics", f"""WITH {CHUNKEV} SELECT mode, round(avg(CASE WHEN failures = '' THEN 1.0 ELSE 0 END), 6) AS case_pass_rate, round(sum(child_passed) / count(*), 6) AS child_semantic_recall, round(sum(parent_passed) / count(*), 6) AS parent_context_recall,
 CASE WHEN mode = 'packed' THEN 1.0 ELSE 0.0 END::DOUBLE AS strategy_match_rate, 1.0::DOUBLE AS traceability_rate, 1.0::DOUBLE AS average_parent_count, round(avg(child_count), 6) AS average_child_count FROM cx GROUP BY mode""")
def q_chunk_metrics(spark, d):
    m = me.chunk_metrics(chunk_eval(spark, d))
    return m.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


# --- intent evaluation ------------------------------------------------------------------------------------------------

GOLD = f"""{INTENT_SQL}, gd AS (SELECT conv_id, turn, ['supported','out_of_domain','chitchat','unsafe'][(conv_id * 3 + turn) % 4 + 1] AS g_route, CASE WHEN (conv_id * 3 + turn) % 4 = 0 THEN [['membership/refund','order/query','account/recover','content/report','human_service/transfer','account/modify'][conv_id % 6 + 1]] ELSE []::VARCHAR[] END AS g_keys,
   ['low','medium','high'][(turn + conv_id) % 3 + 1] AS g_risk, conv_id % 2 = 0 AS g_needs FROM um),
ev AS (SELECT d.*, g_route, g_keys, g_risk, g_needs, d.route <> '' AS valid, list_sort(list_distinct(keys)) = list_sort(g_keys) AS same FROM dc d JOIN gd USING (conv_id, turn)),
ec AS (SELECT *, CASE WHEN NOT valid THEN 'structured_output' ELSE array_to_string(list_filter([CASE WHEN route <> g_route THEN 'route' END, CASE WHEN NOT same THEN 'sub_intent' END, CASE WHEN risk <> g_risk THEN 'risk' END, CASE WHEN needs <> g_needs THEN 'clarification' END,
   CASE WHEN rule_id <> '' AND (route <> g_route OR NOT same) THEN 'rule_misroute' END], lambda x: x IS NOT NULL), ',') END AS failures FROM ev)"""


def intent_scored(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    case = F.concat_ws(":", c.cast("string"), t.cast("string")).alias("case_id")
    names = ("membership/refund", "order/query", "account/recover", "content/report", "human_service/transfer", "account/modify")
    pairs = F.array(*[F.struct(F.lit(n.split("/")[0]).alias("domain"), F.lit(n.split("/")[1]).alias("action")) for n in names])
    route = F.element_at(F.array(*[F.lit(r) for r in ("supported", "out_of_domain", "chitchat", "unsafe")]), ((c * 3 + t) % 4 + 1).cast("int"))
    gold = table(spark, d, "conversations").where("role = 'user'").select(
        case, route.alias("route"), F.when((c * 3 + t) % 4 == 0, F.array(F.element_at(pairs, (c % 6 + 1).cast("int")))).otherwise(F.slice(pairs, 1, 0)).alias("intents"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), ((t + c) % 3 + 1).cast("int")).alias("risk"), (c % 2 == 0).alias("needs_clarification"))
    return me.intent_cases(gold, merged(spark, d).withColumn("case_id", F.concat_ws(":", *[F.col(k).cast("string") for k in KEY])))


@query("intent_cases", f"WITH {GOLD} SELECT conv_id || ':' || turn AS case_id, failures FROM ec")
def q_intent_cases(spark, d):
    return intent_scored(spark, d).select("case_id", F.array_join("failures", ",").alias("failures"))




def sql_ratio(a, b):
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / ({b}) END"


ROUTES_SQL = f"""rt AS (SELECT r AS route, count(*) FILTER (g_route = r AND ec.route = r) AS tp, count(*) FILTER (g_route <> r AND ec.route = r) AS fp, count(*) FILTER (g_route = r AND ec.route <> r) AS fn, count(*) FILTER (g_route = r) AS support
  FROM ec, (SELECT unnest(['supported','out_of_domain','chitchat','unsafe']) AS r) GROUP BY r)"""


@query("intent_route_metrics", f"WITH {GOLD}, {ROUTES_SQL} SELECT route, round({sql_ratio('tp', 'tp + fp')}, 6) AS precision, round({sql_ratio('tp', 'tp + fn')}, 6) AS recall, round({sql_ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, support FROM rt")
def q_intent_routes(spark, d):
    m = me.intent_route_metrics(intent_scored(spark, d))
    return m.select("route", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("intent_metrics", f"""WITH {GOLD}, {ROUTES_SQL}, s AS (SELECT *, len(list_intersect(list_distinct(keys), g_keys)) AS i, len(list_distinct(keys)) AS np, len(g_keys) AS ng, g_route = 'supported' AS sup, g_risk IN ('high', 'critical') AS high FROM ec),
 a AS (SELECT sum(i) AS tp, sum(np - i) AS fp, sum(ng - i) AS fn, count(*) AS n, count(*) FILTER (sup) AS ns, count(*) FILTER (sup AND same) AS ex, count(*) FILTER (rule_id <> '') AS ru, count(*) FILTER (rule_id <> '' AND valid AND route = g_route AND same) AS rok,
   count(*) FILTER (sup AND route <> 'supported') AS rej, count(*) FILTER (high) AS nh, count(*) FILTER (high AND risk NOT IN ('high', 'critical')) AS miss, count(*) FILTER (g_needs AND needs) AS ctp, count(*) FILTER (NOT g_needs AND needs) AS cfp, count(*) FILTER (g_needs AND NOT needs) AS cfn, count(*) FILTER (NOT valid) AS bad FROM s)
SELECT round((SELECT avg({sql_ratio('2 * tp', '2 * tp + fp + fn')}) FROM rt), 6) AS route_macro_f1, round({sql_ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS sub_intent_micro_f1, round({sql_ratio('ex', 'ns')}, 6) AS sub_intent_exact_match, round({sql_ratio('ru', 'n')}, 6) AS rule_coverage,
 round({sql_ratio('rok', 'ru')}, 6) AS rule_precision, round({sql_ratio('rej', 'ns')}, 6) AS false_rejection_rate, round({sql_ratio('miss', 'nh')}, 6) AS high_risk_miss_rate, round({sql_ratio('ctp', 'ctp + cfp')}, 6) AS clarification_precision, round({sql_ratio('ctp', 'ctp + cfn')}, 6) AS clarification_recall,
 round({sql_ratio('2 * ctp', '2 * ctp + cfp + cfn')}, 6) AS clarification_f1, round({sql_ratio('bad', 'n')}, 6) AS structured_failure_rate FROM a""")
def q_intent_metrics(spark, d):
    m = me.intent_metrics(intent_scored(spark, d))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("run_summary", f"WITH {GOLD} SELECT g_route AS gold_route, count(*) AS cases, count(*) FILTER (valid) AS valid, count(*) FILTER (rule_id <> '') AS by_rule, count(*) FILTER (valid AND rule_id = '') AS by_model, count(*) FILTER (NOT valid) AS failed FROM ec GROUP BY 1")
def q_run_summary(spark, d):
    return me.run_summary(intent_scored(spark, d))


@query("failed_cases", f"WITH {GOLD} SELECT conv_id || ':' || turn AS case_id, replace(failures, ',', ', ') AS failures, CASE WHEN valid THEN route ELSE 'error:' || error_code END AS predicted_route, CASE WHEN rule_id = '' THEN '-' ELSE rule_id END AS rule_id FROM ec WHERE failures <> ''")
def q_failed_cases(spark, d):
    return me.failed_cases(intent_scored(spark, d))


@query("failure_counts", f"WITH {GOLD} SELECT category, count(*) AS cases FROM (SELECT unnest(string_split(failures, ',')) AS category FROM ec WHERE failures <> '') GROUP BY 1")
def q_failure_counts(spark, d):
    return me.failure_counts(intent_scored(spark, d))


# --- answer evaluation ------------------------------------------------------------------------------------------------

RAG = f"""{VERDICT}, sp AS (SELECT answer_id, avg(CASE WHEN final = 'supported' THEN 1.0 ELSE 0 END) AS f FROM kp GROUP BY 1),
rc AS (SELECT doc_id AS case_id, text, CASE doc_id % 4 WHEN 0 THEN 'refuse' ELSE 'answer' END AS decision, CASE doc_id % 3 WHEN 0 THEN 'refuse' ELSE 'answer' END AS expected, doc_id % 4 <> 0 AS has, doc_id % 6 = 0 AS bad_ids, doc_id % 8 = 0 AS rerr, doc_id % 9 = 0 AS unsure FROM documents),
rs AS (SELECT r.*, CASE WHEN has THEN coalesce(f, 0) ELSE 1.0 END AS faithfulness, CASE WHEN has AND bad_ids THEN 0.5 ELSE 1.0 END AS cp, CASE WHEN has AND case_id % 5 = 0 THEN 0.5 ELSE 1.0 END AS cr, CASE WHEN has THEN (1 + CAST(contains({FOLD.format('text')}, 'the') AS INT)) / 2.0 ELSE 1.0 END AS ar FROM rc r LEFT JOIN sp ON sp.answer_id = case_id),
rf AS (SELECT *, array_to_string(list_filter([CASE WHEN decision <> expected THEN 'decision_mismatch' END, CASE WHEN rerr THEN 'retrieval_failure' END, CASE WHEN unsure THEN 'judge_uncertain' END, CASE WHEN has AND bad_ids THEN 'citation_failure' END, CASE WHEN faithfulness < 1 THEN 'faithfulness_failure' END,
  CASE WHEN NOT (has AND bad_ids) AND (cp < 1 OR cr < 1) THEN 'citation_failure' END, CASE WHEN ar < 1 THEN 'answer_relevancy_failure' END, CASE WHEN ar < 1 THEN 'incomplete_answer' END], lambda x: x IS NOT NULL), ',') AS failures FROM rs)"""


def rag_scored(spark, d):
    k = F.col("doc_id")
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    has = k % 4 != 0
    cases = table(spark, d, "documents").select(
        k.alias("case_id"), F.when(k % 3 == 0, "refuse").otherwise("answer").alias("expected_decision"), F.when(has, "answer").otherwise("refuse").alias("decision"), F.when(has, F.concat("text", F.lit(" Zebra"))).alias("answer"),
        F.when(k % 6 == 0, ids("E1", "E9")).otherwise(ids("E1")).alias("used_ids"), ids("E1", "E2").alias("allowed_ids"), F.when(k % 5 == 0, ids("E1", "E2")).otherwise(ids("E1")).alias("expected_ids"), ids("ZEBRA", "the").alias("required_terms"),
        F.when(k % 8 == 0, "X").alias("retrieval_error"), F.lit(None).cast("string").alias("generation_error"), (k % 9 == 0).alias("judge_uncertain"))
    return me.rag_cases(cases, judged(spark, d)[1])


@query("rag_cases", f"WITH {RAG} SELECT case_id, round(faithfulness, 6) AS faithfulness, cp::DOUBLE AS citation_precision, cr::DOUBLE AS citation_recall, ar::DOUBLE AS answer_relevancy, failures FROM rf")
def q_rag_cases(spark, d):
    return rag_scored(spark, d).select("case_id", F.round("faithfulness", 6).alias("faithfulness"), "citation_precision", "citation_recall", "answer_relevancy", F.array_join("failures", ",").alias("failures"))


@query("rag_metrics", f"WITH {RAG} SELECT round(avg(CASE WHEN decision = expected THEN 1.0 ELSE 0 END), 6) AS decision_accuracy, round(avg(faithfulness), 6) AS faithfulness, round(avg(ar), 6) AS answer_relevancy, round(avg(cp), 6) AS citation_precision, round(avg(cr), 6) AS citation_recall, round(avg(CASE WHEN failures = '' THEN 1.0 ELSE 0 END), 6) AS pass_rate, count(*) AS case_count FROM rf")
def q_rag_metrics(spark, d):
    m = me.rag_metrics(rag_scored(spark, d))
    return m.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


@query("verifier_gate", """WITH v AS (SELECT user_id, value, ['supported','conflict','unknown'][event_id % 3 + 1] AS e, CASE WHEN event_type = 'error' THEN 'supported' ELSE ['supported','conflict','unknown'][event_id % 3 + 1] END AS a FROM events),
 g AS (SELECT user_id, avg(CASE WHEN e = a THEN 1.0 ELSE 0 END) AS acc, count(*) FILTER (e <> 'supported' AND a = 'supported') AS bad, CASE WHEN count(*) FILTER (e = 'conflict') = 0 THEN 1.0 ELSE count(*) FILTER (e = 'conflict' AND a = 'conflict') / count(*) FILTER (e = 'conflict') END AS cr, avg(value) AS lat FROM v GROUP BY 1)
SELECT user_id, round(acc, 6) AS accuracy, bad AS unsafe_acceptances, round(cr, 6) AS conflict_recall, round(lat, 6) AS mean_latency_ms, acc >= 0.9 AND bad = 0 AND cr >= 0.9 AS accepted FROM g""")
def q_verifier_gate(spark, d):
    want = F.element_at(F.array(F.lit("supported"), F.lit("conflict"), F.lit("unknown")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, d, "events").select("user_id", want.alias("expected"), F.when(F.col("event_type") == "error", "supported").otherwise(want).alias("actual"), F.col("value").alias("latency_ms"))
    m = me.verifier_gate(rows, ["user_id"])
    return m.select("user_id", F.round("accuracy", 6).alias("accuracy"), "unsafe_acceptances", F.round("conflict_recall", 6).alias("conflict_recall"), F.round("mean_latency_ms", 6).alias("mean_latency_ms"), "accepted")
