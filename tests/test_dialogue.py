import pytest
from pyspark.sql import functions as F

from answerloom.operators import audit as au
from answerloom.operators import claims as cl
from answerloom.operators import conversation as cv
from answerloom.operators import intents as it
from answerloom.operators import metrics as me


@pytest.mark.parametrize("turns, want, reason", [
    (["移动大王卡支持免流吗？", "那联通呢"], "联通大王卡支持免流吗？", "entity_substitution"), (["大会员能做什么", "多少钱"], "大会员多少钱", "context_topic_completion"),
    (["你好", "那怎么办"], "那怎么办", "unchanged_unsafe"), (["如何关闭大会员自动续费？"], "如何关闭大会员自动续费？", "unchanged_sufficient")])
def test_rewrite(spark, turns, want, reason):
    m = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(turns)], "conv_id int, turn int, role string, text string")
    last = cv.rewrite_queries(m).orderBy(F.col("turn").desc()).first()
    assert (last.standalone_query, last.reason) == (want, reason)


def test_context_window(spark):
    m = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(5)], "conv_id int, turn int, role string, text string")
    row = cv.context_window(m, 5).first()
    assert [k.text for k in row.kept] == ["m3", "m4"] and row.dropped_messages == 3
    assert row.summary.endswith("用户：m0；客服：m1；用户：m2")


TOPIC = "array<struct<key:string,label:string,domain:string,last_turn:long,confidence:double>>"


def test_resolve_context(spark):
    tech, member, order = ("technical:query:客户端问题", "客户端问题", "technical", 3, .9), ("membership:query:大会员", "大会员", "membership", 1, .9), ("order:query:订单", "订单", "order", 2, .9)
    states = spark.createDataFrame([(1, [tech, member]), (2, [member, order])], f"conv_id int, active_topics {TOPIC}")
    turns = spark.createDataFrame([(1, 9, "多少钱"), (2, 9, "多少钱"), (2, 10, "换个问题，怎么登录")], "conv_id int, turn int, text string")
    rows = {(r.conv_id, r.turn): r for r in cv.resolve_context(turns, states).collect()}
    assert rows[1, 9].standalone_query == "大会员多少钱" and rows[1, 9].referenced_turn == 1
    assert rows[2, 9].kind == "ambiguous" and "大会员" in rows[2, 9].clarification_question and "订单" in rows[2, 9].clarification_question
    assert rows[2, 10].reset_context and rows[2, 10].standalone_query == "怎么登录"


def test_topic_state_reset_and_skew(spark):
    schema = "conv_id int, turn int, reset boolean, standalone_query string, intents array<struct<domain:string,action:string,confidence:double>>, entities array<struct<type:string,raw_value:string,normalized_value:string>>"
    rows = [(1, 1, False, "a", [("membership", "query", .9)], []), (1, 2, True, "b", [("account", "recover", .9)], [])]
    rows += [(2, i, False, "q", [("order", "query", .5)], [("product", f"v{i % 27}", "")]) for i in range(200)]
    df = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in cv.topic_state(df, hot_rows=20).collect()}
    assert [t.key for t in got[1].active_topics] == ["account:recover:账号"] and got[1].context_version == 2
    kept = []
    for i in range(200):
        kept = kept if f"v{i % 27}" in kept else [*kept, f"v{i % 27}"][-20:]
    assert got[2].confirmed_values == kept and got[2].context_version == 200
    assert [t.label for t in got[2].active_topics] == [f"v{i % 27}" for i in range(199, 194, -1)]


@pytest.mark.parametrize("text, rule", [("你好！", "chitchat.exact_greeting:v1"), (" HELLO? ", "chitchat.exact_greeting:v1"), ("你好，我要退款", None), ("大会员多少钱？", "membership.price_query:v1")])
def test_rule_labels(spark, text, rule):
    assert it.rule_labels(spark.createDataFrame([(text,)], "text string")).first().rule_id == rule


def _verdict(spark, claim, evidence, completeness="complete"):
    claims = spark.createDataFrame([(1, 0, claim, ["E1"])], "answer_id int, claim_no int, claim string, evidence_ids array<string>")
    ev = spark.createDataFrame([(1, "E1", evidence)] if evidence else [], "answer_id int, evidence_id string, content string")
    rows = cl.coverage_verdict(cl.hard_rules(cl.attach_evidence(claims, ev)))
    answers = spark.createDataFrame([(1, completeness)], "answer_id int, completeness string")
    r = rows.first()
    return r.status, r.reason_code, cl.answer_verdict(answers, rows).first().verdict


@pytest.mark.parametrize("claim, evidence, want", [
    ("支付成功后10分钟生效", "支付成功后立即生效", ("unsupported", "numeric_fact_missing", "reject")), ("支持无理由退款", "不支持无理由退款，请注意", ("supported", "exact_match", "pass")),
    ("会员支持无理由退款", "会员不支持无理由退款", ("conflict", "negation_conflict", "reject")), ("大会员在支付成功后立即生效", "大会员通常在支付成功后立即生效", ("supported", "token_coverage_supported", "pass")),
    ("任何话", "", ("unsupported", "missing_evidence_content", "reject"))])
def test_claims(spark, claim, evidence, want):
    assert _verdict(spark, claim, evidence) == want


def test_partial_answer_degrades(spark):
    assert _verdict(spark, "立即生效", "支付成功后立即生效", "partial")[2] == "degrade"


def test_retrieval_case(spark):
    cases = spark.createDataFrame([("a", False, [("r", None, ["锚点"])], 1.0, False, False), ("n", True, [], 2.0, False, False)],
        "case_id string, expect_empty boolean, relevant array<struct<relevance_id:string,document_title:string,markers:array<string>>>, latency_ms double, execution_error boolean, rerank_degraded boolean")
    parents = spark.createDataFrame([("a", 1, "t", "无"), ("a", 2, "t", "有锚点"), ("n", 1, "t", "x")], "case_id string, rank int, title string, content string")
    rows = {r.case_id: r for r in me.retrieval_cases(cases, parents).collect()}
    assert (rows["a"].recall_at_1, rows["a"].recall_at_3, rows["a"].reciprocal_rank) == (0, 1, .5)
    assert rows["n"].failure == "unexpected_parent"


def test_recovery(spark):
    steps = spark.createDataFrame([("a", 1, False, [], "ok"), ("a", 2, False, ["n"], "ok"), ("b", 1, True, [], "ok"), ("c", 1, False, [], "failed")],
                                  "execution_id string, step int, interrupted boolean, failed_nodes array<string>, status string")
    codes = spark.createDataFrame([("a", "MODEL_UNAVAILABLE")], "execution_id string, error_code string")
    assert {r.execution_id: r.action for r in au.recovery_advice(steps, codes).collect()} == {"a": "retry_checkpoint", "b": "resume_review", "c": "correct_input"}


def test_summary_keeps_its_last_character(spark):
    rows = [(1, i, "user", "") for i in range(60)]
    got = cv.context_window(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), 3, 123).first()
    assert got.summary.endswith("…")
