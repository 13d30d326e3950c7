"""Registered queries: conversation data, intent labels and routing, audit log."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as lex
from ..operators import audit as au
from ..operators import conversation as cv
from ..operators import intents as it
from .registry import query, table

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def messages(spark, d):
    return table(spark, d, "conversations")


REWRITE = dict(entities=("que", "the", "die"), topics=("que", "the", "von"))


@query("rewrite_queries", rf"""WITH m AS (SELECT conv_id, turn, CASE WHEN turn < 2 THEN text WHEN conv_id % 3 = 1 THEN ' 多少钱？' WHEN conv_id % 3 = 2 THEN '那the呢' ELSE text END AS t FROM conversations WHERE role = 'user'),
 p AS (SELECT conv_id, turn, {STRIP.format('t')} AS q, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM m),
 e AS (SELECT *, CASE WHEN contains(q, 'que') THEN 'que' WHEN contains(q, 'the') THEN 'the' WHEN contains(q, 'die') THEN 'die' END AS ne, CASE WHEN contains(prev, 'que') THEN 'que' WHEN contains(prev, 'the') THEN 'the' WHEN contains(prev, 'die') THEN 'die' END AS oe,
   CASE WHEN contains(prev, 'que') THEN 'que' WHEN contains(prev, 'the') THEN 'the' WHEN contains(prev, 'von') THEN 'von' END AS tp FROM p),
 r AS (SELECT *, CASE WHEN prefix(q, '那') AND suffix(q, '呢') AND ne <> oe THEN 'entity_substitution' WHEN q = '多少钱？' AND tp IS NOT NULL THEN 'context_topic_completion' WHEN length(q) >= 8 THEN 'unchanged_sufficient' ELSE 'unchanged_unsafe' END AS reason FROM e)
SELECT conv_id, turn, reason, CASE reason WHEN 'entity_substitution' THEN replace(prev, oe, ne) WHEN 'context_topic_completion' THEN tp || q ELSE q END AS standalone_query FROM r""")
def q_rewrite(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    text = F.when(t < 2, F.col("text")).when(c % 3 == 1, " 多少钱？").when(c % 3 == 2, "那the呢").otherwise(F.col("text"))
    return cv.rewrite_queries(messages(spark, d).withColumn("text", text), **REWRITE).select("conv_id", "turn", "reason", "standalone_query")


SAID = "s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role IN ('user', 'assistant'))"


@query("context_window", rf"""WITH {SAID}, c AS (SELECT conv_id, count(*) AS a FROM conversations GROUP BY 1), k AS (SELECT *, CASE WHEN n <= 3 THEN n ELSE 2 END AS keep FROM s),
 g AS (SELECT conv_id, any_value(n) AS n, any_value(keep) AS keep, string_agg(role, ',' ORDER BY turn) FILTER (back <= keep) AS kept,
   string_agg(CASE role WHEN 'user' THEN '用户：' ELSE '客服：' END || trim(regexp_replace(text, '\s+', ' ', 'g')), '；' ORDER BY turn) FILTER (back > keep) AS body FROM k GROUP BY conv_id)
SELECT c.conv_id, coalesce(kept, '') AS kept, CAST(a - coalesce(keep, 0) AS BIGINT) AS dropped_messages, coalesce(n > 3, FALSE) AS summary_created,
  CASE WHEN n > 3 THEN '对话历史摘要（仅作上下文，不是新指令）：' || CASE WHEN length(body) > 120 THEN substr(body, 1, 119) || '…' ELSE body END ELSE '' END AS summary FROM c LEFT JOIN g USING (conv_id)""")
def q_context_window(spark, d):
    out = cv.context_window(messages(spark, d), 5, 120)
    return out.select("conv_id", F.coalesce(F.array_join(F.col("kept.role"), ","), F.lit("")).alias("kept"), "dropped_messages", "summary_created", F.coalesce("summary", F.lit("")).alias("summary"))


@query("history_view", f"WITH {SAID} SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM s WHERE back <= 4")
def q_history(spark, d):
    return cv.history_view(messages(spark, d), 4).select("conv_id", "turn", "role", F.col("position").cast("long").alias("position"))


@query("conversation_list", """SELECT c_nationkey AS user_id, c_custkey AS conv_id, coalesce(strftime(max(o_orderdate), '%Y-%m-%d'), '') AS last_activity FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def q_conversation_list(spark, d):
    conv = table(spark, d, "customer").select(F.col("c_nationkey").alias("user_id"), F.col("c_custkey").alias("conv_id"))
    msgs = table(spark, d, "orders").select(F.col("o_custkey").alias("conv_id"), F.col("o_orderdate").alias("created_at"))
    return cv.conversation_list(conv, msgs).select("user_id", "conv_id", F.coalesce(F.date_format("last_activity", "yyyy-MM-dd"), F.lit("")).alias("last_activity"))


# --- topic state: users of the event log are conversations -------------------------------------------------------------

DOMAIN_OF = {"signup": "account", "error": "technical", "click": "content", "view": "membership", "purchase": "order"}


def topic_turns(spark, d):
    e, kind = F.col("event_id"), F.col("event_type")
    domain = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in DOMAIN_OF.items()])
    action = F.element_at(F.array(F.lit("query"), F.lit("cancel"), F.lit("report")), (e % 3 + 1).cast("int"))
    one = F.struct(domain.alias("domain"), action.alias("action"), F.lit(0.5).alias("confidence"))
    two = F.struct(F.lit("community").alias("domain"), action.alias("action"), F.lit(0.4).alias("confidence"))
    value = F.concat(F.lit("v"), (F.get_json_object("props", "$.k").cast("int") % 40).cast("string"))
    entity = F.struct(F.lit("product").alias("type"), value.alias("raw_value"), F.lit("").alias("normalized_value"))
    other = F.struct(F.lit("issue").alias("type"), F.lit("x").alias("raw_value"), F.lit("").alias("normalized_value"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("conv_id"), e.alias("turn"), (e % 17 == 0).alias("reset"), kind.alias("standalone_query"),
        F.when(e % 5 == 4, F.slice(F.array(one), 1, 0)).when(e % 2 == 0, F.array(one, two)).otherwise(F.array(one)).alias("intents"),
        F.when(e % 4 == 0, F.array(other)).otherwise(F.array(other, entity)).alias("entities"))


@query("topic_state", """WITH t AS (SELECT user_id AS c, event_id AS e, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS v, event_id % 17 = 0 AS reset, ['query', 'cancel', 'report'][event_id % 3 + 1] AS action,
   CASE event_type WHEN 'signup' THEN 'account' WHEN 'error' THEN 'technical' WHEN 'click' THEN 'content' WHEN 'view' THEN 'membership' ELSE 'order' END AS domain, CASE WHEN event_id % 4 <> 0 THEN 'v' || ((props->>'k')::INT % 40) END AS val FROM events),
 i AS (SELECT c, v, 0 AS p, domain, action, val FROM t WHERE e % 5 <> 4 UNION ALL SELECT c, v, 1, 'community', action, val FROM t WHERE e % 5 <> 4 AND e % 2 = 0),
 l AS (SELECT *, domain || ':' || action || ':' || coalesce(val, CASE domain WHEN 'account' THEN '账号' WHEN 'technical' THEN '客户端问题' WHEN 'content' THEN '内容' WHEN 'membership' THEN '大会员' WHEN 'order' THEN '订单' ELSE '社区功能' END) AS key FROM i),
 r AS (SELECT c, coalesce(max(v) FILTER (reset), 0) AS rv FROM t GROUP BY c),
 k AS (SELECT c, key, max(v * 2 + p) AS o FROM l JOIN r USING (c) WHERE v >= rv GROUP BY ALL), s AS (SELECT c, string_agg(key, '|' ORDER BY o DESC) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o DESC) AS n FROM k) WHERE n <= 5 GROUP BY c),
 f AS (SELECT c, list_reduce(list([val] ORDER BY v), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_append(a, x[1])[-20:] END, []::VARCHAR[]) AS conf FROM l WHERE p = 0 AND val IS NOT NULL GROUP BY c)
SELECT t.c AS conv_id, max(v) AS context_version, arg_max(domain, v) FILTER (e % 5 <> 4) AS primary_domain, arg_max(event_type, v) AS last_standalone_query, coalesce(any_value(topics), '') AS topics, coalesce(array_to_string(any_value(conf), '|'), '') AS confirmed
 FROM t LEFT JOIN s ON s.c = t.c LEFT JOIN f ON f.c = t.c GROUP BY t.c""")
def q_topic_state(spark, d):
    out = cv.topic_state(topic_turns(spark, d))
    return out.select("conv_id", "context_version", "primary_domain", "last_standalone_query", F.coalesce(F.array_join(F.col("active_topics.key"), "|"), F.lit("")).alias("topics"),
                      F.array_join("confirmed_values", "|").alias("confirmed"))


def context_turns(spark, d):
    t = F.col("turn")
    text = F.when(t % 4 == 0, "多少钱？").when(t % 4 == 1, F.concat(F.lit("换个问题，"), F.substring("role", 1, 3))).when(t % 4 == 2, " 怎么办").otherwise(F.col("text"))
    turns = messages(spark, d).select("conv_id", "turn", text.alias("text"))

    def topic(label, domain, turn):
        return F.struct(F.concat(F.lit(domain), F.lit(":query:"), F.lit(label)).alias("key"), F.lit(label).alias("label"), F.lit(domain).alias("domain"), F.lit(turn).cast("long").alias("last_turn"), F.lit(0.9).alias("confidence"))

    c = F.col("conv_id")
    stack = F.array(topic("大会员", "membership", 1), topic("客户端问题", "technical", 3))
    full = F.array(topic("大会员", "membership", 1), topic("客户端问题", "technical", 3), topic("订单", "order", 2))
    states = messages(spark, d).select("conv_id").distinct().select("conv_id", F.when(c % 3 == 0, full).when(c % 3 == 1, stack).otherwise(F.slice(stack, 2, 1)).alias("active_topics"))
    choices = messages(spark, d).where("conv_id % 5 = 0").select("conv_id", "turn", F.lit("resolved").alias("kind"), F.lit("order:query:订单").alias("topic_key"), F.lit("订单怎么办").alias("standalone_query"),
        F.lit(None).cast("string").alias("clarification_question"), F.lit(0.8).alias("confidence"))
    return turns, states, choices


@query("resolve_context", rf"""WITH t AS (SELECT conv_id AS c, turn, conv_id % 3 AS m, CASE turn % 4 WHEN 0 THEN '多少钱？' WHEN 1 THEN '换个问题，' || substr(role, 1, 3) WHEN 2 THEN '怎么办' ELSE {STRIP.format('text')} END AS q, substr(role, 1, 3) AS r3 FROM conversations),
 k AS (SELECT *, CASE WHEN turn % 4 IN (1, 3) THEN 'standalone' WHEN turn % 4 = 0 THEN CASE m WHEN 1 THEN 'resolved' WHEN 0 THEN CASE WHEN c % 5 = 0 THEN 'choice' ELSE 'ambiguous' END ELSE 'ambiguous' END
   ELSE CASE m WHEN 2 THEN 'resolved2' WHEN 0 THEN CASE WHEN c % 5 = 0 THEN 'choice' ELSE 'ambiguous' END ELSE 'ambiguous' END END AS kk FROM t)
SELECT c AS conv_id, turn, CASE kk WHEN 'resolved2' THEN 'resolved' WHEN 'choice' THEN 'resolved' ELSE kk END AS kind,
 CASE WHEN turn % 4 = 1 THEN r3 WHEN kk = 'standalone' THEN q WHEN kk = 'resolved' THEN '大会员' || q WHEN kk = 'resolved2' THEN '客户端问题' || q WHEN kk = 'choice' THEN '订单怎么办' ELSE '' END AS standalone_query,
 CASE WHEN turn % 4 = 1 THEN 'rule' WHEN kk LIKE 'resolved%' THEN 'rule' WHEN kk = 'choice' THEN 'model' ELSE 'none' END AS source,
 CASE WHEN kk = 'ambiguous' THEN '你想继续咨询' || CASE m WHEN 0 THEN '客户端问题、订单、大会员' WHEN 1 THEN '客户端问题、大会员' ELSE '客户端问题' END || '中的哪一项？' ELSE '' END AS clarification_question FROM k""")
def q_resolve_context(spark, d):
    out = cv.resolve_context(*context_turns(spark, d))
    return out.select("conv_id", "turn", "kind", F.coalesce("standalone_query", F.lit("")).alias("standalone_query"), "source", F.coalesce("clarification_question", F.lit("")).alias("clarification_question"))


# --- intents ----------------------------------------------------------------------------------------------------------

PAIRS = (("membership", "refund"), ("order", "query"), ("account", "recover"), ("content", "report"), ("human_service", "transfer"), ("account", "modify"))
INTENT_SQL = """um AS (SELECT conv_id, turn, CASE WHEN conv_id % 19 = 0 THEN ' HELLO? ' WHEN conv_id % 23 = 0 THEN '转人工。' WHEN conv_id % 29 = 0 THEN '大会员多少钱？' ELSE CASE WHEN conv_id % 2 = 0 THEN '帮我 ' ELSE '' END || CASE WHEN conv_id % 7 = 0 THEN '如何 ' ELSE '' END || text
    || CASE WHEN turn % 4 = 2 THEN ' BILI-12345678' ELSE '' END END AS text FROM conversations WHERE role = 'user'),
pr AS (SELECT conv_id, turn, text, ['supported','out_of_domain','chitchat','unsafe'][(conv_id + turn) % 4 + 1] AS route, conv_id % 6 AS a, turn % 6 AS b, ['low','medium','high'][turn % 3 + 1] AS risk, conv_id % 11 = 0 AS needs, CASE WHEN conv_id % 13 = 0 THEN 'rule' ELSE 'model' END AS source, conv_id % 17 <> 0 AS has,
   conv_id % 3 = 0 AS ent FROM um),
pi AS (SELECT *, CASE WHEN route <> 'supported' THEN []::BIGINT[] WHEN a <> b THEN [a, b] ELSE [a] END AS ii FROM pr),
rl AS (SELECT *, CASE WHEN conv_id % 19 = 0 THEN 'chitchat.exact_greeting:v1' WHEN conv_id % 23 = 0 THEN 'human_service.exact_transfer:v1' WHEN conv_id % 29 = 0 THEN 'membership.price_query:v1' ELSE '' END AS rule_id FROM pi),
fl AS (SELECT *, list_max(list_transform(ii, lambda x: CASE x WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END)) AS lvl, CASE risk WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rk,
   CASE WHEN route = 'supported' AND contains(text, '帮我') AND NOT contains(text, '如何') THEN list_filter(ii, lambda x: (x = 0 AND NOT ent) OR (x = 1 AND NOT (ent OR contains(text, 'BILI-'))) OR x = 3 OR x = 5)[1] END AS lack FROM rl),
fx AS (SELECT *, greatest(rk, CASE WHEN route = 'unsafe' THEN 1 ELSE coalesce(lvl, 0) END) AS nr, lack IS NOT NULL AND NOT needs AS asked FROM fl),
mg AS (SELECT conv_id, turn, rule_id, CASE WHEN rule_id <> '' THEN '' WHEN NOT has THEN 'invalid_json' WHEN source <> 'model' THEN 'schema_validation_failed' ELSE '' END AS error_code, rule_id = '' AND has AND source = 'model' AS modeled,
   route, ii, ['low','medium','high','critical'][nr + 1] AS risk, needs OR asked AS needs, nr > rk OR asked AS changed, ent FROM fx),
dc AS (SELECT conv_id, turn, rule_id, error_code, CASE WHEN rule_id LIKE 'chit%' THEN 'chitchat' WHEN rule_id <> '' THEN 'supported' WHEN modeled THEN route ELSE '' END AS route, CASE WHEN rule_id <> '' THEN 'low' WHEN modeled THEN risk ELSE '' END AS risk,
   CASE WHEN rule_id <> '' THEN FALSE WHEN modeled THEN needs ELSE FALSE END AS needs, CASE WHEN rule_id <> '' THEN 'rule' WHEN modeled THEN CASE WHEN changed THEN 'hybrid' ELSE 'model' END ELSE '' END AS source,
   CASE WHEN rule_id LIKE 'chit%' THEN []::VARCHAR[] WHEN rule_id LIKE 'human%' THEN ['human_service/transfer'] WHEN rule_id <> '' THEN ['membership/query'] WHEN modeled THEN list_transform(ii, lambda x: ['membership/refund','order/query','account/recover','content/report','human_service/transfer','account/modify'][x + 1]) ELSE []::VARCHAR[] END AS keys FROM mg)"""


def user_messages(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    text = F.when(c % 19 == 0, " HELLO? ").when(c % 23 == 0, "转人工。").when(c % 29 == 0, "大会员多少钱？").otherwise(F.concat(
        F.when(c % 2 == 0, "帮我 ").otherwise(""), F.when(c % 7 == 0, "如何 ").otherwise(""), F.col("text"), F.when(t % 4 == 2, " BILI-12345678").otherwise("")))
    return messages(spark, d).where("role = 'user'").select("conv_id", "turn", text.alias("text"))


def predictions(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    pairs = F.array(*[F.struct(F.lit(a).alias("domain"), F.lit(b).alias("action"), F.lit(0.9).alias("confidence")) for a, b in PAIRS])
    first, second = F.element_at(pairs, (c % 6 + 1).cast("int")), F.element_at(pairs, (t % 6 + 1).cast("int"))
    route = F.element_at(F.array(*[F.lit(r) for r in lex.ROUTES]), ((c + t) % 4 + 1).cast("int"))
    intents = F.when(route != "supported", F.slice(pairs, 1, 0)).when(c % 6 != t % 6, F.array(first, second)).otherwise(F.array(first))
    order = F.struct(F.lit("order_id").alias("type"), F.lit("1").alias("raw_value"), F.lit("1").alias("normalized_value"))
    decision = F.struct(
        route.alias("route"), intents.alias("intents"), F.when(c % 3 == 0, F.array(order)).otherwise(F.slice(F.array(order), 1, 0)).alias("entities"), F.lit("neutral").alias("sentiment"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (t % 3 + 1).cast("int")).alias("risk"), F.lit(0.8).alias("confidence"), (c % 11 == 0).alias("needs_clarification"),
        F.when(c % 11 == 0, "哪一个？").alias("clarification_question"), F.when(c % 13 == 0, "rule").otherwise("model").alias("source")).cast(it.DECISION)
    return messages(spark, d).where("role = 'user'").select("conv_id", "turn", F.when(c % 17 != 0, decision).alias("decision"), F.when(c % 17 == 0, "invalid_json").alias("error_code"))


KEY = ["conv_id", "turn"]


def merged(spark, d):
    return it.merge_labels(it.rule_labels(user_messages(spark, d)), predictions(spark, d), KEY)


def text_or_empty(c, name):
    return F.coalesce(c, F.lit("")).alias(name)


@query("rule_labels", f"WITH {INTENT_SQL} SELECT conv_id, turn, rule_id FROM rl")
def q_rule_labels(spark, d):
    return it.rule_labels(user_messages(spark, d)).select("conv_id", "turn", text_or_empty(F.col("rule_id"), "rule_id"))


@query("check_decision", f"""WITH {INTENT_SQL} SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN route = 'supported' AND conv_id % 5 = 0 THEN 'supported_without_intents' END, CASE WHEN route = 'unsafe' AND risk = 'low' THEN 'unsafe_low_risk' END,
  CASE WHEN needs AND conv_id % 2 = 0 THEN 'clarification_mismatch' END], lambda x: x IS NOT NULL), ',') AS violations FROM pi WHERE has""")
def q_check_decision(spark, d):
    p = predictions(spark, d).where("decision is not null")
    dd = F.col("decision")
    dd = F.when(F.col("conv_id") % 5 == 0, dd.withField("intents", F.slice("decision.intents", 1, 0))).otherwise(dd)
    p = p.withColumn("decision", dd).withColumn("decision", F.when(F.col("conv_id") % 2 == 0, F.col("decision").withField("clarification_question", F.lit(None).cast("string"))).otherwise(F.col("decision")))
    return it.check_decision(p).select("conv_id", "turn", F.array_join("violations", ",").alias("violations"))


@query("merge_labels", f"WITH {INTENT_SQL} SELECT conv_id, turn, rule_id, error_code, route, risk, needs, source, array_to_string(keys, '|') AS keys FROM dc")
def q_merge_labels(spark, d):
    x = F.col("decision")
    return merged(spark, d).select("conv_id", "turn", text_or_empty(F.col("rule_id"), "rule_id"), text_or_empty(F.col("error_code"), "error_code"), text_or_empty(x["route"], "route"), text_or_empty(x["risk"], "risk"),
        F.coalesce(x["needs_clarification"], F.lit(False)).alias("needs"), text_or_empty(x["source"], "source"), text_or_empty(F.array_join(F.transform(x["intents"], lambda i: F.concat_ws("/", i["domain"], i["action"])), "|"), "keys"))


@query("risk_floor", f"WITH {INTENT_SQL} SELECT conv_id, turn, ['low','medium','high'][nr + 1] AS risk, nr > rk AS raised FROM fx WHERE has")
def q_risk_floor(spark, d):
    rows = user_messages(spark, d).join(predictions(spark, d).where("decision is not null"), KEY)
    risk, policy = it.risk_floor(F.col("text"), F.col("decision"))
    return rows.select("conv_id", "turn", risk.alias("risk"), policy.isNotNull().alias("raised"))


@query("missing_parameter", f"WITH {INTENT_SQL} SELECT conv_id, turn, CASE lack WHEN 0 THEN 'clarification.membership.refund:v1' WHEN 1 THEN 'clarification.order.query:v1' WHEN 3 THEN 'clarification.content.report:v1' WHEN 5 THEN 'clarification.account.modify:v1' ELSE '' END AS policy FROM fx WHERE has")
def q_missing_parameter(spark, d):
    rows = user_messages(spark, d).join(predictions(spark, d).where("decision is not null"), KEY)
    _, policy = it.missing_parameter(F.col("text"), F.col("decision"))
    return rows.select("conv_id", "turn", text_or_empty(policy, "policy"))


TARGET = """CASE WHEN route = '' THEN 'human_review_mock' WHEN route = 'unsafe' THEN 'safety' WHEN route = 'out_of_domain' THEN 'out_of_scope' WHEN route = 'chitchat' THEN 'general_chat' WHEN risk IN ('high', 'critical') THEN 'human_review_mock'
  WHEN needs THEN 'clarification' WHEN list_contains(keys, 'human_service/transfer') THEN 'human_service_mock' ELSE 'knowledge_rag' END"""


@query("route_target", f"WITH {INTENT_SQL}, tg AS (SELECT *, list_filter(list_transform(keys, lambda k: string_split(k, '/')[1]), lambda x: x <> 'human_service') AS ds FROM dc) SELECT conv_id, turn, {TARGET} AS target, array_to_string(list_filter(ds, lambda v, i: list_position(ds, v) = i), '|') AS domains FROM tg")
def q_route_target(spark, d):
    return it.route_target(merged(spark, d)).select("conv_id", "turn", "target", F.array_join("domains", "|").alias("domains"))


@query("replay_labels", f"WITH {INTENT_SQL} SELECT conv_id, turn, route, source FROM dc")
def q_replay(spark, d):
    out = it.replay_labels(user_messages(spark, d), predictions(spark, d), KEY)
    return out.select("conv_id", "turn", text_or_empty(F.col("decision.route"), "route"), text_or_empty(F.col("decision.source"), "source"))


@query("case_set_difference", "SELECT conv_id AS case_id, CASE WHEN conv_id % 3 = 0 THEN 'only_gold' ELSE 'only_predicted' END AS side FROM (SELECT DISTINCT conv_id FROM conversations) WHERE (conv_id % 3 = 0) <> (conv_id % 5 = 0)")
def q_case_sets(spark, d):
    ids = messages(spark, d).select(F.col("conv_id").alias("case_id")).distinct()
    both = "(case_id % 3 = 0) = (case_id % 5 = 0)"
    return it.case_set_difference(ids.where(f"case_id % 5 = 0 or {both}"), ids.where(f"case_id % 3 = 0 or {both}"))


@query("validate_questions", rf"""WITH q AS (SELECT doc_id, doc_id % 14 AS steps, CASE WHEN doc_id % 10 = 0 THEN ' ' || chr(10) ELSE text END AS t FROM documents), s AS (SELECT doc_id, steps, {STRIP.format('t')} AS t FROM q)
SELECT doc_id, CASE WHEN steps >= 12 THEN 'STEP_LIMIT_EXCEEDED' WHEN length(t) = 0 THEN 'EMPTY_QUESTION' WHEN length(t) > 2000 THEN 'QUESTION_TOO_LONG' ELSE '' END AS error_code, length(t) AS chars FROM s""")
def q_validate(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 14).alias("steps"), F.when(F.col("doc_id") % 10 == 0, " \n").otherwise(F.col("text")).alias("text"))
    return it.validate_questions(rows, steps="steps").select("doc_id", text_or_empty(F.col("error_code"), "error_code"), F.length("question").cast("long").alias("chars"))


# --- audit log --------------------------------------------------------------------------------------------------------

def calls(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("conversation_id"), (F.col("event_id") % 3).alias("request_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("operation"),
        F.when(F.col("event_id") % 7 != 0, k).alias("prompt_tokens"), F.when(F.col("event_id") % 5 != 0, k + 1).alias("completion_tokens"), F.when(F.col("event_id") % 4 != 0, "knowledge_rag").alias("target"),
        F.when(F.col("event_type") == "error", F.element_at(F.array(F.lit("MODEL_UNAVAILABLE"), F.lit("BAD_INPUT"), F.lit("INTERNAL_ERROR")), (F.col("event_id") % 3 + 1).cast("int"))).alias("error_code"))


@query("latest_call", "SELECT conversation_id, request_id, call_id, operation FROM (SELECT user_id AS conversation_id, event_id % 3 AS request_id, event_id AS call_id, event_type AS operation, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def q_latest_call(spark, d):
    return au.latest_call(calls(spark, d)).select("conversation_id", "request_id", "call_id", "operation")


@query("usage_totals", """SELECT user_id AS conversation_id, event_id % 3 AS request_id, CAST(sum(CASE WHEN event_id % 7 <> 0 THEN (props->>'k')::INT ELSE 0 END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN event_id % 5 <> 0 THEN (props->>'k')::INT + 1 ELSE 0 END) AS BIGINT) AS completion_tokens,
  CAST(sum(CASE WHEN event_id % 7 <> 0 THEN (props->>'k')::INT ELSE 0 END) + sum(CASE WHEN event_id % 5 <> 0 THEN (props->>'k')::INT + 1 ELSE 0 END) AS BIGINT) AS total_tokens FROM events GROUP BY ALL""")
def q_usage(spark, d):
    return au.usage_totals(calls(spark, d), ["conversation_id", "request_id"])


@query("operation_label", "SELECT event_id AS call_id, event_type || ':' || CASE WHEN event_id % 4 <> 0 THEN 'knowledge_rag' ELSE 'routing_error' END AS operation FROM events")
def q_operation(spark, d):
    return au.operation_label(calls(spark, d)).select("call_id", "operation")


def steps(spark, d):
    kind, e = F.col("event_type"), F.col("event_id")
    none = F.array().cast("array<string>")
    return table(spark, d, "events").select(
        F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("execution_id"), e.alias("step"), F.lit("loop").alias("source"), kind.alias("current_node"), F.array(kind).alias("next_nodes"),
        F.array(F.lit("z"), kind, F.lit("a")).alias("written_nodes"), F.when(kind == "error", F.array(kind)).otherwise(none).alias("failed_nodes"), (kind == "signup").alias("interrupted"),
        F.when(kind == "click", "failed").otherwise("ok").alias("status"), F.col("props").alias("payload"))


@query("execution_timeline", """SELECT 'x' || user_id AS execution_id, event_id AS step, event_type AS current_node, array_to_string(list_sort(['z', event_type, 'a']), ',') AS written_nodes, event_type = 'signup' AS interrupted FROM events""")
def q_timeline(spark, d):
    return au.execution_timeline(steps(spark, d)).select("execution_id", "step", "current_node", F.array_join("written_nodes", ",").alias("written_nodes"), "interrupted")


LAST = "ls AS (SELECT * FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1)"


@query("execution_status", f"WITH {LAST} SELECT 'x' || user_id AS execution_id, event_id AS step, CASE WHEN event_type = 'signup' THEN 'interrupted' WHEN event_type IN ('error', 'click') THEN 'failed' ELSE 'completed' END AS execution_status FROM ls")
def q_status(spark, d):
    return au.execution_status(steps(spark, d)).select("execution_id", "step", "execution_status")


@query("recovery_advice", f"""WITH {LAST}, le AS (SELECT user_id, ['MODEL_UNAVAILABLE','BAD_INPUT','INTERNAL_ERROR'][event_id % 3 + 1] AS code FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'error') WHERE rn = 1)
SELECT 'x' || ls.user_id AS execution_id, CASE WHEN event_type = 'signup' THEN 'resume_review' WHEN event_type = 'error' AND code <> 'BAD_INPUT' THEN 'retry_checkpoint' WHEN event_type = 'error' THEN 'operator_inspect' WHEN event_type = 'click' THEN 'correct_input' ELSE 'none' END AS action
 FROM ls LEFT JOIN le ON le.user_id = ls.user_id""")
def q_recovery(spark, d):
    from ..operators.relational import latest_by
    failed = calls(spark, d).where("error_code is not null").withColumn("execution_id", F.concat(F.lit("x"), F.col("conversation_id").cast("string")))
    codes = latest_by(failed.select("execution_id", "created_at", "call_id", "error_code"), ["execution_id"], [F.col("created_at"), F.col("call_id")]).select("execution_id", "error_code")
    return au.recovery_advice(steps(spark, d), codes).select("execution_id", "action")


@query("review_queue", """WITH r AS (SELECT user_id * 10 + event_id % 4 AS execution_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'click' THEN 'processing' ELSE 'pending' END AS status FROM events)
SELECT execution_id FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY ts DESC, event_id DESC) AS rn FROM r) WHERE rn = 1 AND status = 'pending'""")
def q_review_queue(spark, d):
    kind = F.col("event_type")
    events = table(spark, d, "events").select((F.col("user_id") * 10 + F.col("event_id") % 4).alias("execution_id"), "ts", "event_id",
        F.when(kind == "signup", "approved").when(kind == "error", "rejected").when(kind == "click", "processing").otherwise("pending").alias("status"))
    return au.review_queue(events).select("execution_id")
