"""Intent labels and routing over message and prediction tables. Every rule is a column expression: no shuffle."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions.text import contains_any, fold, rstrip, strip

INTENTS = "array<struct<domain:string,action:string,confidence:double>>"
ENTITIES = "array<struct<type:string,raw_value:string,normalized_value:string>>"
DECISION = (f"struct<route:string,intents:{INTENTS},entities:{ENTITIES},sentiment:string,risk:string,confidence:double,"
            "needs_clarification:boolean,clarification_question:string,source:string>")


def _decision(route: str, intents: str, entities: str, sentiment: str) -> Column:
    return F.expr(f"named_struct('route','{route}','intents',{intents},'entities',{entities},'sentiment','{sentiment}','risk','low',"
                  f"'confidence',1.0D,'needs_clarification',false,'clarification_question',cast(null as string),'source','rule')").cast(DECISION)


def _intent(domain: str, action: str) -> str:
    return f"array(named_struct('domain','{domain}','action','{action}','confidence',1.0D))"


def rule_labels(messages: DataFrame, text: str = "text", greetings=lex.GREETINGS, transfers=lex.TRANSFER_REQUESTS, product: str = lex.PRICE_PRODUCT,
                price=lex.PRICE_MARKERS) -> DataFrame:
    """INT-1: exact greeting, exact transfer request, product price question; else no label."""
    norm = strip(rstrip(fold(strip(text)), "。！？!?"))
    rule = F.when(F.col("_n").isin(*greetings), "chitchat.exact_greeting:v1").when(
        F.col("_n").isin(*transfers), "human_service.exact_transfer:v1").when(
        F.contains("_n", F.lit(product)) & contains_any("_n", price), "membership.price_query:v1")
    entity = f"array(named_struct('type','product','raw_value','{product}','normalized_value','{product}'))"
    decision = (
        F.when(F.col("rule_id") == "chitchat.exact_greeting:v1", _decision("chitchat", "array()", "array()", "positive"))
        .when(F.col("rule_id") == "human_service.exact_transfer:v1", _decision("supported", _intent("human_service", "transfer"), "array()", "neutral"))
        .when(F.col("rule_id") == "membership.price_query:v1", _decision("supported", _intent("membership", "query"), entity, "neutral")))
    return messages.withColumn("_n", norm).withColumn("rule_id", rule).withColumn("rule_decision", decision).drop("_n")


def _keys(intents: Column) -> Column:
    return F.transform(intents, lambda i: F.concat_ws("/", i["domain"], i["action"]))


def check_decision(predictions: DataFrame) -> DataFrame:
    """INT-2: the broken consistency rules of every prediction (``decision`` column)."""
    d = F.col("decision")
    keys = _keys(d["intents"])
    broken = F.array_compact(F.array(
        F.when((d["route"] == "supported") & (F.size(d["intents"]) == 0), "supported_without_intents"),
        F.when((d["route"] != "supported") & (F.size(d["intents"]) > 0), "intents_without_support"),
        F.when((d["route"] == "unsafe") & (d["risk"] == "low"), "unsafe_low_risk"),
        F.when(d["needs_clarification"] != d["clarification_question"].isNotNull(), "clarification_mismatch"),
        F.when(F.size(F.array_distinct(keys)) != F.size(keys), "duplicate_intent")))
    return predictions.withColumn("violations", broken)


def _rank(risk: Column) -> Column:
    return F.coalesce(*[F.when(risk == r, F.lit(i)) for i, r in enumerate(lex.RISKS)])


def risk_floor(question: Column, decision: Column, floors=lex.RISK_FLOORS) -> tuple[Column, Column]:
    """INT-4: (risk after the floor, policy id when it was raised). Risk is never lowered."""
    def floor_of(i: Column) -> Column:
        level = F.coalesce(*[F.when((i["domain"] == d) & (i["action"] == a), F.lit(lex.RISKS.index(r))) for d, a, r in floors], F.lit(0))
        return F.struct(level.alias("level"), F.concat(F.lit("risk."), i["domain"], F.lit("."), i["action"], F.lit(":v1")).alias("policy"))

    levels = F.transform(decision["intents"], floor_of)
    top = F.aggregate(levels, F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("policy")),
                      lambda acc, x: F.when(x["level"] > acc["level"], x).otherwise(acc))
    unsafe = decision["route"] == "unsafe"
    theft, harm = F.rlike(question, F.lit(lex.CREDENTIAL_THEFT)), F.rlike(question, F.lit(lex.COVERT_SELF_HARM))
    level = F.when(unsafe, F.when(theft | harm, 3).otherwise(1)).otherwise(top["level"])
    policy = F.when(unsafe, F.when(theft, "risk.credential_theft:v1").when(harm, "risk.covert_self_harm:v1").otherwise("risk.unsafe_minimum:v1")).otherwise(top["policy"])
    raised = _rank(decision["risk"]) < level
    names = F.array(*[F.lit(r) for r in lex.RISKS])
    return F.when(raised, F.element_at(names, level + 1)).otherwise(decision["risk"]), F.when(raised, policy)


def missing_parameter(question: Column, decision: Column, needs=lex.PARAMETER_NEEDS, process=lex.PROCESS_MARKERS,
                      execution=lex.EXECUTION_MARKERS) -> tuple[Column, Column]:
    """INT-5: (question to ask, policy id) of the first intent that wants something done without the id it needs."""
    def lacks(kinds, pattern) -> Column:
        named = F.exists(decision["entities"], lambda e: e["type"].isin(*kinds))
        return ~(named | F.rlike(question, F.lit(pattern))) if pattern else ~named

    conditions = [(d, a, lacks(kinds, pattern), ask) for d, a, kinds, pattern, ask in needs]

    def one(i: Column) -> Column:
        ask = F.coalesce(*[F.when((i["domain"] == d) & (i["action"] == a) & cond, F.lit(text)) for d, a, cond, text in conditions])
        return F.struct(ask.alias("ask"), F.concat(F.lit("clarification."), i["domain"], F.lit("."), i["action"], F.lit(":v1")).alias("policy"))

    hits = F.filter(F.transform(decision["intents"], one), lambda x: x["ask"].isNotNull())
    wants = (decision["route"] == "supported") & ~contains_any(question, process) & contains_any(question, execution)
    hit = F.get(hits, F.lit(0))
    return F.when(wants, hit["ask"]), F.when(wants, hit["policy"])


def apply_policies(rows: DataFrame, question: str = "text", column: str = "decision") -> DataFrame:
    """INT-4 and INT-5 on model decisions; the source becomes hybrid when a policy changed something."""
    d, q = F.col(column), F.col(question)
    risk, risk_policy = risk_floor(q, d)
    ask, ask_policy = missing_parameter(q, d)
    out = rows.withColumns({"_risk": risk, "_rp": risk_policy, "_ask": F.when(~d["needs_clarification"], ask), "_ap": ask_policy})
    policies = F.array_compact(F.array(F.col("_rp"), F.when(F.col("_ask").isNotNull(), F.col("_ap"))))
    changed = F.size("applied_policies") > 0
    fixed = F.struct(
        d["route"].alias("route"), d["intents"].alias("intents"), d["entities"].alias("entities"), d["sentiment"].alias("sentiment"), F.col("_risk").alias("risk"),
        d["confidence"].alias("confidence"), (d["needs_clarification"] | F.col("_ask").isNotNull()).alias("needs_clarification"),
        F.coalesce("_ask", d["clarification_question"]).alias("clarification_question"), F.lit("hybrid").alias("source")).cast(DECISION)
    return out.withColumn("applied_policies", policies).withColumn(column, F.when(d.isNotNull(), F.when(changed, fixed).otherwise(d))).drop("_risk", "_rp", "_ask", "_ap")


def merge_labels(labelled: DataFrame, predictions: DataFrame, key: list[str]) -> DataFrame:
    """INT-3: the rule label wins; otherwise the prediction, which must come from the model; policies follow; errors stay.

    ``labelled`` is ``rule_labels`` output; ``predictions``: key, decision, error_code.
    """
    j = labelled.join(predictions.select(*key, "decision", "error_code"), key, "left")
    ruled = F.col("rule_id").isNotNull()
    foreign = F.col("decision.source") != "model"
    j = j.withColumn("error_code", F.when(ruled, F.lit(None)).when(F.col("decision").isNull(), F.coalesce("error_code", F.lit("missing_prediction")))
                     .when(foreign, "schema_validation_failed")).withColumn("decision", F.when(~ruled & ~F.coalesce(foreign, F.lit(True)), F.col("decision")))
    done = apply_policies(j)
    return done.withColumn("applied_policies", F.coalesce("applied_policies", F.array().cast("array<string>"))).withColumn(
        "decision", F.when(ruled, F.col("rule_decision")).otherwise(F.col("decision"))).drop("rule_decision")


def route_target(rows: DataFrame) -> DataFrame:
    """INT-6: where a message goes, and the business domains it concerns."""
    d = F.col("decision")
    transfer = F.exists(d["intents"], lambda i: (i["domain"] == "human_service") & (i["action"] == "transfer"))
    target = (
        F.when(d.isNull(), "human_review_mock").when(d["route"] == "unsafe", "safety").when(d["route"] == "out_of_domain", "out_of_scope")
        .when(d["route"] == "chitchat", "general_chat").when(d["risk"].isin("high", "critical"), "human_review_mock")
        .when(d["needs_clarification"], "clarification").when(transfer, "human_service_mock").otherwise("knowledge_rag"))
    domains = F.array_distinct(F.filter(F.transform(d["intents"], lambda i: i["domain"]), lambda x: x != "human_service"))
    return rows.withColumn("target", target).withColumn("domains", F.coalesce(domains, F.array().cast("array<string>")))


def replay_labels(messages: DataFrame, predictions: DataFrame, key: list[str]) -> DataFrame:
    """INT-7: rules and policies over stored predictions, without new model calls."""
    return merge_labels(rule_labels(messages), predictions, key)


def case_set_difference(predictions: DataFrame, gold: DataFrame, key: str = "case_id") -> DataFrame:
    """INT-7: ids only one side has; rescoring needs this to be empty."""
    a = predictions.select(key, F.lit(1).alias("_a"))
    b = gold.select(key, F.lit(1).alias("_b"))
    return a.join(b, key, "full").where(F.col("_a").isNull() | F.col("_b").isNull()).select(
        key, F.when(F.col("_a").isNull(), "only_gold").otherwise("only_predicted").alias("side"))


def validate_questions(messages: DataFrame, text: str = "text", steps: str | None = None, max_chars: int = 2000, max_steps: int = 12) -> DataFrame:
    """INT-8: stripped question and a stable reason when it cannot be processed."""
    clean = strip(text)
    count = F.col(steps) if steps else F.lit(0)
    code = F.when(count >= max_steps, "STEP_LIMIT_EXCEEDED").when(F.length(clean) == 0, "EMPTY_QUESTION").when(F.length(clean) > max_chars, "QUESTION_TOO_LONG")
    return messages.withColumn("question", clean).withColumn("error_code", code).withColumn("valid", code.isNull())
