"""Checks of generated answers: citations, hard rules against evidence, verdicts, publication."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lex
from ..functions.scale import grouped_list
from ..functions.text import CUT, bind, contains_any, fold, is_blank, rstrip
from ..functions.tokens import semantic_tokens

EVIDENCE_ID = "^E[1-9][0-9]*$"
SUPPORTED_AT, PARTIAL_AT = 0.55, 0.35


def _same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def check_answer(answers: DataFrame) -> DataFrame:
    """CLM-1: ``answers``: answer_id, answer, claims array<struct<text, evidence_ids>>, used_evidence_ids, allowed_ids.

    Structural faults first, then the comparison with the evidence that really was offered.
    """
    used, claims = F.col("used_evidence_ids"), F.col("claims")
    cited = F.flatten(F.transform(claims, lambda c: c["evidence_ids"]))
    marked = F.regexp_extract_all("answer", F.lit(r"\[(E[1-9][0-9]*)\]"), F.lit(1))
    formed = F.forall(F.concat(used, cited), lambda i: F.rlike(i, F.lit(EVIDENCE_ID)))
    unique = (F.size(F.array_distinct(used)) == F.size(used)) & F.forall(
        claims, lambda c: F.size(F.array_distinct(c["evidence_ids"])) == F.size(c["evidence_ids"]))
    code = (
        F.when(is_blank("answer") | (F.size(claims) == 0) | F.exists(claims, lambda c: is_blank(c["text"])), "blank_text")
        .when(~formed, "malformed_evidence_id").when(~unique, "repeated_evidence_id")
        .when(~_same_set(cited, used), "claims_differ_from_used").when(~_same_set(marked, used), "answer_differs_from_used")
        .when(F.size("allowed_ids") == 0, "empty_allowed_evidence")
        .when(F.size(F.array_except(used, F.col("allowed_ids"))) > 0, "unknown_evidence_id"))
    return answers.withColumn("error_code", code)


def _alphanumeric(c: Column) -> Column:
    return fold(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def token_coverage(claim: Column, evidence_tokens: Column) -> Column:
    return bind(semantic_tokens(claim), lambda own: F.when(F.size(own) > 0, F.size(F.array_intersect(own, evidence_tokens)) / F.size(own)).otherwise(F.lit(0.0)))


def polarities(text: Column, predicate: str, negations=lex.NEGATIONS, window: int = 8) -> Column:
    """CLM-3: for every occurrence of a predicate whether a negation stands in the ``window`` characters before it,
    inside the same sentence. Splitting at the predicate leaves exactly the texts before its occurrences."""
    parts = F.split(F.replace(reduce(lambda acc, m: F.replace(acc, F.lit(m), F.lit("\n")), "。！？；;", text), F.lit(predicate), F.lit(CUT)), "\n")

    def sentence(s: Column) -> Column:
        pieces = F.split(s, CUT)

        def before(piece: Column, i: Column) -> Column:
            lead = F.array_join(F.slice(pieces, 1, i + 1), predicate)
            return contains_any(F.substring(lead, F.greatest(F.length(lead) - window + 1, F.lit(1)), F.lit(window)), negations)

        return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), before)

    return F.array_distinct(F.flatten(F.transform(parts, sentence)))


def polarity_conflict(claim: Column, evidence: Column, predicates=lex.PREDICATES, negations=lex.NEGATIONS) -> Column:
    """CLM-3: some predicate of both texts is only affirmed in one and only negated in the other."""
    def clash(p: str) -> Column:
        both = F.contains(claim, F.lit(p)) & F.contains(evidence, F.lit(p))
        return F.when(both, bind(F.struct(polarities(claim, p, negations).alias("a"), polarities(evidence, p, negations).alias("b")),
                                 lambda s: (F.size(s["a"]) > 0) & (F.size(s["b"]) > 0) & ~F.arrays_overlap(s["a"], s["b"]))).otherwise(False)

    return reduce(lambda x, y: x | y, [clash(p) for p in predicates])


def evidence_facts(text: Column, number: str = lex.NUMBER_PATTERN) -> Column:
    """What the rules need of an evidence text, made once however many claims cite it."""
    return F.struct(_alphanumeric(text).alias("norm"), F.regexp_extract_all(text, F.lit(number), F.lit(0)).alias("numbers"), semantic_tokens(text).alias("tokens"))


def attach_evidence(claims: DataFrame, evidence: DataFrame, number: str = lex.NUMBER_PATTERN) -> DataFrame:
    """Claim rows with the texts of their evidence ids joined in id order (a claim cites at most ten), and their facts.

    ``claims``: answer_id, claim_no, claim, evidence_ids; ``evidence``: answer_id, evidence_id, content. Claims of an answer
    that cite the same ids travel as one row, so a text crosses a shuffle and is read once for all of them.
    """
    key = ["answer_id", "evidence_ids"]
    rest = [c for c in claims.columns if c not in key]
    groups = claims.groupBy(*key).agg(F.collect_list(F.struct(*rest)).alias("_claims"))
    ids = groups.select(*key, F.posexplode("evidence_ids").alias("_p", "evidence_id"))
    texts = ids.join(evidence.select("answer_id", "evidence_id", "content"), ["answer_id", "evidence_id"], "left").groupBy(*key).agg(
        F.array_join(grouped_list(F.coalesce("content", F.lit("")), F.col("_p")), "\n").alias("evidence_text"))
    joined = groups.join(texts, key, "left").withColumn("evidence_text", F.coalesce("evidence_text", F.lit("")))
    facts = joined.withColumn("_facts", evidence_facts(F.col("evidence_text"), number))
    return facts.select(*key, F.explode("_claims").alias("_c"), "evidence_text", "_facts").select(
        *[F.col(c) if c in key else F.col(f"_c.{c}").alias(c) for c in claims.columns], "evidence_text", "_facts")


def hard_rules(rows: DataFrame, number: str = lex.NUMBER_PATTERN, predicates=lex.PREDICATES, negations=lex.NEGATIONS) -> DataFrame:
    """CLM-2 on rows of ``attach_evidence`` (or with ``claim`` and ``evidence_text``); status stays NULL when no rule decides."""
    claim, text = F.col("claim"), F.col("evidence_text")
    rows = rows if "_facts" in rows.columns else rows.withColumn("_facts", evidence_facts(text, number))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(number), F.lit(0))
    rated = rows.withColumn("_norm", _alphanumeric(claim)).withColumn("coverage", token_coverage(claim, F.col("_facts.tokens")))
    reason = (
        F.when(is_blank(text), "missing_evidence_content")
        .when((F.length("_norm") > 0) & F.contains(F.col("_facts.norm"), F.col("_norm")), "exact_match")
        .when(F.size(F.array_except(numbers(claim), F.col("_facts.numbers"))) > 0, "numeric_fact_missing")
        .when((F.col("coverage") >= SUPPORTED_AT) & polarity_conflict(claim, text, predicates, negations), "negation_conflict"))
    out = rated.withColumn("reason_code", reason)
    status = F.when(F.col("reason_code") == "exact_match", "supported").when(F.col("reason_code") == "negation_conflict", "conflict").when(
        F.col("reason_code").isNotNull(), "unsupported")
    score = F.when(F.col("reason_code") == "exact_match", 1.0).when(F.col("reason_code").isin("missing_evidence_content", "numeric_fact_missing"), 0.0).otherwise(F.col("coverage"))
    return out.withColumn("status", status).withColumn("support_score", score).drop("_norm", "_facts")


def coverage_verdict(rows: DataFrame) -> DataFrame:
    """CLM-4: undecided claims by token coverage."""
    c = F.col("coverage")
    open_ = F.col("status").isNull()
    status = F.when(c >= SUPPORTED_AT, "supported").when(c >= PARTIAL_AT, "partial").otherwise("unsupported")
    reason = F.when(c >= SUPPORTED_AT, "token_coverage_supported").when(c >= PARTIAL_AT, "token_coverage_partial").otherwise("insufficient_token_coverage")
    return rows.withColumn("reason_code", F.when(open_, reason).otherwise(F.col("reason_code"))).withColumn("status", F.when(open_, status).otherwise(F.col("status")))


def score_verdict(rows: DataFrame, scores: DataFrame, entail_at: float = 0.65, contradict_at: float = 0.70) -> DataFrame:
    """CLM-5: undecided claims by external (entailment, neutral, contradiction) scores; without scores they stay unknown."""
    j = rows.join(scores.select("answer_id", "claim_no", "entailment", "neutral", "contradiction"), ["answer_id", "claim_no"], "left")
    open_ = F.col("status").isNull()
    e, c = F.col("entailment"), F.col("contradiction")
    reason = F.when(e.isNull() | c.isNull(), "nli_verifier_unavailable").when((c >= contradict_at) & (c > e), "nli_contradiction").when(
        (e >= entail_at) & (e > c), "nli_entailment").otherwise("nli_inconclusive")
    status = F.when((c >= contradict_at) & (c > e), "conflict").when((e >= entail_at) & (e > c), "supported").otherwise("unknown")
    out = j.withColumn("reason_code", F.when(open_, reason).otherwise(F.col("reason_code"))).withColumn(
        "support_score", F.when(open_ & e.isNotNull(), e).otherwise(F.col("support_score")))
    return out.withColumn("status", F.when(open_, status).otherwise(F.col("status")))


def answer_verdict(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """CLM-6: reject on conflict, unsupported or no claims; degrade on partial, unknown or an incomplete answer."""
    s = F.col("status")
    counts = claims.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("claims"), *[F.count_if(s == x).alias(x) for x in ("supported", "partial", "unsupported", "conflict", "unknown")],
        F.bool_or(F.col("reason_code").isin(*lex.HARD_FAILURES)).alias("hard_failure"))
    j = answers.join(counts, "answer_id", "left").fillna(0, ["claims", "supported", "partial", "unsupported", "conflict", "unknown"]).fillna(False, ["hard_failure"])
    verdict = F.when((F.col("claims") == 0) | (F.col("conflict") > 0) | (F.col("unsupported") > 0), "reject").when(
        (F.col("partial") > 0) | (F.col("unknown") > 0) | (F.col("completeness") == "partial"), "degrade").otherwise("pass")
    return j.withColumn("verdict", verdict)


def publish_text(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """CLM-7: the text that may be shown. ``answers`` is ``answer_verdict`` output with answer, error_code and mode."""
    cite = F.array_join(F.transform("evidence_ids", lambda i: F.concat(F.lit("["), i, F.lit("]"))), "")
    line = F.concat(rstrip("claim", "。！？； "), cite, F.lit("。"))
    rebuilt = claims.where(F.col("status") == "supported").groupBy("answer_id").agg(
        F.array_join(grouped_list(line, F.col("claim_no")), "").alias("_safe"))
    j = answers.join(rebuilt, "answer_id", "left")
    clear = ~F.col("hard_failure")
    text = (
        F.when(F.col("error_code").isNotNull(), lex.REPLY_INVALID).when(F.col("verdict").isNull(), lex.REPLY_UNVERIFIED)
        .when((F.col("mode") == "shadow") & clear, F.col("answer")).when(F.col("verdict") == "pass", F.col("answer"))
        .when(F.col("_safe").isNotNull() & clear, F.concat("_safe", F.lit(lex.REPLY_REST)))
        .when(F.col("verdict") == "degrade", lex.REPLY_DEGRADE).otherwise(lex.REPLY_REJECT))
    return j.withColumn("published", text).drop("_safe")
