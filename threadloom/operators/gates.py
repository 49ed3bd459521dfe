"""Risk, evidence and grounding gates, and the decision that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as tx

#: The reason that each risk tag stands for.
REASONS = {
    "SECURITY": "SECURITY_RISK", "PAYMENT": "PAYMENT_ACTION_REQUIRED", "REFUND": "PAYMENT_ACTION_REQUIRED", "PRIVATE_LOOKUP": "PRIVATE_ACCOUNT_REQUIRED",
    "PII": "PRIVATE_ACCOUNT_REQUIRED", "ACCOUNT_SPECIFIC": "PRIVATE_ACCOUNT_REQUIRED", "POLICY_SENSITIVE": "UNSUPPORTED_POLICY_RISK", "LOW_CONTEXT": "LOW_CONTEXT", "MULTI_INTENT": "AMBIGUOUS_INTENT",
}


def risk_tags(text: Column, markers: dict[str, list[str]], margin: Column, implied: dict[str, Column] | None = None, few: int = 5, near: float = 0.08) -> Column:
    """The tags of a message, in order, each once."""
    flat = tx.collapse(F.lower(text))
    tokens = F.size(F.regexp_extract_all(flat, F.lit("[a-z0-9']+"), F.lit(0)))
    tags = [F.when(tx.any_contains(flat, terms), tag) for tag, terms in markers.items()]
    tags += [F.when(test, tag) for tag, test in (implied or {}).items()]
    tags += [F.when(tokens <= few, "LOW_CONTEXT"), F.when(margin < near, "MULTI_INTENT")]
    return F.array_distinct(F.array_compact(F.array(*tags)))


def reasons(tags: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    return F.array_distinct(F.transform(tags, lambda t: F.try_element_at(table, t)))


def evidence(cases: DataFrame, thresholds: dict[str, float], queries: DataFrame | None = None) -> DataFrame:
    """query, intent_agreement, template_concentration, reasons from retrieved cases (query, rank, score, similarity, same_intent, reply).

    ``queries`` (query, and confidence and margin of the intent, where these are to be tested; null: below any threshold) are all that
    are judged: one without any case has no agreement, full concentration, and only INSUFFICIENT_EVIDENCE.
    """
    modal = cases.groupBy("query", "reply").agg(F.count("*").alias("n")).groupBy("query").agg(F.max("n").alias("modal"))
    base = cases.groupBy("query").agg(F.count("*").alias("n"), F.count_if("same_intent").alias("same"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("similarity")).join(modal, "query")
    if queries is not None:
        base = queries.join(base, "query", "left")
    agree, dense = F.col("same") / F.col("n"), F.col("modal") / F.col("n")
    below = lambda name: F.coalesce(F.col(name) < thresholds[name], F.lit(True)) if name in thresholds and name in base.columns else F.lit(False)
    found = F.array(
        F.when(below("confidence"), "LOW_INTENT_CONFIDENCE"),
        F.when(below("margin"), "AMBIGUOUS_INTENT"),
        F.when((F.col("score") < thresholds["score"]) | (F.col("similarity") < thresholds["similarity"]), "INSUFFICIENT_EVIDENCE"),
        F.when(agree < thresholds["agreement"], "INTENT_RETRIEVAL_MISMATCH"),
        F.when(dense > thresholds["concentration"], "TEMPLATE_CONCENTRATION"),
    )
    reasons = F.when(F.col("n").isNull(), F.array(F.lit("INSUFFICIENT_EVIDENCE"))).otherwise(F.array_compact(found))
    return base.select("query", F.round(F.coalesce(agree, F.lit(0.0)), 6).alias("intent_agreement"), F.round(F.coalesce(dense, F.lit(1.0)), 6).alias("template_concentration"), reasons.alias("reasons"))


def calibrated(queries: DataFrame, cases: DataFrame, quantiles: dict[str, tuple[float, float, float]]) -> DataFrame:
    """One row with a threshold for each of confidence and margin (of ``queries``), score and similarity (of the best ``cases``):
    a quantile of its values, held between two bounds. A query without a case is an error, as in the gate that it tunes."""
    joined = queries.join(cases.where("rank = 1").select("query", "score", "similarity"), "query", "left")
    missing = F.raise_error(F.lit("a query has no case"))
    checked = [F.when(F.col(c).isNull(), missing).otherwise(F.col(c)).cast("double").alias(c) for c in quantiles]
    return joined.select(*checked).agg(*(F.round(F.greatest(F.least(F.percentile(c, q), F.lit(high)), F.lit(low)), 6).alias(c) for c, (q, low, high) in quantiles.items()))


def usable_reply(text: Column, least_words: int, private: list[str]) -> Column:
    """Whether a reply has enough words and no marker of a private channel."""
    norm = tx.normalized_reply(text)
    return (tx.word_count(norm) >= least_words) & ~tx.any_contains(norm, private)


def has_risk(text: Column, markers: list[str]) -> Column:
    return tx.any_contains(tx.normalized_reply(text), markers)


def _words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z']+"), F.lit(0)))


def _sendable(x: Column, blocked: list[str]) -> Column:
    return (_words(x) >= 4) & ~tx.any_contains(F.lower(x), blocked) & ~x.endswith(":")


def compose(reply: Column, blocked: list[str], allowed: list[str], most_sentences: int = 2, most_chars: int = 420) -> Column:
    """The first usable sentences of a past reply: questions, or steps that an allowed marker names."""

    def usable(x: Column) -> Column:
        asks = x.endswith("?")
        place = F.contains(F.lower(x), F.lit(" at ")) & ~asks
        return _sendable(x, blocked) & ~place & (asks | tx.any_contains(F.lower(x), allowed))

    own = F.filter(F.transform(tx.sentences(tx.sanitize_reply(reply)), tx.without_greeting), usable)
    return F.rtrim(F.substr(F.array_join(F.slice(own, 1, most_sentences), " "), F.lit(1), F.lit(most_chars)))


def compose_covering(cases: Column, customer: Column, blocked: list[str], allowed: list[str], limit: int = 2, most_sentences: int = 2, most_chars: int = 420) -> Column:
    """A struct (reply, evidence_ids) from the first ``limit`` cases (array of id, reply): the best sentence, then such as are
    not of its kind, question or statement. Steps come before questions, then overlap with the customer's words, then rank."""
    known = tx.content_tokens(customer)

    def scored(case: Column, rank: Column) -> Column:
        def one(x: Column, place: Column) -> Column:
            overlap = F.size(F.array_intersect(tx.content_tokens(x), known))
            step = tx.any_contains(F.lower(x), allowed)
            return F.struct(F.when(step, 2).otherwise(1).alias("kind"), overlap.alias("overlap"), (-rank).alias("rank"), (-place).alias("place"), x.alias("text"), case["id"].alias("id"))

        def usable(c: Column) -> Column:
            x = c["text"]
            asks, step = x.endswith("?"), c["kind"] == 2
            plain = ~x.rlike(r"[^\x00-\x7F]") & x.rlike("[.?!]$") & ~x.rlike(r"(?i)^(?:and|also|from there|this|that|it)\b")
            idle = asks & (tx.asks_for_known(x, customer) | (tx.generic_question(x) & (F.size(known) >= 4)))
            return _sendable(x, blocked) & plain & (asks | step) & ~idle

        return F.filter(F.transform(F.transform(tx.sentences(tx.sanitize_reply(case["reply"])), tx.without_greeting), one), usable)

    def picked(ranked: Column) -> Column:
        best = F.get(ranked, F.lit(0))
        other = F.filter(ranked, lambda c: c["text"].endswith("?") != best["text"].endswith("?"))
        fresh = F.filter(other, lambda c, i: ~F.exists(F.slice(other, 1, i), lambda e: e["text"] == c["text"]))
        return F.when(best.isNull(), ranked).otherwise(F.concat(F.array(best), F.slice(fresh, 1, most_sentences - 1)))

    once = lambda value, body: F.transform(F.array(value), body)[0]
    ranked = F.sort_array(F.flatten(F.transform(F.slice(cases, 1, limit), scored)), asc=False)

    def built(chosen: Column) -> Column:
        draft = F.rtrim(F.substr(F.array_join(F.transform(chosen, lambda c: c["text"]), " "), F.lit(1), F.lit(most_chars)))
        ids = F.array_distinct(F.transform(chosen, lambda c: c["id"]))
        bad = tx.coverage_failure(draft, customer)
        return F.struct(F.when(bad, "").otherwise(draft).alias("reply"), F.when(bad, F.slice(ids, 1, 0)).otherwise(ids).alias("evidence_ids"))

    return once(once(ranked, picked), built)


def coverage(reply: Column, replies: Column) -> Column:
    """The share of a reply's words that the evidence (array of texts) has; 0 without any."""
    own, seen = tx.plain_tokens(reply), F.flatten(F.transform(replies, tx.plain_tokens))
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(own, seen)) / F.size(own))


#: What each group of markers in a reply stands for.
MARKER_CODES = {"unsupported_action": "UNSUPPORTED_ACTION_CLAIM", "private_inspection": "PRIVATE_ACCOUNT_REQUIRED", "payment_promise": "PAYMENT_ACTION_REQUIRED", "policy_claim": "UNSUPPORTED_POLICY_RISK"}


def verify(reply: Column, cases: Column, evidence_ids: Column, customer: Column, markers: dict[str, list[str]], least: float = 0.8, referenced_only: bool = False, check_answer: bool = False) -> Column:
    """A struct (codes, coverage): why a reply may not be sent (empty if it may), and how much of it the evidence has.

    ``cases`` is an array of (id, reply). With ``referenced_only`` only the cases that evidence_ids name count as evidence.
    """
    low = F.lower(reply)
    private = reply.rlike(r"(?i)@[a-z0-9_]+|https?://|www\.|[a-z0-9_.+-]+@[a-z0-9_.-]+\.[a-z]{2,}|\b[0-9]{7,}\b|(?:^|\s)/[a-z]{1,3}\b")
    ids = F.transform(cases, lambda c: c["id"])
    used = F.filter(cases, lambda c: F.array_contains(evidence_ids, c["id"])) if referenced_only else cases
    share = coverage(reply, F.transform(used, lambda c: c["reply"]))
    codes = [F.when(private, "PII_LEAK"), *(F.when(tx.any_contains(low, markers.get(group, [])), code) for group, code in MARKER_CODES.items())]
    codes += [
        F.when((F.trim(reply) == "") | (F.size(cases) == 0) | (F.size(evidence_ids) == 0), "MISSING_EVIDENCE"),
        F.when(F.size(F.array_except(evidence_ids, ids)) > 0, "INVALID_EVIDENCE_REFERENCE"),
        F.when(tx.coverage_failure(reply, customer) if check_answer else F.lit(False), "ANSWER_COVERAGE_FAILURE"),
        F.when(share < least, "GROUNDING_FAILURE"),
    ]
    return F.struct(F.array_distinct(F.array_compact(F.array(*codes))).alias("codes"), F.round(share, 6).alias("coverage"))


def fixed(rows: DataFrame, intent: str, reply: str) -> DataFrame:
    """The baseline that always escalates, with one intent and one reply."""
    return rows.select("*", F.lit(intent).alias("intent"), F.lit("ESCALATE").alias("action"), F.lit(reply).alias("reply"))


def prediction(rows: DataFrame) -> DataFrame:
    """Outputs as predictions: evidence is what a reply names, else the best case where the action is automatic."""
    top = F.when((F.col("action") == "AUTO_HANDLE") & (F.size("cases") > 0), F.array(F.col("cases")[0]["id"])).otherwise(F.slice(F.transform("cases", lambda c: c["id"]), 1, 0))
    ids = F.transform("cases", lambda c: c["id"])
    return rows.select("case_id", "action", "reply", ids.alias("retrieved_ids"), F.when(F.size("evidence_ids") > 0, F.col("evidence_ids")).otherwise(top).alias("evidence_ids"))


def decide(risk: Column, proof: Column, check: Column) -> tuple[Column, Column]:
    """Action and its reasons: anything that any gate says escalates."""
    all_reasons = F.array_distinct(F.concat(risk, proof, check))
    return F.when(F.size(all_reasons) == 0, "AUTO_HANDLE").otherwise("ESCALATE"), all_reasons
