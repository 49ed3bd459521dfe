"""Samples for people to audit: heuristics on messages, strata of threads, cohorts of judged failures, and what failures come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.durable import written
from threadloom.operators import profile
from threadloom.operators.judging import SCORES


def _first(rows: DataFrame, by: list[str], rank: Column, key: str, n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(rank, key)
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)


def heuristic_samples(messages: DataFrame, selected: Column, actionable: list[str], generic: list[str], seed: str, n: int, least: int = 1) -> DataFrame:
    """category, brand, message_id, rank: replies on which people check the heuristics, the first n of each category in hash order.

    Of the brand that ``selected`` names: replies that are generic, and such as are substantive and actionable. Of the brands with the highest
    and the lowest share of repeated replies (at least ``least`` messages): replies with their most frequent template. ``messages`` are replies with
    message_id, brand and text.
    """
    rows = written(messages.select("message_id", "brand", tx.normalized_reply(F.col("text")).alias("norm")).withColumns(profile.reply_flags(F.col("norm"), actionable, generic)))
    own = rows.where(F.col("brand") == selected)
    counts = rows.groupBy("brand").agg(F.count("*").alias("n"), F.count_distinct("norm").alias("different")).where(F.col("n") >= least)
    ends = profile.extreme(counts.select("brand", (1 - F.col("different") / F.col("n")).alias("repeated")), "repeated")
    sides = ends.select(F.explode(F.array(*(F.struct(F.lit(f"{name}_template_collapse").alias("category"), F.col(f"{name}est").alias("brand")) for name in ("high", "low")))).alias("x")).select("x.*")
    top = profile.top_templates(rows, "brand", "norm").select("brand", F.col("template").alias("norm"))
    collapsed = rows.join(top, ["brand", "norm"]).join(F.broadcast(sides), "brand")  # two rows
    named = lambda test, name: own.where(test).withColumn("category", F.lit(name))
    pool = [named(F.col("generic"), "generic_or_redirect"), named(F.col("substantive") & F.col("actionable"), "substantive_actionable"), collapsed]
    pool = [p.select("category", "brand", "message_id") for p in pool]
    both = pool[0].unionByName(pool[1]).unionByName(pool[2])
    return _first(both, ["category"], tx.hash_rank(seed, F.col("category"), F.col("brand"), F.col("message_id")), "message_id", n)


def audit_strata(messages: DataFrame, actionable: list[str], generic: list[str], seed: str, n: int, strict: bool = True) -> DataFrame:
    """brand, category, root, message_id: for each brand n threads of each category, with the reply that stands for the thread.

    Categories, in this order, without a thread of an earlier one: multi_turn (threads of three messages or more, the brand's first reply there),
    high_public_containment and generic_redirect (the first such reply), repeated_template (the last reply with the brand's most frequent text). In each,
    the first in hash order. With ``strict``, too few of a brand are an error. ``messages`` has root and thread_size.
    """
    out = messages.where(~F.col("inbound")).select("brand", "root", "thread_size", "message_id", tx.normalized_reply(F.col("text")).alias("norm"))
    out = written(out.withColumns(profile.reply_flags(F.col("norm"), actionable, generic)))
    top = profile.top_templates(out, "brand", "norm").select("brand", F.col("template"))
    known = out.join(top, "brand").groupBy("brand", "root").agg(
        F.min(F.when(F.col("thread_size") >= 3, F.col("message_id"))).alias("multi_turn"), F.min(F.when(F.col("contained"), F.col("message_id"))).alias("high_public_containment"),
        F.min(F.when(F.col("generic"), F.col("message_id"))).alias("generic_redirect"), F.max(F.when(F.col("norm") == F.col("template"), F.col("message_id"))).alias("repeated_template"),
    )
    known = written(known)
    free, found = known, None
    for category in ("multi_turn", "high_public_containment", "generic_redirect", "repeated_template"):
        rank = tx.hash_rank(seed, F.col("brand"), F.lit(category), F.col("root"))
        taken = written(_first(free.where(F.col(category).isNotNull()), ["brand"], rank, "root", n).select("brand", F.lit(category).alias("category"), "root", F.col(category).alias("message_id")))
        enough = taken.groupBy("brand").agg(F.count("*").alias("n")).where(F.col("n") == n)
        short = known.select("brand").distinct().join(enough, "brand", "left_anti").limit(1).collect() if strict else []
        if short:
            raise ValueError(f"{short[0].brand} has fewer than {n} threads of the category {category}")
        found = taken if found is None else found.unionByName(taken)
        free = free.join(taken.select("brand", "root"), ["brand", "root"], "left_anti")
    return found


def failure_cohorts(judged: DataFrame, orders: DataFrame, runs: DataFrame, seed: str, system: str, baseline: str, sizes: tuple[int, int, int, int] = (15, 15, 10, 10)) -> DataFrame:
    """cohort, case_id, rank: critical failures, other failures and passes of a system, cases that it fails and the baseline passes (each the first in
    hash order), all cases whose winner changes with the order of the two answers, and all whose runs disagree in any score or flag.

    ``orders`` has case_id, a_system, b_system and preference (A, B or TIE); ``runs`` case_id, and the scores and flags of each run.
    """
    own, other = judged.where(F.col("system") == system), judged.where(F.col("system") == baseline)
    gap = own.where(~F.col("overall_pass")).join(other.where("overall_pass").select("case_id"), "case_id", "left_semi")
    pools = {"critical_failures": own.where("critical_failure"), "noncritical_failures": own.where(~F.col("overall_pass") & ~F.col("critical_failure")), "passes": own.where("overall_pass"), "baseline_pass_system_fail": gap}
    found = None
    for (name, pool), n in zip(pools.items(), sizes):
        rows = pool.select(F.lit(name).alias("cohort"), "case_id")
        rows = _first(rows, ["cohort"], tx.hash_rank(seed, F.col("cohort"), F.col("case_id")), "case_id", n)
        found = rows if found is None else found.unionByName(rows)
    winner = F.when(F.col("preference") == "A", F.col("a_system")).when(F.col("preference") == "B", F.col("b_system")).otherwise("TIE")
    apart = [F.count_distinct(c) > 1 for c in (*SCORES, "overall_pass", "critical_failure")]
    disagree = apart[0]
    for test in apart[1:]:
        disagree = disagree | test
    whole = {"order_bias_flips": orders.groupBy("case_id").agg((F.count_distinct(winner) > 1).alias("x")), "repeatability_disagreements": runs.groupBy("case_id").agg(disagree.alias("x"))}
    for name, rows in whole.items():
        found = found.unionByName(rows.where("x").select(F.lit(name).alias("cohort"), "case_id", F.lit(None).cast("bigint").alias("rank")))
    return found


#: Which signals and cohorts make up each kind of failure.
TAXONOMY = {
    "EXTRACTIVE_GROUNDING_JUDGE_CONFLICT": ["EXACT_EXTRACTIVE_REPLY_MARKED_UNGROUNDED"], "REPLY_LOW_ANSWER_COVERAGE": ["LOW_LEXICAL_ANSWER_COVERAGE"], "REPLY_TOO_GENERIC_OR_CONTEXT_REDUNDANT": ["GENERIC_OR_CONTEXT_REDUNDANT_QUESTION"],
    "CRITICAL_LABEL_PROTOCOL_VIOLATION": ["CRITICAL_LABEL_OUTSIDE_DECLARED_DEFINITION", "CRITICAL_ACTION_LABEL_DISPUTED_BY_EXACT_EVIDENCE"], "JUDGE_GENERIC_REPLY_BIAS": ["baseline_pass_system_fail"],
    "JUDGE_REPEATABILITY_INSTABILITY": ["repeatability_disagreements"], "JUDGE_POSITION_INSTABILITY": ["order_bias_flips"], "REPLY_INCOMPLETE_SURFACE_FORM": ["INCOMPLETE_SURFACE_FORM"],
}


def failure_taxonomy(signals: DataFrame, cohorts: DataFrame) -> DataFrame:
    """category, n, examples: how many cases show each kind of failure, zeros included, and the first five by id. ``signals`` has case_id and signals (array);
    ``cohorts`` cohort and case_id."""
    spark = signals.sparkSession
    spec = spark.createDataFrame([(k, sign) for k, names in TAXONOMY.items() for sign in names], "category string, sign string")
    signs = signals.select("case_id", F.explode("signals").alias("sign")).unionByName(cohorts.select("case_id", F.col("cohort").alias("sign")))
    cases = signs.join(F.broadcast(spec), "sign").select("category", "case_id").distinct()
    few = _first(cases, ["category"], F.col("case_id"), "case_id", 5).groupBy("category").agg(F.array_sort(F.collect_list("case_id")).alias("examples"))
    counts = cases.groupBy("category").agg(F.count("*").alias("n"))
    return spec.select("category").distinct().join(counts, "category", "left").join(few, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.array().cast(few.schema["examples"].dataType)).alias("examples"))


def case_metadata(rows: DataFrame) -> DataFrame:
    """case_id and what missing cases are compared by, as text. ``rows`` has case_id, action, intent, sufficient, tags (array), changed, score and confidence."""
    size = lambda c, low, high: F.when(F.col(c) < low, f"LOW_<{low:.2f}").when(F.col(c) < high, f"MID_{low:.2f}_{high:.2f}").otherwise(f"HIGH_>={high:.2f}")
    said = lambda test: F.when(test, "True").otherwise("False")
    return rows.select("case_id", F.col("action").alias("revised_action"), F.col("intent").alias("predicted_intent"), said(F.col("sufficient")).alias("evidence_sufficient"), said(F.size("tags") > 0).alias("risk_presence"), said(F.col("changed")).alias("changed"), size("score", 0.5, 0.6).alias("retrieval_score_bucket"), size("confidence", 0.5, 0.75).alias("intent_confidence_bucket"))
