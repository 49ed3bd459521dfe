"""Queries on the corpus's last steps: exact keys of threads, repeated decontamination, the freeze, and validation of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.durable import spread, written
from threadloom.operators import audits, freeze, gold, judging, metrics, sampling, splits, taxonomy, threads
from threadloom.plans.core_queries import ACTIONABLE, GENERIC, TAXONOMY
from threadloom.plans.evaluation_queries import _J, _judged, _raw
from threadloom.plans.registry import query
from threadloom.plans.retrieval_queries import leaks
from threadloom.plans.views import LEAK, MSGS, NORM, WORDS, messages
from threadloom.sources.tables import table

_KEYS = f"""{MSGS}, f AS (SELECT conv_id AS id, CASE conv_id % 3 WHEN 0 THEN 'TRAIN' WHEN 1 THEN 'DEVELOPMENT' ELSE 'GOLD' END AS split, inbound, turn, {LEAK.format('text')} AS t FROM m WHERE inbound IS NOT NULL),
 pre AS (SELECT id, split, substr(string_agg(t, ' ' ORDER BY turn), 1, 240) AS t FROM f WHERE inbound GROUP BY 1, 2),
 ks AS (SELECT DISTINCT id, split, CASE WHEN inbound THEN 'CUSTOMER' ELSE 'BRAND' END AS kind, sha256(t) AS key FROM f WHERE {WORDS.format('t')} >= CASE WHEN inbound THEN 1 ELSE 8 END UNION ALL SELECT id, split, 'CUSTOMER_PREFIX', sha256(t) FROM pre WHERE t <> '')"""


def _keys(spark: SparkSession, d: str, chars: int | None = None, least_brand: int = 8) -> DataFrame:
    m = messages(spark, d)
    m = m.withColumn("text", F.substr("text", F.lit(1), F.lit(chars))) if chars else m
    split = F.when(F.col("conv_id") % 3 == 0, "TRAIN").when(F.col("conv_id") % 3 == 1, "DEVELOPMENT").otherwise("GOLD")
    return written(splits.thread_keys(m, "conv_id", split, "inbound", "turn", "text", least_brand=least_brand))


@query("thread_keys", f"WITH {_KEYS} SELECT * FROM ks")
def thread_keys(spark: SparkSession, d: str) -> DataFrame:
    return _keys(spark, d)


#: Openings of turns, which threads do share.
_OPENINGS = _KEYS.replace(LEAK.format("text"), LEAK.format("substr(text, 1, 3)")).replace("ELSE 8 END", "ELSE 1 END")


@query("thread_collisions", f"WITH {_OPENINGS} SELECT kind, key, array_to_string(list_sort(list_distinct(list(split))), '|') AS splits, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids FROM ks GROUP BY 1, 2 HAVING count(DISTINCT split) > 1")
def thread_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Keys of several splits with all their threads, by the first three characters of turns."""
    found = splits.collisions_of(_keys(spark, d, 3, 1), ids_a_row=1_000_000)
    return found.select("kind", "key", F.array_join("splits", "|").alias("splits"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


# SQL has no loop that changes what the next step reads; the test holds it against the loop written out.
@query("decontaminate_near_repeated", None)
def decontaminate_near_repeated(spark: SparkSession, d: str) -> DataFrame:
    docs = leaks(spark, d)
    assigned = threads.nested(messages(spark, d)).select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 3 == 0, "TRAIN").when(F.col("conv_id") % 3 == 1, "DEVELOPMENT").otherwise("GOLD").alias("split"))
    return splits.decontaminate_near_repeated(assigned, docs)


def freezable(spark: SparkSession, d: str) -> DataFrame:
    """Documents as candidates: topics by intent rules, bins by length, every fourth a challenge."""
    docs = table(spark, d, "documents")
    flags = sampling.challenge_flags(F.col("text"), F.lit(False))
    texts = spread(docs.select("doc_id", "text"), "doc_id")  # the join with bins finds them dealt out: texts are shuffled once
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items())))
    bins = splits.time_bins(docs.select(F.col("doc_id").alias("id"), "n_chars"), "n_chars", "id", 8)
    hard = F.when(F.col("doc_id") % 4 == 0, "CHALLENGE").otherwise("REPRESENTATIVE")
    rows = texts.select(F.col("doc_id").alias("id"), hard.alias("bucket"), taxonomy.provisional_intent(F.col("text"), TAXONOMY).alias("topic"), names.alias("flags"), F.array(F.coalesce("text", F.lit(""))).alias("texts"))
    return rows.join(bins, "id")


# Each choice depends on all before; the test holds it against the plain greedy choice.
@query("freeze_rows", None)
def freeze_rows(spark: SparkSession, d: str) -> DataFrame:
    return freeze.freeze(freezable(spark, d), [i.name for i in TAXONOMY.intents], {"REPRESENTATIVE": 24, "CHALLENGE": 12}, "fz")


#: Labels with every fault, by what the id leaves when divided by 23; the frozen cases are the labelled documents and every eleventh document.
_FAULTS = {
    1: "NOT_HUMAN", 2: "NOT_FINALIZED", 3: "ANNOTATOR", 4: "REVIEWED_AT", 5: "REVIEWED_AT", 6: "INTENT", 7: "ACTION", 8: "DIFFICULTY", 9: "REASON", 10: "RISK_TAGS", 11: "NOT_FROZEN", 12: "THREAD", 13: "TAXONOMY_VERSION", 14: "SAMPLING_VERSION", 15: "SPLIT_VERSION",
}
CONTRACT = gold.Contract(("billing", "access"), ("AUTO_HANDLE", "ESCALATE"), ("EASY", "HARD"), ("PII", "PAYMENT"), "t1", "brand_0", 200)
_CASES = """k AS (SELECT DISTINCT doc_id FROM labels), q AS (SELECT doc_id, doc_id % 23 AS f FROM k), fz AS (SELECT doc_id FROM k WHERE doc_id % 23 <> 11 UNION SELECT doc_id FROM documents WHERE doc_id % 253 = 0)"""
_PLACE = {n: k for k, n in enumerate(["NOT_HUMAN", "NOT_FINALIZED", "ANNOTATOR", "REVIEWED_AT", "INTENT", "ACTION", "DIFFICULTY", "REASON", "RISK_TAGS", "NOT_FROZEN", "THREAD", "PROTECTED", "TAXONOMY_VERSION", "SAMPLING_VERSION", "SPLIT_VERSION", "TAXONOMY"], 6)}
_GOLD = f"""{_CASES}, e AS ({" UNION ALL ".join(f"SELECT {_PLACE[r]} AS place, '{r}' AS rule, doc_id AS case_id FROM q WHERE f = {k}" for k, r in _FAULTS.items())} UNION ALL SELECT {_PLACE['TAXONOMY']}, 'TAXONOMY', doc_id FROM q WHERE f = 13
 UNION ALL SELECT {_PLACE['PROTECTED']}, 'PROTECTED', doc_id FROM q WHERE f <> 11 AND f <> 12 AND doc_id % 29 = 3 UNION ALL SELECT {_PLACE['INTENT']}, 'INTENT', doc_id FROM q WHERE f = 10 UNION ALL SELECT 4, 'DUPLICATE_CASE', doc_id FROM q WHERE f = 16
 UNION ALL SELECT 1, 'CASE_COUNT', NULL WHERE (SELECT count(*) FROM fz) <> 200 UNION ALL SELECT 2, 'MANIFEST', NULL WHERE EXISTS (SELECT 1 FROM fz WHERE doc_id % 31 = 0) UNION ALL SELECT 3, 'BRAND', NULL UNION ALL SELECT 5, 'LABEL_COUNT', NULL WHERE NOT (SELECT count(*) + count(*) FILTER (f = 16) FROM q) BETWEEN 150 AND 250)"""


def _gold(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, known = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id").distinct()
    n = F.col("doc_id")
    thread = F.concat(F.lit("t"), n.cast("string"))
    usual = {
        "annotation_source": "human", "status": "FINALIZED", "annotator": "candidate", "reviewed_at": "2020-01-02T03:04:05+00:00", "gold_intent": "billing", "gold_action": "ESCALATE", "difficulty": "EASY", "gold_action_reason": "because", "risk_tags": "PII|",
        "taxonomy_version": "t1", "sampling_version": "s1", "split_version": "p1",
    }
    faults = {
        "annotation_source": {1: "AI"}, "status": {2: "DEFERRED"}, "annotator": {3: "x"}, "reviewed_at": {4: "2020-01-02T03:04:05", 5: "soon"}, "gold_intent": {6: "other", 10: "none"}, "gold_action": {7: "WAIT"}, "difficulty": {8: ""},
        "gold_action_reason": {9: " "}, "risk_tags": {10: "PII|ODD"}, "taxonomy_version": {13: "t0"}, "sampling_version": {14: "s0"}, "split_version": {15: "p0"},
    }
    value = lambda name: F.coalesce(*(F.when(n % 23 == k, v) for k, v in faults[name].items()), F.lit(usual[name]))
    rows = known.select(n.alias("case_id"), F.when(n % 23 == 12, "elsewhere").otherwise(thread).alias("thread_id"), *(value(c).alias(c) for c in usual))
    rows = rows.unionByName(rows.where("case_id % 23 = 16"))
    cases = known.where("doc_id % 23 <> 11").union(docs.where("doc_id % 253 = 0")).distinct()
    frozen = cases.select(n.alias("case_id"), thread.alias("thread_id"), *(F.lit(usual[v]).alias(v) for v in gold.VERSIONS))
    protected = docs.where("doc_id % 29 = 3").select(thread.alias("thread_id"))
    return gold.validate(rows, frozen, cases.where("doc_id % 31 <> 0").select(n.alias("case_id")), protected, CONTRACT, ("brand_0", "brand_1"))


@query("gold_errors", f"WITH {_GOLD} SELECT DISTINCT * FROM e")
def gold_errors(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d)[0]


@query("gold_validation", f"WITH {_GOLD} SELECT CASE WHEN count(*) = 0 THEN 'READY' ELSE 'BLOCKED' END AS status, (SELECT count(*) + count(*) FILTER (f = 16) FROM q) AS labels, (SELECT count(*) FROM fz) AS frozen, count(*) AS errors FROM (SELECT DISTINCT * FROM e)")
def gold_validation(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d)[1]


_ANY = lambda terms: "(" + " OR ".join(f"contains(norm, '{t}')" for t in terms) + ")"
#: Replies to their greeting: the first five characters, so that some repeat.
_REPLIES = f"""{MSGS}, o0 AS (SELECT message_id, brand, conv_id AS root, count(*) OVER (PARTITION BY conv_id) AS thread_size, inbound, {NORM.format('CASE WHEN conv_id % 2 = 0 THEN substr(text, 1, 4) ELSE text END')} AS norm FROM m),
 o AS (SELECT *, {_ANY(ACTIONABLE)} AS actionable, {_ANY(GENERIC)} AND NOT {_ANY(ACTIONABLE)} AND NOT contains(norm, '?') AS generic, {WORDS.format('norm')} >= 8 AS substantive FROM o0 WHERE NOT inbound),
 tc AS (SELECT brand, norm, count(*) AS n FROM o GROUP BY 1, 2), tt AS (SELECT brand, norm FROM tc QUALIFY row_number() OVER (PARTITION BY brand ORDER BY n DESC, norm) = 1)"""


def _replies(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).withColumn("text", F.when(F.col("conv_id") % 2 == 0, F.substr("text", F.lit(1), F.lit(4))).otherwise(F.col("text")))
    sizes = m.groupBy("conv_id").agg(F.count("*").alias("thread_size"))
    return m.join(sizes, "conv_id").withColumnRenamed("conv_id", "root")


@query("heuristic_samples", f"""WITH {_REPLIES}, ra AS (SELECT brand, 1 - count(DISTINCT norm) / count(*) AS r FROM o GROUP BY 1), hi AS (SELECT brand FROM ra ORDER BY r DESC, brand LIMIT 1), lo AS (SELECT brand FROM ra ORDER BY r, brand LIMIT 1),
 p AS (SELECT 'generic_or_redirect' AS category, brand, message_id FROM o WHERE generic AND brand = 'brand_1' UNION ALL SELECT 'substantive_actionable', brand, message_id FROM o WHERE substantive AND actionable AND brand = 'brand_1'
 UNION ALL SELECT 'high_template_collapse', brand, message_id FROM o JOIN tt USING (brand, norm) JOIN hi USING (brand) UNION ALL SELECT 'low_template_collapse', brand, message_id FROM o JOIN tt USING (brand, norm) JOIN lo USING (brand))
 SELECT category, brand, message_id, row_number() OVER (PARTITION BY category ORDER BY sha256('hv:' || category || ':' || brand || ':' || message_id), message_id) AS rank FROM p QUALIFY rank <= 6""")
def heuristic_samples(spark: SparkSession, d: str) -> DataFrame:
    return audits.heuristic_samples(_replies(spark, d).where(~F.col("inbound")), F.lit("brand_1"), ACTIONABLE, GENERIC, "hv", 6)


def _stratum(place: int, name: str) -> str:
    taken = " AND ".join(f"(brand, root) NOT IN (SELECT (brand, root) FROM s{k})" for k in range(place)) or "TRUE"
    return f"s{place} AS (SELECT brand, '{name}' AS category, root, {name} AS message_id FROM kn WHERE {name} IS NOT NULL AND {taken} QUALIFY row_number() OVER (PARTITION BY brand ORDER BY sha256('as:' || brand || ':{name}:' || root), root) <= 1)"


_STRATA = ("multi_turn", "high_public_containment", "generic_redirect", "repeated_template")


@query("thread_audit_strata", f"""WITH {_REPLIES}, kn AS (SELECT brand, root, min(message_id) FILTER (thread_size >= 3) AS multi_turn, min(message_id) FILTER (substantive AND NOT generic) AS high_public_containment, min(message_id) FILTER (generic) AS generic_redirect, max(message_id) FILTER (o.norm = tt.norm) AS repeated_template
 FROM o JOIN tt USING (brand) GROUP BY 1, 2), {', '.join(_stratum(k, n) for k, n in enumerate(_STRATA))} SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3""")
def thread_audit_strata(spark: SparkSession, d: str) -> DataFrame:
    return audits.audit_strata(_replies(spark, d), ACTIONABLE, GENERIC, "as", 1, strict=False)


_COHORTS = f"""{_J}, ow AS (SELECT * FROM jp WHERE system = 'revised'), ba AS (SELECT case_id FROM jp WHERE system = 'original' AND overall_pass), pl AS (SELECT 'critical_failures' AS cohort, case_id, 15 AS most FROM ow WHERE critical_failure UNION ALL SELECT 'noncritical_failures', case_id, 15 FROM ow WHERE NOT overall_pass AND NOT critical_failure
 UNION ALL SELECT 'passes', case_id, 10 FROM ow WHERE overall_pass UNION ALL SELECT 'baseline_pass_system_fail', case_id, 10 FROM ow WHERE NOT overall_pass AND case_id IN (SELECT case_id FROM ba)),
 co AS (SELECT cohort, case_id, row_number() OVER (PARTITION BY cohort ORDER BY sha256('co:' || cohort || ':' || case_id), case_id) AS rank, most FROM pl QUALIFY rank <= most),
 al AS (SELECT cohort, case_id, rank FROM co UNION ALL SELECT 'order_bias_flips', doc_id, NULL FROM documents WHERE n_chars % 3 <> 2 AND n_chars % 5 > 1 UNION ALL SELECT 'repeatability_disagreements', doc_id, NULL FROM documents WHERE doc_id % 7 = 0)"""


def _cohorts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), "n_chars")
    first = F.when(F.col("n_chars") % 3 == 2, "TIE").otherwise("A")
    # The same letter in both orders is another winner; a tie in both is none. Every second of five asks only once.
    asked = docs.select("case_id", F.explode(F.when(F.col("n_chars") % 5 > 1, F.array(F.lit("original"), F.lit("revised"))).otherwise(F.array(F.lit("original")))).alias("a_system"), first.alias("preference"))
    orders = asked.withColumn("b_system", F.when(F.col("a_system") == "original", "revised").otherwise("original"))
    run = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("run")
    runs = docs.select("case_id", run).select("case_id", *(F.when((F.col("case_id") % 7 == 0) & (F.col("run") == 2) & F.lit(n == "safety"), 5).otherwise(4).alias(n) for n in judging.SCORES), F.lit(True).alias("overall_pass"), F.lit(False).alias("critical_failure"))
    return audits.failure_cohorts(_judged(spark, d), orders, runs, "co", "revised", "original")


@query("judged_cohorts", f"WITH {_COHORTS} SELECT * FROM al")
def judged_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return _cohorts(spark, d)


_KINDS = ", ".join(f"('{k}', '{sign}')" for k, signs in audits.TAXONOMY.items() for sign in signs)


@query("failure_taxonomy", f"""WITH {_COHORTS}, sp AS (SELECT * FROM (VALUES {_KINDS}) v(category, sign)), sg AS (SELECT doc_id AS case_id, CASE WHEN n_chars % 2 = 0 THEN 'LOW_LEXICAL_ANSWER_COVERAGE' ELSE 'CRITICAL_LABEL_OUTSIDE_DECLARED_DEFINITION' END AS sign FROM documents UNION ALL SELECT case_id, cohort FROM al),
 cs AS (SELECT DISTINCT category, case_id FROM sg JOIN sp USING (sign)) SELECT k.category, count(case_id) AS n, coalesce(array_to_string(list_sort(list(case_id) FILTER (case_id IS NOT NULL))[1:5], ','), '') AS examples FROM (SELECT DISTINCT category FROM sp) k LEFT JOIN cs ON cs.category = k.category GROUP BY 1""")
def failure_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    signs = F.array(F.when(F.col("n_chars") % 2 == 0, "LOW_LEXICAL_ANSWER_COVERAGE").otherwise("CRITICAL_LABEL_OUTSIDE_DECLARED_DEFINITION"))
    found = audits.failure_taxonomy(table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), signs.alias("signals")), _cohorts(spark, d))
    return found.select("category", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@query("score_quantiles", "WITH q AS (SELECT unnest([0, 0.25, 0.5, 0.75, 1]::DOUBLE[]) AS quantile, unnest(a) AS a, unnest(b) AS b FROM (SELECT quantile_cont(n_chars::DOUBLE, [0, 0.25, 0.5, 0.75, 1]) AS a, quantile_cont((doc_id % 97)::DOUBLE, [0, 0.25, 0.5, 0.75, 1]) AS b FROM documents)) SELECT 'n_chars' AS column, quantile, round(a, 6) AS value FROM q UNION ALL SELECT 'number', quantile, round(b, 6) FROM q")
def score_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.quantiles(table(spark, d, "documents").select("n_chars", (F.col("doc_id") % 97).alias("number")), ["n_chars", "number"])


@query("case_metadata", """SELECT doc_id AS case_id, CASE doc_id % 2 WHEN 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS revised_action, lang AS predicted_intent, CASE WHEN n_chars > 500 THEN 'True' ELSE 'False' END AS evidence_sufficient, CASE WHEN contains(text, '@') THEN 'True' ELSE 'False' END AS risk_presence, CASE WHEN doc_id % 5 = 0 THEN 'True' ELSE 'False' END AS changed,
 CASE WHEN (doc_id % 10) / 10.0 < 0.5 THEN 'LOW_<0.50' WHEN (doc_id % 10) / 10.0 < 0.6 THEN 'MID_0.50_0.60' ELSE 'HIGH_>=0.60' END AS retrieval_score_bucket, CASE WHEN (doc_id % 8) / 8.0 < 0.5 THEN 'LOW_<0.50' WHEN (doc_id % 8) / 8.0 < 0.75 THEN 'MID_0.50_0.75' ELSE 'HIGH_>=0.75' END AS intent_confidence_bucket FROM documents""")
def case_metadata(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    tags = F.when(F.contains("text", F.lit("@")), F.array(F.lit("PII"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "documents").select(n.alias("case_id"), F.when(n % 2 == 0, "ESCALATE").otherwise("AUTO_HANDLE").alias("action"), F.col("lang").alias("intent"), (F.col("n_chars") > 500).alias("sufficient"), tags.alias("tags"), (n % 5 == 0).alias("changed"), ((n % 10) / 10.0).alias("score"), ((n % 8) / 8.0).alias("confidence"))
    return audits.case_metadata(rows)


@query("cached_judging", """WITH r AS (SELECT doc_id, doc_id % 10 AS k, doc_id % 4 = 0 AS cached, doc_id % 9 <> 4 AS answered FROM documents), x AS (SELECT *, cached OR answered AS has, (cached OR answered) AND k IN (7, 9) AS good FROM r)
 SELECT count(*) AS requests, count(*) FILTER (cached) AS cache_hits, count(*) FILTER (has AND NOT cached) AS calls, count(*) FILTER (NOT good) AS failures, coalesce(sum(CASE WHEN has THEN doc_id % 3 END), 0)::BIGINT AS retries, count(*) FILTER (good AND k = 7) AS pass_rule_corrections, (SELECT count(*) FROM x WHERE good AND NOT cached) AS new_entries FROM x""")
def cached_judging(spark: SparkSession, d: str) -> DataFrame:
    """Requests of which a quarter is cached and some get no answer; answers have every fault."""
    requests = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("reply"))
    said = requests.join(_raw(spark, d), "doc_id").select("doc_id", "reply", "raw", (F.col("doc_id") % 3).alias("retries"))
    said = written(said.withColumn("cache_key", judging.cache_key(said, ["doc_id", "reply"])))
    known = said.where("doc_id % 4 = 0").select("cache_key", "raw", "retries")
    _, new, stats = judging.cached_evaluation(requests, known, said.where("doc_id % 9 <> 4").select("cache_key", "raw", "retries"), ["doc_id", "reply"])
    return stats.join(F.broadcast(new.agg(F.count("*").alias("new_entries"))))  # one row each


#: Error messages by the last digit of the id.
_ERRORS = ["Rate limit reached. Try again in 1.5s", "Limit: tokens per day", "TPD used up, try again in 2m", "tpdx", "Parsing failed.", "failed_generation", "try again in 300ms", "", "server error", "Tokens Per Day: try again in 1h"]
_SECONDS = [1.5, None, 120.0, None, None, None, 0.3, None, None, 3600.0]


@query("provider_errors", f"""WITH x AS (SELECT doc_id, [{', '.join(f"'{e}'" for e in _ERRORS)}][doc_id % 10 + 1] AS said, CASE WHEN doc_id % 3 = 0 THEN 400 ELSE 429 END AS status FROM documents)
 SELECT doc_id, regexp_matches(lower(said), 'tokens per day|\\btpd\\b') AS daily, status = 400 AND regexp_matches(lower(said), 'parsing failed|failed_generation') AS transient, [{', '.join('NULL' if x is None else f'{x}::DOUBLE' for x in _SECONDS)}][doc_id % 10 + 1] AS wait FROM x""")
def provider_errors(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select("doc_id", F.get(F.array(*map(F.lit, _ERRORS)), (n % 10).cast("int")).alias("said"), F.when(n % 3 == 0, 400).otherwise(429).alias("status"))
    said = F.col("said")
    return rows.select("doc_id", tx.daily_quota(said).alias("daily"), tx.transient_failure(F.col("status"), said).alias("transient"), tx.retry_seconds(said).alias("wait"))
