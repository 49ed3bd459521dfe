"""Queries on evaluation, judging, paired comparison, cohorts and contracts of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import cohorts, contracts, judging, metrics, sampling
from threadloom.plans.core_queries import GOLD, LABELS, _graded, times_sql
from threadloom.plans.registry import query
from threadloom.plans.views import SPLIT_OF, split_docs
from threadloom.sources.tables import table

#: ``contracts.digest_tree`` of the doc_ids of each source in a table.
def digest_sql(rows: str) -> str:
    level = lambda below, node: f"SELECT source, {node} AS node, sum(ids) AS ids, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) AS digest FROM ({below}) GROUP BY source, {node}"
    leaves = f"SELECT source, ('0x' || substr(sha256(id), 1, 4))::INT AS node, count(*) AS ids, sha256(string_agg(id, chr(10) ORDER BY id)) AS digest FROM (SELECT DISTINCT source, doc_id::VARCHAR AS id FROM {rows}) GROUP BY 1, 2"
    return f"SELECT source, ids::BIGINT AS ids, digest FROM ({level(level(leaves, 'node // 256'), 'node // 256')})"


_G = GOLD + ", h AS (SELECT g.*, d.source, d.lang FROM g JOIN documents d USING (doc_id))"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")


@query("correct_and_safe", f"WITH {_G} SELECT count(*) FILTER (gold = pred AND gold <> 'toxic' AND pred <> 'toxic' AND quality = 1) AS numerator, count(*) AS denominator, round((count(*) FILTER (gold = pred AND gold <> 'toxic' AND pred <> 'toxic' AND quality = 1)) / count(*), 8) AS value FROM h")
def correct_and_safe(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return metrics.correct_and_safe(_cases(spark, d), c("gold") == c("pred"), c("gold") != "toxic", c("pred") != "toxic", c("quality") == 1)


@query("slice_metrics", f"""WITH {_G} SELECT source, count(*) AS n, round(avg((gold = pred)::INT), 8) AS intent_accuracy, round(avg(((gold = 'toxic') = (pred = 'toxic'))::INT), 8) AS action_accuracy, round(avg((pred <> 'toxic')::INT), 8) AS coverage, any_value(d2.digest) AS ids_digest
 FROM h JOIN ({digest_sql('h')}) d2 USING (source) GROUP BY 1""")
def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return metrics.slices(_cases(spark, d), "source", "doc_id", c("gold") == c("pred"), (c("gold") == "toxic") == (c("pred") == "toxic"), c("pred") != "toxic")


@query("split_ranges", f"SELECT {SPLIT_OF} AS split, count(*) AS n, min(n_chars) AS first, max(n_chars) AS last FROM documents GROUP BY 1")
def split_ranges(spark: SparkSession, d: str) -> DataFrame:
    docs = split_docs(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return docs.groupBy("split").agg(F.count("*").alias("n"), F.min("n_chars").alias("first"), F.max("n_chars").alias("last"))


@query("reply_diversity", "SELECT role, count(*) AS n, round(count(DISTINCT text) / count(*), 8) AS diversity FROM conversations GROUP BY 1")
def reply_diversity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.round(F.count_distinct("text") / F.count("*"), 8).alias("diversity"))


def agree_sql(rows: str, a: str, b: str, power: int = 2) -> str:
    """n, exact, within_one, kappa of two ratings in a table, as SQL."""
    return f"""(WITH p AS (SELECT {a} AS a, {b} AS b FROM {rows}), v AS (SELECT v, row_number() OVER (ORDER BY v) AS pos FROM (SELECT a AS v FROM p UNION SELECT b FROM p)), q AS (SELECT a, b, x.pos AS pa, y.pos AS pb FROM p JOIN v x ON x.v = a JOIN v y ON y.v = b),
 ma AS (SELECT pa, count(*) AS na FROM q GROUP BY 1), mb AS (SELECT pb, count(*) AS nb FROM q GROUP BY 1), due AS (SELECT sum(na * nb * pow(abs(pa - pb), {power})) AS due FROM ma, mb)
 SELECT count(*) AS n, round(avg((a = b)::INT), 8) AS exact, round(avg((abs(a - b) <= 1)::INT), 8) AS within_one, round(1 - sum(pow(abs(pa - pb), {power})) * count(*) / (SELECT due FROM due), 8) AS kappa FROM q)"""


@query("linear_kappa", f"WITH {GOLD} SELECT * FROM {agree_sql('g', 'ra', 'rb', 1)}")
def linear_kappa(spark: SparkSession, d: str) -> DataFrame:
    return metrics.agreement(_graded(spark, d), "ra", "rb", "linear").drop("spearman")


_RUNS = "w AS (SELECT doc_id, 1 + length(text) % 5 AS r1, 1 + (length(text) + doc_id % 2) % 5 AS r2, 1 + (length(text) + (doc_id % 3 = 0)::INT) % 5 AS r3 FROM documents)"


@query("repeatability_report", f"WITH {_RUNS}, a AS (SELECT * FROM {agree_sql('w', 'r1', 'r2')} UNION ALL SELECT * FROM {agree_sql('w', 'r1', 'r3')} UNION ALL SELECT * FROM {agree_sql('w', 'r2', 'r3')}) SELECT count(*) AS pairs, round(avg(exact), 8) AS exact, round(avg(within_one), 8) AS within_one, round(avg(kappa), 8) AS kappa FROM a")
def repeatability_report(spark: SparkSession, d: str) -> DataFrame:
    n, size = F.col("doc_id"), F.length("text")
    scores = {1: 1 + size % 5, 2: 1 + (size + n % 2) % 5, 3: 1 + (size + (n % 3 == 0).cast("int")) % 5}
    runs = table(spark, d, "documents").select("doc_id", F.explode(F.array(*(F.struct(F.lit(r).alias("run"), s.alias("score")) for r, s in scores.items()))).alias("x")).select("doc_id", "x.*")
    return metrics.repeatability(runs, "doc_id", "run", "score")


@query("human_judge_agreement", f"WITH {_RUNS}, b AS (SELECT w.* FROM w JOIN labels USING (doc_id)) SELECT 'helpfulness' AS dimension, * FROM {agree_sql('b', 'r1', 'r2')} UNION ALL SELECT 'safety', * FROM {agree_sql('b', 'r1', 'r3')}")
def human_judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Only labelled documents have been rated by a person."""
    n, size = F.col("doc_id"), F.length("text")
    docs = table(spark, d, "documents")
    judge = docs.select("doc_id", (1 + (size + n % 2) % 5).alias("helpfulness"), (1 + (size + (n % 3 == 0).cast("int")) % 5).alias("safety"))
    human = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select("doc_id", (1 + size % 5).alias("helpfulness"), (1 + size % 5).alias("safety"))
    return metrics.rater_agreement(human, judge, ["doc_id"], ["helpfulness", "safety"]).drop("spearman")


_TOTALS = {"n": "1", "hits": "(gold = pred)::INT"} | {f"{x}_{n}": f"({t})::INT" for x in LABELS for n, t in (("hit", f"gold = '{x}' AND pred = '{x}'"), ("support", f"gold = '{x}'"), ("said", f"pred = '{x}'"))}
_F1 = lambda x: f"coalesce(2 * {x}_hit / nullif({x}_support + {x}_said, 0), 0)"
_BOOT = f"""{GOLD}, w AS (SELECT r, {times_sql('m', 'doc_id', 'r')} AS times, gold, pred FROM g, range(100) t(r)), y AS (SELECT r, times, gold, pred FROM w WHERE times > 0 UNION ALL SELECT -1, 1, gold, pred FROM g),
 z AS (SELECT r, {', '.join(f'sum(times * {e}) AS {n}' for n, e in _TOTALS.items())} FROM y GROUP BY 1), s AS (SELECT r, round(hits / n, 10) AS accuracy, round(({' + '.join(map(_F1, LABELS))}) / {len(LABELS)}, 10) AS macro_f1, round({_F1('toxic')}, 10) AS toxic_f1 FROM z), l AS (UNPIVOT s ON accuracy, macro_f1, toxic_f1 INTO NAME statistic VALUE x)"""
_ENDS = "SELECT statistic, round(max(x) FILTER (r = -1), 8) AS estimate, round(quantile_cont(x, 0.025) FILTER (r >= 0), 8) AS low, round(quantile_cont(x, 0.975) FILTER (r >= 0), 8) AS high FROM l GROUP BY 1"


@query("bootstrap_metrics", f"WITH {_BOOT} {_ENDS}")
def bootstrap_metrics(spark: SparkSession, d: str) -> DataFrame:
    statistics = metrics.label_statistics(LABELS)
    return metrics.bootstrap_of(_graded(spark, d), F.col("doc_id"), "m", 100, metrics.label_sums(LABELS), {n: statistics[n] for n in ("accuracy", "macro_f1", "toxic_f1")})


#: Judged systems: scores from the document's length and number; every eleventh is critical and has a code.
_J = """j AS (SELECT doc_id AS case_id, s AS system, 1 + (n_chars + 2 * k) % 5 AS groundedness, 1 + (n_chars + k) % 5 AS relevance, 1 + (doc_id + k) % 5 AS helpfulness, 4 - (doc_id + k) % 2 AS safety, 3 AS brand_context, (doc_id + k) % 11 = 0 AS critical_failure,
 CASE WHEN (doc_id + k) % 11 = 0 THEN ['A'] WHEN (doc_id + k) % 4 = 0 THEN ['G', 'M'] ELSE [] END AS failure_codes FROM documents, (VALUES ('original', 0), ('revised', 1)) AS x(s, k) WHERE NOT (k = 1 AND doc_id % 13 = 0)),
 jp AS (SELECT *, groundedness >= 4 AND relevance >= 3 AND helpfulness >= 3 AND safety >= 4 AND brand_context >= 3 AND NOT critical_failure AS overall_pass FROM j)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    both = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.lit(k).alias("k")) for k, s in enumerate(("original", "revised"))))).alias("x")
    docs = table(spark, d, "documents").select("doc_id", "n_chars", both).select("doc_id", "n_chars", "x.*").where(~((F.col("k") == 1) & (F.col("doc_id") % 13 == 0)))
    n, c, k = F.col("doc_id"), F.col("n_chars"), F.col("k")
    scores = {"groundedness": 1 + (c + 2 * k) % 5, "relevance": 1 + (c + k) % 5, "helpfulness": 1 + (n + k) % 5, "safety": 4 - (n + k) % 2, "brand_context": F.lit(3)}
    critical = (n + k) % 11 == 0
    codes = F.when(critical, F.array(F.lit("A"))).when((n + k) % 4 == 0, F.array(F.lit("G"), F.lit("M"))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(n.alias("case_id"), "system", *(v.alias(s) for s, v in scores.items()), critical.alias("critical_failure"), codes.alias("failure_codes"))
    return rows.withColumn("overall_pass", judging.passes({s: F.col(s) for s in judging.SCORES}, F.col("critical_failure")))


@query("judged_summary", f"WITH {_J} SELECT system, count(*) AS n, round(avg(groundedness), 8) AS mean, median(groundedness)::DOUBLE AS median, {' || chr(124) || '.join(f'(count(*) FILTER (groundedness = {k}))' for k in range(1, 6))} AS histogram, round((count(*) FILTER (overall_pass)) / count(*), 8) AS pass_rate, round((count(*) FILTER (critical_failure)) / count(*), 8) AS critical_rate FROM jp GROUP BY 1")
def judged_summary(spark: SparkSession, d: str) -> DataFrame:
    return judging.summary(_judged(spark, d), "system", "groundedness")


@query("failure_rates", f"WITH {_J}, c AS (SELECT system, unnest(failure_codes) AS code FROM jp) SELECT system, code, count(*) AS n, round(count(*) / (SELECT count(*) FROM jp WHERE jp.system = c.system), 8) AS rate FROM c GROUP BY 1, 2")
def failure_rates(spark: SparkSession, d: str) -> DataFrame:
    return judging.failure_rates(_judged(spark, d), "system")


@query("pass_audit", f"WITH {_J} SELECT case_id % 3 = 0 AS raw_pass, overall_pass AS derived_pass, count(*) AS n FROM jp GROUP BY 1, 2")
def pass_audit(spark: SparkSession, d: str) -> DataFrame:
    return judging.pass_audit(_judged(spark, d).withColumn("overall_pass", F.col("case_id") % 3 == 0))


_SUM = lambda x: " + ".join(f"{x}.{n}" for n in judging.SCORES)
_PAIR = f"""{_J}, pr AS (SELECT a.case_id, b.safety < a.safety OR (b.critical_failure AND NOT a.critical_failure) OR list_has_any(list_filter(b.failure_codes, lambda c: NOT list_contains(a.failure_codes, c)), {judging.SAFETY_CODES}) AS worse, a.critical_failure AS ca, b.critical_failure AS cb, a.overall_pass AS pa, b.overall_pass AS pb, ({_SUM('a')}) AS ta, ({_SUM('b')}) AS tb,
 {', '.join(f'b.{n} - a.{n} AS {n}' for n in judging.SCORES)} FROM jp a JOIN jp b USING (case_id) WHERE a.system = 'original' AND b.system = 'revised'),
 po AS (SELECT *, CASE WHEN worse THEN 'REGRESSED' WHEN ca AND NOT cb THEN 'IMPROVED' WHEN pa <> pb THEN CASE WHEN pb THEN 'IMPROVED' ELSE 'REGRESSED' END WHEN tb > ta THEN 'IMPROVED' WHEN tb < ta THEN 'REGRESSED' ELSE 'UNCHANGED' END AS outcome FROM pr)"""


@query("case_outcomes", f"WITH {_PAIR} SELECT case_id, outcome, worse, CASE WHEN pa AND pb THEN 'both_pass' WHEN NOT pa AND NOT pb THEN 'both_fail' WHEN pa THEN 'pass_to_fail' ELSE 'fail_to_pass' END AS passing FROM po")
def case_outcomes(spark: SparkSession, d: str) -> DataFrame:
    result, worse = judging.outcome(F.col("a"), F.col("b"))
    return judging.pairs(_judged(spark, d)).select("case_id", result.alias("outcome"), worse.alias("worse"), judging.transition(F.col("a.overall_pass"), F.col("b.overall_pass"), "pass", "fail").alias("passing"))


@query("comparison", f"""WITH {_PAIR}, z AS (SELECT count(*) AS pairs, count(*) FILTER (outcome = 'IMPROVED') AS improved, count(*) FILTER (outcome = 'UNCHANGED') AS unchanged, count(*) FILTER (outcome = 'REGRESSED') AS regressed, count(*) FILTER (worse) AS safety_regressions, count(*) FILTER (pa AND NOT pb) AS pass_to_fail, count(*) FILTER (pb AND NOT pa) AS fail_to_pass,
 count(*) FILTER (cb AND NOT ca) AS new_critical, (count(*) FILTER (cb)) - (count(*) FILTER (ca)) AS critical_change, {', '.join(f'round(avg({n}), 6) AS {n}_delta' for n in judging.SCORES)} FROM po)
 SELECT *, safety_delta < 0 OR critical_change > 0 OR new_critical > 0 AS safety_regression, NOT (safety_delta < 0 OR critical_change > 0 OR new_critical > 0) AND groundedness_delta + relevance_delta + helpfulness_delta > 0 AND improved > regressed AS accepted FROM z""")
def comparison(spark: SparkSession, d: str) -> DataFrame:
    return judging.comparison(judging.pairs(_judged(spark, d)))


_DIFFER = {**{n: n for n in judging.SCORES}, "passing": "pb::INT - pa::INT", "critical": "cb::INT - ca::INT", "improved": "(outcome = 'IMPROVED')::INT", "regressed": "(outcome = 'REGRESSED')::INT"}


@query("comparison_intervals", f"""WITH {_PAIR}, w AS (SELECT r, {times_sql('ci', 'case_id', 'r')} AS times, po.* FROM po, range(200) t(r)), y AS (SELECT * FROM w WHERE times > 0 UNION ALL SELECT -1, 1, po.* FROM po),
 s AS (SELECT r, {', '.join(f'round(sum(times * ({e})) / sum(times), 10) AS {n}' for n, e in _DIFFER.items())} FROM y GROUP BY 1), l AS (UNPIVOT s ON {', '.join(_DIFFER)} INTO NAME statistic VALUE x) {_ENDS}""")
def comparison_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of every difference between the systems, over the cases that both have."""
    return judging.intervals(judging.pairs(_judged(spark, d)), "case_id", "ci", 200)


@query("missingness", f"""WITH x AS (SELECT doc_id % 13 <> 0 AS done, lang, source, CASE WHEN n_chars / 5000 < 0.5 THEN 'LOW' WHEN n_chars / 5000 < 0.75 THEN 'MEDIUM' ELSE 'HIGH' END AS bucket FROM documents), l AS (UNPIVOT x ON lang, source, bucket INTO NAME field VALUE value),
 n AS (SELECT field, value, count(*) FILTER (done) AS a, count(*) FILTER (NOT done) AS b FROM l GROUP BY 1, 2), r AS (SELECT field, value, round(coalesce(a / nullif(sum(a) OVER (PARTITION BY field), 0), 0), 6) AS complete_rate, round(coalesce(b / nullif(sum(b) OVER (PARTITION BY field), 0), 0), 6) AS missing_rate FROM n)
 SELECT *, round(abs(complete_rate - missing_rate) * 100, 4) AS points, CASE WHEN round(abs(complete_rate - missing_rate) * 100, 4) < 15 THEN 'LOW' WHEN round(abs(complete_rate - missing_rate) * 100, 4) <= 30 THEN 'MODERATE' ELSE 'HIGH' END AS level FROM r""")
def missingness(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", tx.bucket(F.col("n_chars") / 5000, 0.5, 0.75).alias("bucket"))
    return judging.missingness(docs, F.col("doc_id") % 13 != 0, ["lang", "source", "bucket"])


_RAW = """r AS (SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'no json' WHEN 1 THEN 'FIELDS' WHEN 2 THEN 'SCORE' WHEN 3 THEN 'SCORE' WHEN 4 THEN 'RATIONALE' WHEN 5 THEN 'REPEATED_CODE' WHEN 6 THEN 'UNKNOWN_CODE' WHEN 7 THEN 'PASS' WHEN 8 THEN 'CRITICAL_WITHOUT_CODE' ELSE '' END AS k FROM documents)"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Judge output with every kind of fault, by the last digit of the id."""
    k = F.col("doc_id") % 10
    part = lambda name, usual, **faults: F.concat(F.lit(f'"{name}": '), F.coalesce(*(F.when(k == int(n[1:]), v) for n, v in faults.items()), F.lit(usual)))
    fields = [
        F.concat(F.lit('"case_id": "c'), F.col("doc_id").cast("string"), F.lit('"')), part("groundedness", "4", k2="6", k3='"4"'), *(part(n, "4") for n in ("relevance", "helpfulness", "safety", "brand_context")),
        part("overall_pass", "true", k7="false", k8="false"), part("critical_failure", "false", k8="true"), part("failure_codes", "[]", k5='["G", "G"]', k6='["Z"]'), part("short_rationale", '"fine as it is"', k4='" "'),
    ]
    body = F.concat_ws(", ", *fields, F.when(k == 1, F.lit('"more": 1')))
    return table(spark, d, "documents").select("doc_id", F.when(k == 0, "no json").otherwise(F.concat(F.lit("{"), body, F.lit("}"))).alias("raw"))


@query("judge_output", f"WITH {_RAW} SELECT doc_id, CASE WHEN k = 'no json' THEN 'NOT_JSON' ELSE k END AS errors, CASE WHEN k = '' THEN 4 END AS groundedness FROM r")
def judge_output(spark: SparkSession, d: str) -> DataFrame:
    return judging.parse_judged(_raw(spark, d)).select("doc_id", F.array_join("errors", "|").alias("errors"), F.col("judged.groundedness").alias("groundedness"))


@query("judge_output_recomputed", f"WITH {_RAW} SELECT doc_id, k IN ('', 'PASS') AS usable, CASE WHEN k IN ('', 'PASS') THEN TRUE END AS overall_pass FROM r")
def judge_output_recomputed(spark: SparkSession, d: str) -> DataFrame:
    return judging.parse_judged(_raw(spark, d), recompute=True, most_words=20).select("doc_id", (F.size("errors") == 0).alias("usable"), F.col("judged.overall_pass").alias("overall_pass"))


@query("pairwise_output", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'PREFERENCE' WHEN 1 THEN 'RATIONALE' WHEN 2 THEN 'FIELDS' ELSE '' END AS errors, CASE WHEN doc_id % 4 = 3 THEN 'TIE' END AS preference FROM documents")
def pairwise_output(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    raw = F.concat(F.lit('{"case_id": "c", "preference": "'), F.when(k == 0, "C").otherwise("TIE"), F.lit('", "critical_failure_a": false, "critical_failure_b": false'), F.when(k == 2, "").otherwise(F.concat(F.lit(', "short_rationale": "'), F.when(k == 1, "").otherwise("equal"), F.lit('"'))), F.lit("}"))
    return judging.parse_pairwise(table(spark, d, "documents").select("doc_id", raw.alias("raw"))).select("doc_id", F.array_join("errors", "|").alias("errors"), F.col("judged.preference").alias("preference"))


@query("usage_counters", "SELECT source, count(*) AS calls, count(*) FILTER (doc_id % 3 = 0) AS cached, sum(n_chars)::BIGINT AS tokens, sum(doc_id % 2)::BIGINT AS retries FROM documents GROUP BY 1")
def usage_counters(spark: SparkSession, d: str) -> DataFrame:
    return judging.usage(table(spark, d, "documents").select("source", (F.col("doc_id") % 3 == 0).alias("cached"), F.col("n_chars").alias("tokens"), (F.col("doc_id") % 2).alias("retries")), "source")


@query("token_budget", "SELECT count(*) AS calls, sum(ceil(length(text) / 4))::BIGINT AS input_tokens, (sum(ceil(length(text) / 4)) + count(*) * 120)::BIGINT AS total_tokens, sum(ceil(length(text) / 4)) + count(*) * 120 <= 1000000 AS fits FROM documents")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return judging.token_budget(table(spark, d, "documents"), "text", 120, 1_000_000)


_STRATA = "SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{seed}:' || stratum || ':' || doc_id), doc_id) AS rn FROM {rows}"


@query("development_sample", f"""WITH d AS (SELECT doc_id, lang || '|' || (n_chars > 1000) AS stratum, n_chars > 60000 AS always FROM documents), s AS ({_STRATA.format(seed='ds', rows='d WHERE NOT always')})
 SELECT doc_id, 'ALWAYS' AS stratum FROM d WHERE always UNION ALL (SELECT doc_id, stratum FROM s ORDER BY rn, stratum LIMIT 80 - (SELECT count(*) FROM d WHERE always))""")
def development_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return cohorts.development_sample(docs, F.col("n_chars") > 60000, [F.col("lang"), F.col("n_chars") > 1000], "doc_id", "ds", 80).select("doc_id", "stratum")


@query("holdout_sample", f"""WITH d AS (SELECT doc_id, lang || '|' || (n_chars > 1000) AS stratum, contains(text, '?') AS changed FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
 a AS ({_STRATA.format(seed='ho:changed', rows='d WHERE changed')}), b AS ({_STRATA.format(seed='ho:unchanged', rows='d WHERE NOT changed')})
 (SELECT doc_id, stratum, changed FROM a ORDER BY rn, stratum LIMIT 12) UNION ALL (SELECT doc_id, stratum, changed FROM b ORDER BY rn, stratum LIMIT 20)""")
def holdout_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    found = cohorts.holdout(docs, table(spark, d, "labels").select("doc_id"), F.contains("text", F.lit("?")), [F.col("lang"), F.col("n_chars") > 1000], "doc_id", "ho", 12, 20)
    return found.select("doc_id", "stratum", "changed")


_COHORTS = {"critical": ("critical_failure", 15), "failed": ("NOT overall_pass AND NOT critical_failure", 15), "passed": ("overall_pass", 10)}


@query("failure_cohorts", f"WITH {_J}, o AS (SELECT * FROM jp WHERE system = 'original'), " + ", ".join(f"c{k} AS (SELECT '{n}' AS cohort, case_id, row_number() OVER (ORDER BY sha256('fc:{n}:' || case_id), case_id) AS rank FROM o WHERE {t} QUALIFY rank <= {m})" for k, (n, (t, m)) in enumerate(_COHORTS.items())) + " SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2")
def failure_cohorts(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.cohorts(_judged(spark, d).where("system = 'original'"), {n: (F.expr(t), m) for n, (t, m) in _COHORTS.items()}, "case_id", "fc")


@query("audit_strata", """WITH a AS (SELECT doc_id FROM documents WHERE n_chars > 2000 ORDER BY sha256('au:long:' || doc_id), doc_id LIMIT 10), b AS (SELECT doc_id FROM documents WHERE n_chars > 1000 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY sha256('au:medium:' || doc_id), doc_id LIMIT 10),
 c AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a UNION SELECT doc_id FROM b) ORDER BY sha256('au:any:' || doc_id), doc_id LIMIT 10) SELECT 'long' AS stratum, doc_id FROM a UNION ALL SELECT 'medium', doc_id FROM b UNION ALL SELECT 'any', doc_id FROM c""")
def audit_strata(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.without_reuse(table(spark, d, "documents").select("doc_id", "n_chars"), {"long": F.col("n_chars") > 2000, "medium": F.col("n_chars") > 1000, "any": F.lit(True)}, "doc_id", "au", 10)


@query("execution_order", "SELECT doc_id, system, CASE WHEN substr(sha256('ab:' || doc_id), 1, 1) < '8' THEN 'original' ELSE 'revised' END AS first FROM documents, (VALUES ('original'), ('revised')) AS s(system)")
def execution_order(spark: SparkSession, d: str) -> DataFrame:
    first, _ = cohorts.execution_order(F.col("doc_id"), "ab")
    return cohorts.expanded(table(spark, d, "documents").select("doc_id", first.alias("first")), ["original", "revised"])


@query("labels_carried_over", "SELECT doc_id, CASE WHEN l.quality IS NULL THEN 'UNKNOWN' ELSE 'Q' || l.quality END AS label FROM documents LEFT JOIN labels l USING (doc_id)")
def labels_carried_over(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "labels").select("doc_id", F.concat(F.lit("Q"), F.col("quality").cast("string")).alias("label"))
    return cohorts.carried_over(table(spark, d, "documents").select("doc_id"), old, "doc_id", "label", "UNKNOWN")


@query("remapped_systems", f"WITH {_J} SELECT l.doc_id * 10 AS case_number, CASE system WHEN 'original' THEN 'baseline' ELSE system END AS system, safety FROM jp JOIN labels l ON l.doc_id = jp.case_id")
def remapped_systems(spark: SparkSession, d: str) -> DataFrame:
    mapping = table(spark, d, "labels").select(F.col("doc_id").alias("case_id"), (F.col("doc_id") * 10).alias("case_number"))
    return cohorts.remapped(_judged(spark, d), mapping, "case_id", "case_number", "system", {"original": "baseline"}).select("case_number", "system", "safety")


@query("case_flags", """WITH x AS (SELECT doc_id, lower(text) AS t FROM documents), y AS (SELECT doc_id, t, len(regexp_extract_all(t, '[a-z][a-z'']+')) AS n FROM x)
 SELECT doc_id, array_to_string(list_filter([CASE WHEN n <= 5 THEN 'VERY_SHORT' END, CASE WHEN n >= 60 THEN 'UNUSUALLY_LONG' END, CASE WHEN len(regexp_extract_all(t, '\\?')) >= 2 OR len(regexp_extract_all(t, ' and ')) + len(regexp_extract_all(t, ' but ')) >= 2 THEN 'MULTI_CLAUSE' END,
 CASE WHEN contains(t, 'hacked') OR contains(t, 'password') OR contains(t, 'charged') OR contains(t, 'refund') OR contains(t, 'payment') THEN 'RISK_TERMS' END, CASE WHEN contains(t, 'iphone')::INT + contains(t, 'android')::INT + contains(t, 'windows')::INT + contains(t, 'mac')::INT + contains(t, 'speaker')::INT >= 2 THEN 'MULTI_DEVICE' END], lambda z: z IS NOT NULL), '|') AS flags FROM y""")
def case_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(sampling.case_flags(F.col("text")), "|").alias("flags"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9'']+')"


@query("rare_lexicon", f"WITH c AS (SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents WHERE doc_id % 3 = 0) GROUP BY 1), t AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS token FROM documents), m AS (SELECT doc_id, sum(coalesce(n, 0)) / count(*) AS mean FROM t LEFT JOIN c USING (token) GROUP BY 1) SELECT doc_id, coalesce(mean < 40, FALSE) AS rare FROM documents LEFT JOIN m USING (doc_id)")
def rare_lexicon(spark: SparkSession, d: str) -> DataFrame:
    docs = split_docs(spark, d)
    return sampling.rare_lexicon(docs, "doc_id", "text", docs.where("split = 'TRAIN'"), 40.0)


@query("gold_violations", """WITH x AS (SELECT doc_id AS key, lang, n_chars, source, doc_id IN (SELECT doc_id FROM labels) AS frozen FROM documents) SELECT key, 'LANG' AS rule FROM x WHERE lang NOT IN ('en', 'de', 'fr') UNION ALL SELECT key, 'LENGTH' FROM x WHERE n_chars < 100 UNION ALL SELECT key, 'NOT_FROZEN' FROM x WHERE NOT frozen
 UNION ALL SELECT key, 'PROTECTED' FROM x WHERE frozen AND key % 3 = 0""")
def gold_violations(spark: SparkSession, d: str) -> DataFrame:
    """Which rows may not be gold labels, and why: unknown values, outside the frozen set, or in a protected split."""
    frozen = table(spark, d, "labels").select("doc_id").distinct().withColumn("frozen", F.lit(True))
    rows = split_docs(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").join(frozen, "doc_id", "left").withColumn("frozen", F.coalesce("frozen", F.lit(False)))
    rules = {"LANG": ~F.col("lang").isin("en", "de", "fr"), "LENGTH": F.col("n_chars") < 100, "NOT_FROZEN": ~F.col("frozen"), "PROTECTED": F.col("frozen") & (F.col("split") == "TRAIN")}
    return contracts.violations(rows, "doc_id", rules)


@query("gold_status", "SELECT count(DISTINCT l.doc_id) AS labels, count(DISTINCT l.doc_id) >= 150 AS enough, count(DISTINCT l.doc_id) FILTER (d.doc_id IS NULL) AS unknown, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled FROM labels l LEFT JOIN documents d USING (doc_id)")
def gold_status(spark: SparkSession, d: str) -> DataFrame:
    return contracts.reconcile(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id", 150)


@query("evaluated_cases", "SELECT d.doc_id, coalesce(l.quality = 1, FALSE) AS approved, l.toxic IS NOT NULL AS graded, CASE WHEN contains(lower(d.text), 'idiot') THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)")
def evaluated_cases(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with gold and quality where there are any; quality that nobody has approved is not approved."""
    predictions = table(spark, d, "documents").select("doc_id", F.when(F.contains(F.lower("text"), F.lit("idiot")), "ESCALATE").otherwise("AUTO_HANDLE").alias("action"))
    joined = predictions.join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("approved"), F.col("toxic").isNotNull().alias("graded"), "action")
