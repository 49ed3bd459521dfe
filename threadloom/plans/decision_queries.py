"""Queries on retrieval, gates, decisions, paired comparison and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.durable import spread, written
from threadloom.operators import compare, contracts, gates, judging, models, retrieval, taxonomy
from threadloom.plans.core_queries import GENERIC, INTENTS, TAXONOMY
from threadloom.plans.evaluation_queries import _PAIR, digest_sql
from threadloom.plans.evaluation_queries import _judged as _pairs
from threadloom.plans.registry import query
from threadloom.plans.views import LEAK, MSGS, NORM, SPLIT_OF, messages, split_docs
from threadloom.sources.tables import table

_TOK = "regexp_extract_all(lower({}), '[a-z0-9'']+')"
TFIDF = f"""dt AS (SELECT doc_id AS key, unnest({_TOK.format('text')}) AS term FROM documents WHERE doc_id % 4 = 1 OR TRUE), dtf AS (SELECT key, term, count(*) AS tf FROM dt GROUP BY 1, 2),
 idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM dtf GROUP BY 1 HAVING count(*) >= 2),
 dr AS (SELECT key, term, (1 + ln(tf)) * idf AS raw FROM dtf JOIN idf USING (term)), dw AS (SELECT key AS doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)) AS w FROM dr),
 qt AS (SELECT item_id AS key, unnest({_TOK.format('text')}) AS term FROM benchmark), qr AS (SELECT key, term, (1 + ln(count(*))) * any_value(idf) AS raw FROM qt JOIN idf USING (term) GROUP BY 1, 2),
 qw AS (SELECT key AS query, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)) AS w FROM qr),
 sim AS (SELECT query, doc, round(sum(qw.w * dw.w), 6) AS similarity FROM qw JOIN dw USING (term) GROUP BY 1, 2),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM sim) WHERE rank <= 5)""".replace(" WHERE doc_id % 4 = 1 OR TRUE", "")


def _tokens(column: str):
    return F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9']+"), F.lit(0))


def _top(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    return retrieval.top_similar(table(spark, d, "benchmark"), "item_id", _tokens("text"), table(spark, d, "documents"), "doc_id", _tokens("text"), k, least_docs=2)


@query("tfidf_topk", f"WITH {TFIDF} SELECT query, doc, similarity, rank FROM top")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).select("query", "doc", "similarity", "rank")


@query("tfidf_terms", f"WITH {TFIDF} SELECT doc, term, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(w, 6) DESC, term) AS rn FROM dw) WHERE rn <= 3")
def tfidf_terms(spark: SparkSession, d: str) -> DataFrame:
    weights, _ = retrieval.term_weights(table(spark, d, "documents"), "doc_id", _tokens("text"), least_docs=2)
    rounded = weights.select(F.col("key").alias("doc"), "term", F.round("w", 6).alias("weight"))
    return retrieval.top_k(rounded, 3, group="doc", score="weight", tie="term").select("doc", "term", "weight")


@query("calibrated_threshold", f"WITH {TFIDF} SELECT round(greatest(least(quantile_cont(similarity, 0.75), 0.85::DOUBLE), 0.10::DOUBLE), 6) AS threshold FROM top WHERE rank = 1")
def calibrated_threshold(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bounded_quantile(_top(spark, d).where("rank = 1"), "similarity", 0.75, 0.10, 0.85)


POOL = f"""{TFIDF}, {INTENTS}, pool AS (SELECT query, doc, similarity, (intent = 'billing')::INT::DOUBLE AS intent_match, least(n_chars / 500.0::DOUBLE, 1) AS quality, ((doc % 3) / 9.0)::DOUBLE AS template_penalty, intent, doc % 6 AS reply FROM
 (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS place FROM sim) JOIN i ON i.doc_id = doc JOIN documents d ON d.doc_id = doc WHERE place <= 20),
 hyb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT *, round(greatest(least(similarity * 0.6::DOUBLE + intent_match * 0.25::DOUBLE + quality * 0.15::DOUBLE - template_penalty * 0.1::DOUBLE, 1.0), 0.0), 6) AS score FROM pool)) WHERE rank <= 5)"""
WEIGHTS = {"similarity": 0.6, "intent_match": 0.25, "quality": 0.15, "template_penalty": 0.1}


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    pool = written(_top(spark, d, 20).drop("rank"))
    found = table(spark, d, "documents").withColumnRenamed("doc_id", "doc").join(pool.select("doc").distinct(), "doc", "left_semi")  # no intent is made of others
    pool = pool.join(found.select("doc", "n_chars", taxonomy.provisional_intent(F.col("text"), TAXONOMY).alias("intent")), "doc")
    pool = pool.withColumns({"intent_match": (F.col("intent") == "billing").cast("double"), "quality": F.least(F.col("n_chars") / 500.0, F.lit(1.0)), "template_penalty": (F.col("doc") % 3) / 9.0})
    return retrieval.hybrid(pool, WEIGHTS, 5)


@query("hybrid_rank", f"WITH {POOL} SELECT query, doc, score, rank FROM hyb")
def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query", "doc", "score", "rank")


#: Beside the items, ids of labelled documents that nothing was retrieved for; confidence and margin follow from the id.
_ASKED = "aq AS (SELECT query, (query % 10) / 10.0 AS confidence, (query % 20) / 20.0 AS margin FROM (SELECT item_id AS query FROM benchmark UNION SELECT doc_id FROM labels))"
_EVID = f"""{POOL}, {_ASKED}, eb AS (SELECT query, count(*) AS n, count(*) FILTER (intent = 'billing') AS same, max(score) FILTER (rank = 1) AS score, max(similarity) FILTER (rank = 1) AS sim1 FROM hyb GROUP BY 1), em AS (SELECT query, max(n) AS modal FROM (SELECT query, reply, count(*) AS n FROM hyb GROUP BY 1, 2) GROUP BY 1),
 ev AS (SELECT aq.query, round(coalesce(same / n, 0), 6) AS intent_agreement, round(coalesce(modal / n, 1), 6) AS template_concentration, CASE WHEN n IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE array_to_string(list_filter([CASE WHEN confidence < 0.2 THEN 'LOW_INTENT_CONFIDENCE' END, CASE WHEN margin < 0.1 THEN 'AMBIGUOUS_INTENT' END, CASE WHEN score < 0.4 OR sim1 < 0.15 THEN 'INSUFFICIENT_EVIDENCE' END, CASE WHEN same / n < 0.6 THEN 'INTENT_RETRIEVAL_MISMATCH' END, CASE WHEN modal / n > 0.6 THEN 'TEMPLATE_CONCENTRATION' END], lambda x: x IS NOT NULL), '|') END AS reasons FROM aq LEFT JOIN eb ON eb.query = aq.query LEFT JOIN em ON em.query = aq.query)"""


def _evidence(spark: SparkSession, d: str, hybrid: DataFrame) -> DataFrame:
    cases = hybrid.select("query", "rank", "score", "similarity", (F.col("intent") == "billing").alias("same_intent"), (F.col("doc") % 6).alias("reply"))
    return gates.evidence(cases, {"score": 0.4, "similarity": 0.15, "agreement": 0.6, "concentration": 0.6, "confidence": 0.2, "margin": 0.1}, _asked(spark, d))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Items, and labelled documents as queries that nothing was retrieved for."""
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("query")).union(table(spark, d, "labels").select("doc_id")).distinct()
    return ids.select("query", ((F.col("query") % 10) / 10.0).alias("confidence"), ((F.col("query") % 20) / 20.0).alias("margin"))


@query("calibrated_gates", f"WITH {POOL}, c AS (SELECT query, (query % 10) / 10.0 AS confidence, (query % 20) / 20.0 AS margin, score, similarity FROM hyb WHERE rank = 1) SELECT round(greatest(least(quantile_cont(confidence, 0.25), 0.9::DOUBLE), 0.1::DOUBLE), 6) AS confidence, round(greatest(least(quantile_cont(margin, 0.25), 0.9::DOUBLE), 0.05::DOUBLE), 6) AS margin, round(greatest(least(quantile_cont(score, 0.75), 0.8::DOUBLE), 0.2::DOUBLE), 6) AS score, round(greatest(least(quantile_cont(similarity, 0.75), 0.8::DOUBLE), 0.1::DOUBLE), 6) AS similarity FROM c")
def calibrated_gates(spark: SparkSession, d: str) -> DataFrame:
    cases = written(_hybrid(spark, d))
    asked = _asked(spark, d).join(cases.select("query").distinct(), "query", "left_semi")
    return gates.calibrated(asked, cases, {"confidence": (0.25, 0.1, 0.9), "margin": (0.25, 0.05, 0.9), "score": (0.75, 0.2, 0.8), "similarity": (0.75, 0.1, 0.8)})


@query("evidence_gate", f"WITH {_EVID} SELECT * FROM ev")
def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d, written(_hybrid(spark, d))).withColumn("reasons", F.array_join("reasons", "|"))


MARKERS = {"SECURITY": ["idiot", "stupid"], "PAYMENT": ["tionth", "ungen"], "PII": ["@", "+1 "], "POLICY_SENSITIVE": ["license", "password"]}
_has = lambda terms: " OR ".join(f"contains(flat, '{t}')" for t in terms)
RISK = f"""fl AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') AS flat, (doc_id % 20) / 20.0 AS margin FROM documents), rt AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {_has(v)} THEN '{k}' END" for k, v in MARKERS.items())},
 CASE WHEN len(regexp_extract_all(flat, '[a-z0-9'']+')) <= 5 THEN 'LOW_CONTEXT' END, CASE WHEN margin < 0.08 THEN 'MULTI_INTENT' END], lambda x: x IS NOT NULL) AS tags FROM fl)"""


@query("risk_tags", f"WITH {RISK} SELECT doc_id, array_to_string(tags, '|') AS tags FROM rt")
def risk_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = gates.risk_tags(F.col("text"), MARKERS, (F.col("doc_id") % 20) / 20.0)
    return table(spark, d, "documents").select("doc_id", F.array_join(tags, "|").alias("tags"))


_R = "CASE x WHEN 'SECURITY' THEN 'SECURITY_RISK' WHEN 'PAYMENT' THEN 'PAYMENT_ACTION_REQUIRED' WHEN 'PII' THEN 'PRIVATE_ACCOUNT_REQUIRED' WHEN 'POLICY_SENSITIVE' THEN 'UNSUPPORTED_POLICY_RISK' WHEN 'MULTI_INTENT' THEN 'AMBIGUOUS_INTENT' ELSE x END"


#: The reply is the best case's first 60 characters, with a claim for every fifth query; evidence is that case.
_DECIDED = f"""{_EVID}, {RISK}, best AS (SELECT query, doc, substr(trim(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' '), 1, 60) || CASE WHEN query % 5 = 0 THEN ' we have refunded' ELSE '' END AS reply, text AS past FROM hyb JOIN documents d ON d.doc_id = doc WHERE rank = 1),
 bv AS (SELECT query, regexp_extract_all(lower(reply), '[a-z][a-z'']+') AS own, regexp_extract_all(lower(past), '[a-z][a-z'']+') AS seen, reply FROM best),
 vf AS (SELECT query, list_filter([CASE WHEN contains(lower(reply), 'we have refunded') THEN 'UNSUPPORTED_ACTION_CLAIM' END, CASE WHEN trim(reply, ' ') = '' THEN 'MISSING_EVIDENCE' END, CASE WHEN coalesce(len(list_distinct(list_intersect(own, seen))) / nullif(len(list_distinct(own)), 0), 0) < 0.8 THEN 'GROUNDING_FAILURE' END], lambda x: x IS NOT NULL) AS codes FROM bv)"""


@query("decision", f"""WITH {_DECIDED}, q AS (SELECT ev.query, list_distinct(list_concat(list_concat(list_transform(tags, lambda x: {_R}), list_filter(string_split(reasons, '|'), lambda x: x <> '')), coalesce(codes, ['MISSING_EVIDENCE', 'GROUNDING_FAILURE']))) AS why FROM ev JOIN rt ON rt.doc_id = ev.query LEFT JOIN vf ON vf.query = ev.query)
 SELECT query, CASE WHEN len(why) = 0 THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS action, array_to_string(list_sort(why), '|') AS reasons FROM q""")
def decision(spark: SparkSession, d: str) -> DataFrame:
    """Every asked query, retrieved cases or none: risk, evidence and the verifier's codes."""
    docs = table(spark, d, "documents")
    tags = gates.risk_tags(F.col("text"), MARKERS, (F.col("doc_id") % 20) / 20.0)
    risk = docs.select(F.col("doc_id").alias("query"), gates.reasons(tags).alias("risk"))
    past = docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("past"))
    hybrid = written(_hybrid(spark, d))
    best = hybrid.where("rank = 1").select("query", "doc").join(past, "doc")
    claim = F.when(F.col("query") % 5 == 0, " we have refunded").otherwise("")
    reply = F.concat(F.substr(F.trim(F.regexp_replace("past", "[^A-Za-z ]", " ")), F.lit(1), F.lit(60)), claim)
    best = best.select("query", reply.alias("reply"), F.array(F.struct(F.col("doc").alias("id"), F.col("past").alias("reply"))).alias("cases"), F.array("doc").alias("used"))
    nothing = F.array().cast(best.schema["cases"].dataType), F.array().cast("array<bigint>")
    rows = _evidence(spark, d, hybrid).join(risk, "query").join(best, "query", "left").select("query", "risk", "reasons", F.coalesce("reply", F.lit("")).alias("reply"), F.coalesce("cases", nothing[0]).alias("cases"), F.coalesce("used", nothing[1]).alias("used"))
    check = gates.verify(F.col("reply"), F.col("cases"), F.col("used"), F.lit(""), {"unsupported_action": ["we have refunded"]})
    action, why = gates.decide(F.col("risk"), F.col("reasons"), check["codes"])
    return rows.select("query", action.alias("action"), F.array_join(F.sort_array(why), "|").alias("reasons"))


@query("grounded_reply", None)
def grounded_reply(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where(~F.col("inbound")).select("message_id", "text")
    reply = gates.compose(F.col("text"), GENERIC[:1], ["tion", "ung", "ment"])
    cases = F.array(F.struct(F.lit("own").alias("id"), F.col("text").alias("reply")))
    check = gates.verify(F.col("reply"), cases, F.array(F.lit("own")), F.lit(""), {"unsupported_action": ["we have refunded"]})
    return m.withColumn("reply", reply).select("message_id", "reply", F.array_join(check["codes"], "|").alias("failures"))


@query("template_cap", f"""WITH {MSGS} SELECT message_id, template_frequency FROM (SELECT message_id, count(*) OVER (PARTITION BY t) AS template_frequency, row_number() OVER (PARTITION BY t ORDER BY message_id) AS rn FROM (SELECT message_id, {NORM.format("text")} AS t FROM m WHERE NOT inbound)) WHERE rn <= 2""")
def template_cap(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where(~F.col("inbound")).select("message_id", F.sha2(tx.normalized_reply(F.col("text")), 256).alias("t"))
    return retrieval.capped_templates(m, "t", "message_id", 2).select("message_id", "template_frequency")


@query("embedding_topk", """WITH q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS doc, round(list_sum(list_transform(list_zip(q, embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS similarity FROM q, embeddings WHERE vec_id <> query)
 SELECT query, doc, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM s) WHERE rank <= 5""")
def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return retrieval.vector_top_k(asked, v.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v")), 5)


@query("recall_mrr", f"""WITH {TFIDF}, bw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM benchmark), bg AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM bw)),
 ww AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents), wg AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM ww)), rel AS (SELECT DISTINCT item_id AS query, doc_id AS item FROM bg JOIN wg USING (g)), z AS (SELECT query, count(*) AS size FROM rel GROUP BY 1),
 h AS (SELECT t.query, count(*) FILTER (rank <= 3) AS found, min(rank) AS first FROM top t JOIN rel ON rel.query = t.query AND rel.item = t.doc GROUP BY 1)
 SELECT count(*) AS queries, round(avg(coalesce(found, 0) / size), 8) AS recall, round(avg(coalesce(1.0 / first, 0)), 8) AS mrr FROM z LEFT JOIN h USING (query)""")
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    from threadloom.operators.metrics import recall_mrr as metric

    # A document is relevant for an item if they have any eight words in a row in common, wherever these stand.
    runs = lambda name, key, out: table(spark, d, name).select(F.col(key).alias(out), F.explode(retrieval.word_runs(_tokens("text"), 8)).alias("run"))
    relevant = written(runs("benchmark", "item_id", "query").distinct().join(runs("documents", "doc_id", "item"), "run").select("query", "item").distinct())
    return metric(_top(spark, d).select("query", F.col("doc").alias("item"), "rank"), relevant, 3)


_JUDGED = """j AS (SELECT doc_id, 3 + doc_id % 3 AS g0, 3 + length(text) % 3 AS s0, 2 + doc_id % 4 AS h0, doc_id % 17 = 0 AS crit, source FROM documents), p AS (SELECT *, g0 >= 4 AND s0 >= 4 AND h0 >= 3 AND NOT crit AS p0 FROM j)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    n, size = F.col("doc_id"), F.length("text")
    s = {"g0": 3 + n % 3, "s0": 3 + size % 3, "h0": 2 + n % 4}
    j = table(spark, d, "documents").select("doc_id", "source", *(c.alias(k) for k, c in s.items()), (n % 17 == 0).alias("crit"))
    return j.withColumn("p0", judging.passes({m: F.col(f"{m[0]}0") for m in ("groundedness", "safety", "helpfulness")}, F.col("crit")))


@query("paired_outcomes", f"WITH {_PAIR} SELECT outcome, count(*) AS n FROM po GROUP BY 1")
def paired_outcomes(spark: SparkSession, d: str) -> DataFrame:
    result, _ = judging.outcome(F.col("a"), F.col("b"))
    return judging.pairs(_pairs(spark, d)).groupBy(result.alias("outcome")).agg(F.count("*").alias("n"))


@query("transitions", f"WITH {_PAIR} SELECT (CASE WHEN pa THEN 'PASS' ELSE 'FAIL' END) || '_TO_' || (CASE WHEN pb THEN 'PASS' ELSE 'FAIL' END) AS transition, count(*) AS n FROM po GROUP BY 1")
def transitions(spark: SparkSession, d: str) -> DataFrame:
    word = lambda p: F.when(F.col(p), "PASS").otherwise("FAIL")
    return judging.pairs(_pairs(spark, d)).groupBy(F.concat(word("a.overall_pass"), F.lit("_TO_"), word("b.overall_pass")).alias("transition")).agg(F.count("*").alias("n"))


@query("system_summary", f"WITH {_JUDGED} SELECT source, count(*) AS n, round(avg(h0), 8) AS mean, median(h0)::DOUBLE AS median, round((count(*) FILTER (p0)) / count(*), 8) AS pass_rate FROM p GROUP BY 1")
def system_summary(spark: SparkSession, d: str) -> DataFrame:
    return compare.system_summary(_judged(spark, d), "source", "h0", F.col("p0"))


@query("repeatability", f"WITH {_JUDGED}, r AS (SELECT doc_id, unnest([g0, s0, h0]) AS score FROM j) SELECT doc_id, count(*) AS runs, round(var_pop(score), 8) AS variance FROM r GROUP BY 1")
def repeatability(spark: SparkSession, d: str) -> DataFrame:
    runs = _judged(spark, d).select("doc_id", F.explode(F.array("g0", "s0", "h0")).alias("score"))
    return compare.variance_by_case(runs, "doc_id", "score")


_DIST = f"x AS (SELECT {SPLIT_OF} AS split, lang AS value, count(*) AS n FROM documents GROUP BY 1, 2), y AS (SELECT split, value, n, round(n / sum(n) OVER (PARTITION BY split), 8) AS rate FROM x)"


@query("distribution", f"WITH {_DIST} SELECT split, value, n, rate FROM y")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    return compare.distribution(split_docs(spark, d), "lang", "split")


@query("distribution_shift", f"WITH {_DIST} SELECT value, points, CASE WHEN points < 15 THEN 'LOW' WHEN points <= 30 THEN 'MODERATE' ELSE 'HIGH' END AS level FROM (SELECT coalesce(a.value, b.value) AS value, round(100 * abs(coalesce(a.rate, 0) - coalesce(b.rate, 0)), 6) AS points FROM (SELECT * FROM y WHERE split = 'TRAIN') a FULL JOIN (SELECT * FROM y WHERE split = 'GOLD') b USING (value))")
def distribution_shift(spark: SparkSession, d: str) -> DataFrame:
    x = compare.distribution(split_docs(spark, d), "lang", "split")
    return compare.shift(x.where("split = 'TRAIN'"), x.where("split = 'GOLD'"))


@query("contract_violations", """WITH b AS (SELECT conv_id * 1000 + turn AS key, role, text FROM conversations) SELECT key, 'ROLE' AS rule FROM b WHERE coalesce(role NOT IN ('user', 'assistant'), TRUE)
 UNION ALL SELECT key, 'SHORT_TEXT' FROM b WHERE coalesce(length(text) < 40, TRUE) UNION ALL SELECT key, 'DUPLICATE_KEY' FROM b GROUP BY 1 HAVING count(*) > 1""")
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("number", F.col("conv_id") * 1000 + F.col("turn"))
    return contracts.violations(rows, "number", {"ROLE": ~F.col("role").isin("user", "assistant"), "SHORT_TEXT": F.length("text") < 40})


@query("id_digest", "SELECT source, count(DISTINCT doc_id) AS ids, sha256(string_agg(DISTINCT doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS digest FROM documents GROUP BY 1")
def id_digest(spark: SparkSession, d: str) -> DataFrame:
    return contracts.id_digest(table(spark, d, "documents"), "doc_id", "source")


@query("id_digest_tree", digest_sql("documents"))
def id_digest_tree(spark: SparkSession, d: str) -> DataFrame:
    return contracts.digest_tree(table(spark, d, "documents"), "doc_id", "source")


@query("store_merge", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def store_merge(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "labels").select("doc_id", "quality")
    new = table(spark, d, "documents").select("doc_id", F.lit(9).alias("quality"))
    return contracts.insert_only(stored, new, "doc_id")


@query("orphans_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def orphans_anti(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(big, "o_orderkey", "left_anti")


@query("ids_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def ids_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("ids_subtract", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def ids_subtract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey"))


_BENCHMARK_SQL = f"""WITH dd AS (SELECT doc_id, list_distinct({_TOK.format(LEAK.format('text'))}) AS t FROM documents), b AS (SELECT item_id, list_distinct({_TOK.format(LEAK.format('text'))}) AS t FROM benchmark),
 dx AS (SELECT doc_id, unnest(t) AS w FROM dd), bx AS (SELECT item_id, unnest(t) AS w FROM b), s AS (SELECT doc_id, item_id, count(*) AS same FROM dx JOIN bx USING (w) GROUP BY 1, 2)
 SELECT item_id, doc_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rn FROM (SELECT item_id, doc_id, round(same / (len(dd.t) + len(b.t) - same), 8) AS similarity FROM s JOIN dd USING (doc_id) JOIN b USING (item_id))) WHERE rn <= 3"""


@query("benchmark_similarity", _BENCHMARK_SQL)
def benchmark_similarity(spark: SparkSession, d: str) -> DataFrame:
    bag = lambda c: tx.token_set(tx.normalize_for_leakage(F.col(c)))
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("doc"), bag("text").alias("ts"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), bag("text").alias("ts"))
    return retrieval.set_top_k(items, docs, 3).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "similarity")


# A fitted model has no SQL; tests hold it against a dense fit.
@query("logreg_rows", None)
def logreg_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = split_docs(spark, d).select("doc_id", "text", "lang", "split")
    return models.classify(docs.where("split = 'TRAIN'"), docs.where("split <> 'TRAIN'").select("doc_id", "text", "lang"), "lang").select("doc_id", "lang", "intent", "confidence", "margin")


@query("kmeans_rows", None)
def kmeans_rows(spark: SparkSession, d: str) -> DataFrame:
    return models.clusters(table(spark, d, "documents").select("doc_id", "text"), 6)[0].select(F.col("key").alias("doc_id"), "cluster", F.round("distance", 6).alias("distance"))


_EXPLORED = r"strip_accents(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(lower(text))), 'https?://\S+|www\.\S+', ' ', 'g'), '@[a-z0-9_]+', ' ', 'g'), '\b[0-9]+\b', ' ', 'g'), '\s+', ' ', 'g'), ' '))"
VOCABULARY = f"""ex AS (SELECT doc_id, regexp_extract_all({_EXPLORED}, '[a-z0-9]{{2,}}') AS w FROM documents), tm AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ex),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM tm GROUP BY 1, 2), vc AS (SELECT term, sum(tf) AS tf, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.5::DOUBLE * (SELECT count(*) FROM documents)),
 vo AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS place, df, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM (SELECT * FROM vc ORDER BY tf DESC, term LIMIT 2000))"""


def _chosen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs, models.select_terms(docs, "doc_id", models.Features._words("text"), 2000, 2, 0.5)


@query("vocabulary", f"WITH {VOCABULARY} SELECT term, place, df, round(idf, 8) AS idf FROM vo")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _chosen(spark, d)[1].select("term", F.col("place").cast("bigint").alias("place"), "df", F.round("idf", 8).alias("idf"))


#: Terms and members of clusters that ids give: what follows from an assignment, whatever made it.
_CLUSTERED = f"""{VOCABULARY}, rw AS (SELECT doc_id, term, (1 + ln(tf.tf)) * idf AS raw FROM tf JOIN vo USING (term)), ve AS (SELECT doc_id, doc_id % 6 AS cluster, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS w FROM rw),
 sz AS (SELECT doc_id % 6 AS cluster, count(*) AS size FROM documents GROUP BY 1), me AS (SELECT cluster, term, sum(w) / any_value(size) AS m FROM ve JOIN sz USING (cluster) GROUP BY 1, 2)"""


def _given(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, chosen = _chosen(spark, d)
    rows = written(models.packed(docs, "doc_id", [models.Kind(models.Features._words("text"), chosen)]))
    return rows, docs.select(F.col("doc_id").alias("key"), (F.col("doc_id") % 6).alias("cluster")), chosen


@query("cluster_terms", f"WITH {_CLUSTERED} SELECT * FROM (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY round(m, 8) DESC, term) AS rank, term, round(m, 8) AS weight FROM me) WHERE rank <= 15")
def cluster_terms(spark: SparkSession, d: str) -> DataFrame:
    return models.cluster_terms(*_given(spark, d))


@query("cluster_members", f"""WITH {_CLUSTERED}, mm AS (SELECT cluster, sum(m * m) AS mm FROM me GROUP BY 1), dt AS (SELECT doc_id, sum(w * w) AS ww, sum(w * m) AS wm FROM ve JOIN me USING (cluster, term) GROUP BY 1),
 di AS (SELECT d.doc_id, d.doc_id % 6 AS cluster, round(sqrt(greatest(coalesce(ww, 0) - 2 * coalesce(wm, 0) + mm, 0)), 6) AS distance FROM documents d LEFT JOIN dt USING (doc_id) JOIN mm ON mm.cluster = d.doc_id % 6)
 SELECT cluster, rank, doc_id AS key, distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, doc_id) AS rank FROM di) WHERE rank <= 5""")
def cluster_members(spark: SparkSession, d: str) -> DataFrame:
    rows, members, _ = _given(spark, d)
    return models.cluster_members(models.distances_to_means(rows, members))
