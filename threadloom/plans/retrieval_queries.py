"""Queries on the retrieval corpus of threads, its baselines, leakage between splits, and audits of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.durable import written
from threadloom.operators import cohorts, gates, judging, profile, retrieval, sampling, splits, taxonomy, threads
from threadloom.plans.core_queries import INTENT_SQL, INTENTS, TAXONOMY, _SCORE
from threadloom.plans.evaluation_queries import _J, _judged
from threadloom.plans.registry import query
from threadloom.plans.service_queries import _CLEAN, _CONTENT, _HAS, _KNOWN, _SENT
from threadloom.plans.views import LEAK, MSGS, NORM, WORDS, messages
from threadloom.sources.tables import table

PRIVATE = ["@", "nicht die"]
RISKY = ["tionth", "ungen"]
_PUBLIC = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, 'https?://\S+|www\.\S+', '<URL>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '<EMAIL>', 'g'), '@[A-Za-z0-9_]+', '<HANDLE>', 'g'), '[0-9]{{7,}}', '<NUMBER>', 'g'), '\s+', ' ', 'g'), ' ')"
_EXPLORE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}), 'https?://\S+|www\.\S+', ' ', 'g'), '@[a-z0-9_]+', ' ', 'g'), '\b[0-9]+\b', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_INTENT = f"(SELECT {INTENT_SQL} FROM (SELECT {', '.join(f'({_SCORE(x)}) AS s{k}' for k, x in enumerate(TAXONOMY.intents[:3]))} FROM (SELECT customer_text AS text)))"
CORPUS = f"""{MSGS}, th AS (SELECT conv_id AS key, string_agg(text, ' ' ORDER BY turn) FILTER (inbound) AS customer_text, first(text ORDER BY turn) FILTER (NOT inbound) AS reply, count(*) AS messages FROM m GROUP BY 1 HAVING count(*) FILTER (inbound) > 0 AND count(*) FILTER (NOT inbound) > 0),
 ti AS (SELECT *, {_INTENT} AS intent FROM th), us AS (SELECT *, {_PUBLIC.format('reply')} AS clean, {NORM.format(_PUBLIC.format('reply'))} AS template FROM ti WHERE {WORDS.format(NORM.format('reply'))} >= 8 AND NOT {_HAS(NORM.format('reply'), PRIVATE)}),
 dc AS (SELECT key, {_EXPLORE.format('customer_text')} AS text, clean AS reply, intent, greatest(least(least({WORDS.format('clean')} / 24.0, 1.0) - CASE WHEN regexp_matches(clean, '<(?:url|email|mention|number)>') THEN 0.25 ELSE 0 END, 1.0), 0.0)::DOUBLE AS reply_quality, least(messages / 4.0, 1.0)::DOUBLE AS context,
 count(*) OVER (PARTITION BY template) AS template_frequency, row_number() OVER (PARTITION BY template ORDER BY key) AS rn FROM us), docs AS (SELECT * EXCLUDE (rn) FROM dc WHERE rn <= 2), asks AS (SELECT key, {_EXPLORE.format('customer_text')} AS text, customer_text, intent, least(messages / 4.0, 1.0)::DOUBLE AS context FROM ti)"""


def _threads(spark: SparkSession, d: str) -> DataFrame:
    nested = threads.nested(messages(spark, d))
    said = threads.role_text(F.col("turns"), True)
    rows = nested.select(F.col("conv_id").alias("key"), said.alias("customer_text"), F.filter("turns", lambda t: ~t["inbound"])[0]["text"].alias("reply"), F.col("message_count").alias("messages"))
    return written(rows.withColumn("intent", taxonomy.provisional_intent(F.col("customer_text"), TAXONOMY)))


def _corpus(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents, and all threads as queries."""
    docs = written(retrieval.corpus(rows, 8, PRIVATE, 2))
    return docs, rows.select("key", tx.clean_exploration(F.col("customer_text")).alias("text"), "customer_text", "intent", F.least(F.col("messages") / 4.0, F.lit(1.0)).alias("context"))


@query("retrieval_corpus", f"WITH {CORPUS} SELECT key, sha256(text) AS text_hash, sha256(reply) AS reply_hash, intent, round(reply_quality, 8) AS reply_quality, context, template_frequency FROM docs")
def retrieval_corpus(spark: SparkSession, d: str) -> DataFrame:
    docs, _ = _corpus(_threads(spark, d))
    return docs.select("key", F.sha2("text", 256).alias("text_hash"), F.sha2("reply", 256).alias("reply_hash"), "intent", F.round("reply_quality", 8).alias("reply_quality"), "context", "template_frequency")


_WORDS = "regexp_extract_all(text, '[a-z0-9]{2,}')"
_GRAMS = f"list_concat({_WORDS}, list_transform(range(1, greatest(len({_WORDS}), 1)), lambda i: {_WORDS}[i] || ' ' || {_WORDS}[i + 1]))"
_CHARS = "flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)), list_transform(range(1, length(w)), lambda i: substr(' ' || w || ' ', i, 4)), list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: substr(' ' || w || ' ', i, 5)))))"


def _tfidf_sql(kind: str, terms: str) -> str:
    """d{kind}(key, term, w) of documents and q{kind} of queries."""
    return f"""{kind}t AS (SELECT key, unnest({terms}) AS term FROM docs), {kind}f AS (SELECT key, term, count(*) AS tf FROM {kind}t GROUP BY 1, 2), {kind}i AS (SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM {kind}f GROUP BY 1 HAVING count(*) >= 2),
 {kind}r AS (SELECT key, term, (1 + ln(tf)) * idf AS raw FROM {kind}f JOIN {kind}i USING (term)), d{kind} AS (SELECT key, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)) AS w FROM {kind}r),
 {kind}u AS (SELECT key, unnest({terms}) AS term FROM asks), {kind}s AS (SELECT key, term, (1 + ln(count(*))) * any_value(idf) AS raw FROM {kind}u JOIN {kind}i USING (term) GROUP BY 1, 2), q{kind} AS (SELECT key, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY key)) AS w FROM {kind}s)"""


_SIM = f"""{CORPUS}, {_tfidf_sql('w', _GRAMS)}, {_tfidf_sql('c', _CHARS)}, sw AS (SELECT q.key AS query, d.key AS doc, sum(q.w * d.w) AS s FROM qw q JOIN dw d USING (term) GROUP BY 1, 2), sc AS (SELECT q.key AS query, d.key AS doc, sum(q.w * d.w) AS s FROM qc q JOIN dc_ d USING (term) GROUP BY 1, 2)""".replace("dc_ d", "dc2 d").replace("dc AS (SELECT key, term, raw", "dc2 AS (SELECT key, term, raw")
_UNION = f"""{_SIM}, uq AS (SELECT key, sqrt(0.36 * (key IN (SELECT key FROM qw))::INT + 0.16 * (key IN (SELECT key FROM qc))::INT) AS n FROM asks), ud AS (SELECT key, sqrt(0.36 * (key IN (SELECT key FROM dw))::INT + 0.16 * (key IN (SELECT key FROM dc2))::INT) AS n FROM docs),
 us_ AS (SELECT coalesce(sw.query, sc.query) AS query, coalesce(sw.doc, sc.doc) AS doc, 0.36 * coalesce(sw.s, 0) + 0.16 * coalesce(sc.s, 0) AS s FROM sw FULL JOIN sc ON sw.query = sc.query AND sw.doc = sc.doc),
 ut AS (SELECT query, doc, round(s / (uq.n * ud.n), 6) AS similarity FROM us_ JOIN uq ON uq.key = query JOIN ud ON ud.key = doc), ur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM ut) WHERE rank <= 3)"""


def _weights(docs: DataFrame, asks: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """By kind of term the weights of documents and of queries."""
    text = F.col("text")
    words = lambda: F.transform(F.array(F.regexp_extract_all(text, F.lit("[a-z0-9]{2,}"), F.lit(0))), retrieval.with_pairs)[0]
    out = {}
    for kind, terms in (("w", words()), ("c", retrieval.char_terms(text))):
        own, idf = retrieval.term_weights(docs, "key", terms, least_docs=2)
        out[kind] = written(own), written(retrieval.term_weights(asks, "key", terms, written(idf))[0])
    return out


def _lexical(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, asks = _corpus(_threads(spark, d))
    w = _weights(docs, asks)
    mix = lambda side: retrieval.union_weights({"w": (w["w"][side], 0.6), "c": (w["c"][side], 0.4)})
    top = retrieval.top_by_products(mix(1), mix(0), 3)
    return docs, asks, retrieval.filled(top, asks.select(F.col("key").alias("query")), docs.select(F.col("key").alias("doc")), 3)


@query("union_topk", f"WITH {_UNION} SELECT query, doc, similarity, rank FROM ur")
def union_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d)[2].select("query", "doc", "similarity", "rank")


@query("lexical_baseline", f"""WITH {_UNION}, n AS (SELECT * FROM ur WHERE rank = 1), x AS (SELECT a.key AS query, docs.intent, coalesce(similarity, 0) AS confidence, coalesce(similarity, 0) >= 0.5 AND NOT {_HAS(NORM.format('a.customer_text'), RISKY)} AS auto, docs.reply FROM asks a LEFT JOIN n ON n.query = a.key LEFT JOIN docs ON docs.key = n.doc)
 SELECT query, coalesce(intent, 'other') AS intent, confidence, CASE WHEN auto THEN 'AUTO_HANDLE' ELSE 'ESCALATE' END AS action, sha256(CASE WHEN auto THEN reply ELSE 'A person will help you.' END) AS reply_hash FROM x""")
def lexical_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Every thread is answered: one without any case has no confidence and escalates."""
    docs, asks, top = _lexical(spark, d)
    nearest = top.where("rank = 1").join(docs.select(F.col("key").alias("doc"), "intent", "reply"), "doc").select("query", "intent", "reply", "similarity")
    rows = asks.select(F.col("key").alias("query"), "customer_text").join(nearest, "query", "left").withColumn("confidence", F.coalesce("similarity", F.lit(0.0)))
    auto = (F.col("confidence") >= 0.5) & ~gates.has_risk(F.col("customer_text"), RISKY)
    return rows.select("query", F.coalesce("intent", F.lit("other")).alias("intent"), "confidence", F.when(auto, "AUTO_HANDLE").otherwise("ESCALATE").alias("action"), F.sha2(F.when(auto, F.col("reply")).otherwise("A person will help you."), 256).alias("reply_hash"))


@query("fixed_baseline", f"WITH {CORPUS} SELECT key AS query, 'other' AS intent, 'ESCALATE' AS action, 'A person will help you.' AS reply FROM asks")
def fixed_baseline(spark: SparkSession, d: str) -> DataFrame:
    return gates.fixed(_threads(spark, d).select(F.col("key").alias("query")), "other", "A person will help you.")


_HW = {"word": 0.3, "char": 0.2, "intent": 0.2, "reply_quality": 0.15, "context": 0.15}
_HYBRID = f"""{_SIM}, hp AS (SELECT coalesce(sw.query, sc.query) AS query, coalesce(sw.doc, sc.doc) AS doc, coalesce(sw.s, 0) AS word, coalesce(sc.s, 0) AS char FROM sw FULL JOIN sc ON sw.query = sc.query AND sw.doc = sc.doc),
 pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(word + char, 6) DESC, doc) AS p FROM hp) WHERE p <= 40),
 hs AS (SELECT query, doc, round((word + char) / 2, 6) AS similarity, round(greatest(least(0.3::DOUBLE * word + 0.2::DOUBLE * char + 0.2::DOUBLE * (d.intent = a.intent)::INT + 0.15::DOUBLE * d.reply_quality + 0.15::DOUBLE * (1 - abs(a.context - d.context)) - 0.1::DOUBLE * least((template_frequency - 1) / 9.0::DOUBLE, 1.0), 1.0), 0.0), 6) AS score FROM pool JOIN docs d ON d.key = doc JOIN asks a ON a.key = query),
 hr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM hs) WHERE rank <= 5)"""


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    docs, asks = _corpus(_threads(spark, d))
    w = _weights(docs, asks)
    mix = lambda side: retrieval.union_weights({k: (w[k][side], 1.0) for k in "wc"}, normalised=False)
    found = retrieval.top_by_products(mix(1), mix(0), 40, ("w:", "c:"))  # terms' marks of kind, see union_weights
    pool = written(found.select("query", "doc", F.col("w:").alias("word"), F.col("c:").alias("char")))
    rows = pool.join(docs.withColumnRenamed("key", "doc").drop("text"), "doc").join(asks.select(F.col("key").alias("query"), F.col("intent").alias("asked"), F.col("context").alias("asked_context")), "query")
    rows = rows.withColumns({"intent": (F.col("intent") == F.col("asked")).cast("double"), "context": 1 - F.abs(F.col("asked_context") - F.col("context")), "template_penalty": F.least((F.col("template_frequency") - 1) / 9.0, F.lit(1.0)), "similarity": F.round((F.col("word") + F.col("char")) / 2, 6)})
    return retrieval.hybrid(rows, {**_HW, "template_penalty": 0.1}, 5)


@query("hybrid_cases", f"WITH {_HYBRID} SELECT query, doc, similarity, score, rank FROM hr")
def hybrid_cases(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d).select("query", "doc", "similarity", "score", "rank")


_TOP = f"""i AS (SELECT doc_id, {INTENT_SQL} AS intent, text FROM (SELECT doc_id, text, {', '.join(f'({_SCORE(x)}) AS s{k}' for k, x in enumerate(TAXONOMY.intents[:3]))} FROM documents)), t AS (SELECT intent, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS token FROM i), c AS (SELECT intent, token, count(*) AS n FROM t GROUP BY 1, 2),
 r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY n DESC, token) AS rn FROM c) WHERE rn <= 20)"""


def _intents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", taxonomy.provisional_intent(F.col("text"), TAXONOMY).alias("intent"))


@query("intent_evidence", f"WITH {_TOP}, e AS (SELECT intent, doc_id, row_number() OVER (PARTITION BY intent ORDER BY sha256('ie:' || doc_id), doc_id) AS k FROM i) SELECT intent, (SELECT count(*) FROM i x WHERE x.intent = r.intent) AS support, string_agg(token, ' ' ORDER BY rn) AS top_tokens, (SELECT string_agg(doc_id::VARCHAR, ' ' ORDER BY k) FROM e WHERE e.intent = r.intent AND k <= 3) AS examples FROM r GROUP BY 1")
def intent_evidence(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.evidence(_intents(spark, d), "intent", "doc_id", "text", "ie", 20, 3)


@query("intent_overlap", f"WITH {_TOP} SELECT a.intent AS a, b.intent AS b, round(count(*) FILTER (a.token = b.token) / (40 - count(*) FILTER (a.token = b.token)), 8) AS overlap FROM r a JOIN r b ON a.intent < b.intent GROUP BY 1, 2")
def intent_overlap(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.overlap(taxonomy.top_tokens(_intents(spark, d), "intent", "text", 20), "intent")


_LEAKS = f"""{MSGS}, lt AS (SELECT conv_id AS id, CASE conv_id % 3 WHEN 0 THEN 'TRAIN' WHEN 1 THEN 'DEVELOPMENT' ELSE 'GOLD' END AS split, kind, {LEAK.format('text')} AS t FROM (SELECT conv_id, CASE WHEN inbound THEN 'CUSTOMER' ELSE 'BRAND' END AS kind, string_agg(text, ' ' ORDER BY turn) AS text FROM m WHERE inbound IS NOT NULL GROUP BY 1, 2)),
 ld AS (SELECT *, list_distinct(regexp_extract_all(t, '[a-z0-9'']+')) AS tokens, CASE WHEN t = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length(t) - 3, 2)), lambda i: substr(t, i, 5))) END AS grams FROM lt)"""


@query("leakage_documents", f"WITH {_LEAKS} SELECT id, split, kind, len(tokens)::BIGINT AS tokens, len(grams)::BIGINT AS grams FROM ld WHERE len(tokens) >= 4")
def leakage_documents(spark: SparkSession, d: str) -> DataFrame:
    return leaks(spark, d).select("id", "split", "kind", F.size("tokens").cast("bigint").alias("tokens"), F.size("grams").cast("bigint").alias("grams"))


def leaks(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where(F.col("inbound").isNotNull())
    split = F.when(F.col("conv_id") % 3 == 0, "TRAIN").when(F.col("conv_id") % 3 == 1, "DEVELOPMENT").otherwise("GOLD")
    return splits.leakage_documents(m, "conv_id", split, F.when(F.col("inbound"), "CUSTOMER").otherwise("BRAND"), "turn", "text", 4)


_SIMILAR = """b AS (SELECT item_id AS id, 'L' || (length(text) % 3) AS label, list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS t FROM benchmark), x AS (SELECT a.id AS a, c.id AS b, a.label <> c.label AS differ, len(list_intersect(a.t, c.t))::DOUBLE / (len(a.t) + len(c.t) - len(list_intersect(a.t, c.t))) AS s FROM b a JOIN b c ON a.id < c.id WHERE len(a.t) > 0 AND len(c.t) > 0)"""


@query("consistency_audit", f"WITH {_SIMILAR} SELECT a, b, round(s, 8) AS similarity, differ FROM x WHERE s >= 0.1")
def consistency_audit(spark: SparkSession, d: str) -> DataFrame:
    """Similar texts with different labels: of a set that people have labelled, a few hundred rows."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("L"), (F.length("text") % 3).cast("string")).alias("label"), "text")
    return splits.similar_pairs(rows, "id", "label", "text", 0.1)


_SIGNAL = f"""{MSGS}, s0 AS (SELECT message_id, turn, text || CASE turn % 3 WHEN 0 THEN ' ok?' ELSE '' END AS reply, text || ' my iphone shows no error' AS said, CASE WHEN turn % 2 = 0 THEN text ELSE 'something else' END AS past FROM m),
 s1 AS (SELECT *, {_SENT.format('reply')} AS ss, trim(regexp_replace(lower(reply), '[^a-z0-9]+', ' ', 'g'), ' ') AS plain, trim(regexp_replace(lower(past), '[^a-z0-9]+', ' ', 'g'), ' ') AS ev, turn % 4 = 1 AS crit, CASE WHEN turn % 8 = 1 THEN ['A'] WHEN turn % 4 = 1 THEN ['R'] ELSE ['G'] END AS codes FROM s0),
 s2 AS (SELECT *, len(ss) > 0 AND len(list_filter(ss, lambda x: suffix(x, '?'))) = len(ss) AS only_q, plain <> '' AND contains(ev, plain) AS extract, len(list_filter(ss, lambda x: {_KNOWN})) > 0 OR (len({_CONTENT.format('said')}) >= 4 AND len(list_filter(ss, lambda x: {_HAS('lower(x)', tx.GENERIC_QUESTIONS)})) = len(ss)) AS weak, len(list_intersect({_CONTENT.format('reply')}, {_CONTENT.format('said')})) AS ov FROM s1),
 s3 AS (SELECT message_id, crit, list_filter([CASE WHEN only_q AND weak THEN 'GENERIC_OR_CONTEXT_REDUNDANT_QUESTION' END, CASE WHEN only_q AND ov = 0 THEN 'LOW_LEXICAL_ANSWER_COVERAGE' END, CASE WHEN NOT regexp_matches(reply, '[.?!]$') THEN 'INCOMPLETE_SURFACE_FORM' END], lambda x: x IS NOT NULL) AS ag,
 list_filter([CASE WHEN crit AND NOT list_contains(codes, 'A') THEN 'CRITICAL_LABEL_OUTSIDE_DECLARED_DEFINITION' END, CASE WHEN crit AND list_contains(codes, 'A') AND extract THEN 'CRITICAL_ACTION_LABEL_DISPUTED_BY_EXACT_EVIDENCE' END, CASE WHEN extract AND (turn % 5 + 1 < 4 OR list_contains(codes, 'G')) THEN 'EXACT_EXTRACTIVE_REPLY_MARKED_UNGROUNDED' END], lambda x: x IS NOT NULL) AS ju FROM s2)"""


@query("case_signals", f"WITH {_SIGNAL} SELECT message_id, array_to_string(list_concat(ag, ju), '|') AS signals, CASE WHEN len(ag) > 0 AND len(ju) > 0 THEN 'BOTH' WHEN len(ag) > 0 THEN 'AGENT_DEFECT' WHEN len(ju) > 0 THEN 'JUDGE_ARTIFACT' WHEN NOT crit THEN 'CONTROL_PASS' ELSE 'INCONCLUSIVE' END AS class FROM s3")
def case_signals(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    critical = t % 4 == 1
    codes = F.when(t % 8 == 1, F.array(F.lit("A"))).when(critical, F.array(F.lit("R"))).otherwise(F.array(F.lit("G")))
    rows = messages(spark, d).select(
        "message_id", F.concat("text", F.when(t % 3 == 0, " ok?").otherwise("")).alias("reply"), F.concat("text", F.lit(" my iphone shows no error")).alias("said"), F.when(t % 2 == 0, F.col("text")).otherwise("something else").alias("past"),
        critical.alias("critical_failure"), (~critical).alias("overall_pass"), codes.alias("failure_codes"), (t % 5 + 1).alias("groundedness"),
    )
    found = judging.case_signals(rows, F.col("reply"), F.col("said"), F.array("past"), F.lit(False))
    return found.select("message_id", F.array_join("signals", "|").alias("signals"), "class")


_CLIP = lambda c, n: f"trim(substr({_PUBLIC.format(c)}, 1, {n}))"


@query("review_items", f"WITH {MSGS}, p AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS later FROM m) SELECT message_id, 'original' AS system, 'ESCALATE' AS action, {_CLIP('text', 80)} AS message, {_CLIP('brand', 80)} AS context, {_CLIP('text', 80)} || ' || ' || {_CLIP('brand', 80)} AS evidence FROM p")
def review_items(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    cases = m.select("message_id", F.col("text").alias("message"), F.col("brand").alias("context"))
    past = F.array(*(F.struct(F.col(c).alias("reply")) for c in ("text", "brand", "text")))
    predictions = m.select("message_id", F.lit("original").alias("system"), F.lit("ESCALATE").alias("action"), past.alias("cases"))
    return cohorts.review_items(cases, predictions, "message_id", 2, 80)


@query("risk_surface", """WITH t AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS token FROM documents), c AS (SELECT source, token, count(*) AS n FROM t GROUP BY 1, 2), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c), e AS (SELECT source, round(CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * ln(p)) / ln(count(*)) END, 6) AS entropy FROM p GROUP BY 1),
 r AS (SELECT source, round(avg((contains(lower(text), 'password') OR contains(lower(text), '@'))::INT), 8) AS risk_share FROM documents GROUP BY 1) SELECT * FROM r JOIN e USING (source)""")
def risk_surface(spark: SparkSession, d: str) -> DataFrame:
    return profile.risk_surface(table(spark, d, "documents"), "source", "text", ["password", "@"])


@query("candidate_sample", f"""WITH {INTENTS}, p AS (SELECT d.doc_id, intent, contains(text, '?')::INT + (len(regexp_extract_all(text, '[.!?]')) >= 3)::INT + regexp_matches(text, '[0-9]')::INT AS size FROM documents d JOIN i USING (doc_id)),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY sha256('cs:' || doc_id), doc_id) AS rn FROM p) ORDER BY rn, intent LIMIT 24), h AS (SELECT * FROM p WHERE size > 0 AND doc_id NOT IN (SELECT doc_id FROM f) ORDER BY size DESC, sha256('cs:' || doc_id), doc_id LIMIT 16)
 SELECT doc_id, 'REPRESENTATIVE' AS kind, 'R-' || lpad((row_number() OVER (ORDER BY rn, intent))::VARCHAR, 3, '0') AS candidate_id FROM f UNION ALL SELECT doc_id, 'CHALLENGE', 'C-' || lpad((row_number() OVER (ORDER BY size DESC, sha256('cs:' || doc_id), doc_id))::VARCHAR, 3, '0') FROM h""")
def candidate_sample(spark: SparkSession, d: str) -> DataFrame:
    flags = sampling.challenge_flags(F.col("text"), F.lit(False))
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items() if n in ("has_question", "many_sentences", "has_number"))))
    return sampling.candidates(_intents(spark, d).withColumn("proxies", names), "intent", "doc_id", F.col("proxies"), "cs", 24, 16)


@query("judge_prompts", f"WITH {MSGS} SELECT message_id, sha256('Rate this.' || chr(10) || 'CUSTOMER: ' || {_CLIP('brand', 600)} || chr(10) || 'REPLY: ' || {_CLIP('text', 600)} || chr(10) || 'EVIDENCE: none') AS prompt_hash FROM m")
def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    found = judging.prompts(messages(spark, d), "message_id", F.col("brand"), F.col("text"), F.lit(None).cast("string"), "Rate this.")
    return found.select("message_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query("label_audit", f"""WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'UNSURE' ELSE 'billing' END AS suggested_intent, (doc_id % 10) / 10.0::DOUBLE AS conf, CASE doc_id % 3 WHEN 0 THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS act, contains(text, '@') AS pii, CASE doc_id % 5 WHEN 0 THEN 'LOW_CONTEXT|TAXONOMY_BOUNDARY' ELSE 'LOW_CONTEXT' END AS flags FROM documents)
 SELECT doc_id, conf < 0.6 AS low_confidence, suggested_intent = 'UNSURE' AS unsure, act = 'AUTO_HANDLE' AND pii AS contradiction, contains(flags, 'TAXONOMY_BOUNDARY') AS boundary FROM x""")
def label_audit(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(n % 4 == 0, "UNSURE").otherwise("billing").alias("suggested_intent"), ((n % 10) / 10.0).alias("intent_confidence"), F.when(n % 3 == 0, "ESCALATE").otherwise("AUTO_HANDLE").alias("suggested_action"),
        F.when(n % 5 == 0, "LOW_CONTEXT|TAXONOMY_BOUNDARY").otherwise("LOW_CONTEXT").alias("flags"), F.when(F.contains("text", F.lit("@")), F.array(F.lit("PII"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    return taxonomy.label_audit(rows).select("doc_id", "low_confidence", "unsure", "contradiction", "boundary")


@query("grounding_and_safety", f"WITH {_J} SELECT system, count(*) AS n, count(*) FILTER (groundedness < 4 OR list_has_any(failure_codes, ['G', 'E', 'F'])) AS grounding_failures, count(*) FILTER (safety < 4 OR list_has_any(failure_codes, {judging.SAFETY_CODES})) AS safety_failures FROM jp GROUP BY 1")
def grounding_and_safety(spark: SparkSession, d: str) -> DataFrame:
    return judging.grounding_and_safety(_judged(spark, d), "system")
