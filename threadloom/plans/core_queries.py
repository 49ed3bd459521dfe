"""Queries on threads, profiles, splits, samples, intents and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.durable import written
from threadloom.operators import metrics, profile, sampling, splits, taxonomy, threads
from threadloom.plans.registry import query
from threadloom.plans.views import FAULTS, LEAK, MSGS, NORM, SPLIT_OF, WORDS, messages, split_docs, with_faults
from threadloom.sources.tables import table

#: Terms that occur in the driver's invented texts.
ACTIONABLE = ["tion", "ung", "ment"]
GENERIC = ["the", "der", "les", "que"]
TAXONOMY = taxonomy.Taxonomy((taxonomy.Intent("billing", ("tion", "ing", "mente")), taxonomy.Intent("access", ("heit", "ed ", "eux")), taxonomy.Intent("playback", ("that", "und", "ción")), taxonomy.Intent("other", ())), "other")
WHOLE = taxonomy.Taxonomy((taxonomy.Intent("billing", ("the", "der", "les")), taxonomy.Intent("access", ("to", "und", "que")), taxonomy.Intent("playback", ("that", "nicht", "pour")), taxonomy.Intent("other", ())), "other")
SENSITIVE = ["password", "secret", "@"]


@query("thread_summary", f"""WITH {MSGS}, c AS (SELECT count(*) AS messages, count(*) FILTER (inbound) AS inbound_messages, count(*) FILTER (NOT inbound) AS outbound_messages,
 count(*) FILTER (inbound IS NULL) AS unknown_direction, count(DISTINCT author) AS authors, count(*) FILTER (parent_id = message_id) AS self_references FROM m),
 s AS (SELECT count(*) AS threads, count(*) FILTER (n = 1) AS single_message, count(*) FILTER (n = 2) AS two_message, count(*) FILTER (n >= 3) AS multi_turn FROM (SELECT conv_id, count(*) AS n FROM m GROUP BY 1)),
 l AS (SELECT count(*) AS linked FROM m WHERE parent_id IN (SELECT message_id FROM m)), o AS (SELECT count(*) AS orphans FROM m WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT message_id FROM m)),
 b AS (SELECT count(*) AS branching_threads FROM (SELECT parent_id FROM m WHERE parent_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
 SELECT * FROM c, l, o, s, b""")
def thread_summary(spark: SparkSession, d: str) -> DataFrame:
    return threads.summary(messages(spark, d))


@query("thread_roots", f"""WITH RECURSIVE {MSGS}, {FAULTS}, e AS (SELECT f.id, f.up FROM f JOIN f AS p ON f.up = p.id),
 reach(id, anc) AS (SELECT id, up FROM e UNION SELECT r.id, e.up FROM reach r JOIN e ON r.anc = e.id),
 cyc AS (SELECT DISTINCT id FROM reach WHERE id = anc)
 SELECT f.id AS node, coalesce((SELECT min(r.anc) FROM reach r JOIN cyc ON r.anc = cyc.id WHERE r.id = f.id), (SELECT min(r.anc) FROM reach r WHERE r.id = f.id AND r.anc NOT IN (SELECT id FROM e)), f.id) AS root,
 EXISTS (SELECT 1 FROM reach r JOIN cyc ON r.anc = cyc.id WHERE r.id = f.id) AS cyclic FROM f""")
def thread_roots(spark: SparkSession, d: str) -> DataFrame:
    return threads.roots(with_faults(messages(spark, d)))


@query("linked_pairs", f"""WITH {MSGS} SELECT b.brand, c.message_id AS customer_message FROM m b JOIN m c ON b.parent_id = c.message_id WHERE NOT b.inbound AND c.inbound
 UNION SELECT b.brand, c.message_id FROM m b JOIN m c ON c.parent_id = b.message_id WHERE NOT b.inbound AND c.inbound""")
def linked_pairs(spark: SparkSession, d: str) -> DataFrame:
    return threads.linked_pairs(messages(spark, d))


@query("nested_threads", f"""WITH {MSGS} SELECT conv_id, count(*) AS message_count, count(*) FILTER (inbound) AS customer_messages, count(*) FILTER (NOT inbound) AS brand_messages,
 sha256(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (inbound), '')) AS customer_text_hash, first(text ORDER BY turn) FILTER (NOT inbound) AS first_reply FROM m GROUP BY 1 HAVING count(*) FILTER (inbound) > 0 AND count(*) FILTER (NOT inbound) > 0""")
def nested_threads(spark: SparkSession, d: str) -> DataFrame:
    replies = F.filter("turns", lambda t: ~t["inbound"])
    return threads.nested(messages(spark, d)).select("conv_id", "message_count", "customer_messages", "brand_messages", F.sha2(threads.role_text(F.col("turns"), True), 256).alias("customer_text_hash"), replies[0]["text"].alias("first_reply"))


@query("inconsistent_children", f"""WITH {MSGS}, r AS (SELECT parent_id AS source, message_id AS child FROM m WHERE parent_id IS NOT NULL UNION SELECT message_id, lead(message_id, 2) OVER (PARTITION BY conv_id ORDER BY turn) FROM m)
 SELECT source, child FROM r JOIN m ON m.message_id = r.child WHERE m.parent_id IS DISTINCT FROM r.source""")
def inconsistent_children(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    listed = m.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("source"), F.col("message_id").alias("child"))
    # Every message also lists the one after next, which answers another.
    return threads.inconsistent_children(m, listed.union(m.select("message_id", F.lead("message_id", 2).over(Window.partitionBy("conv_id").orderBy("turn")))).distinct())


@query("time_inversions", f"WITH {MSGS}, {FAULTS} SELECT f.id AS message_id, f.up AS parent_id FROM f JOIN m c ON c.message_id::VARCHAR = f.id JOIN m p ON p.message_id::VARCHAR = f.up WHERE c.turn < p.turn")
def time_inversions(spark: SparkSession, d: str) -> DataFrame:
    return threads.inversions(with_faults(messages(spark, d))).select(F.col("message_id").cast("string"), F.col("parent_id").cast("string"))


_ANY = lambda terms: " OR ".join(f"contains(norm, '{t}')" for t in terms)
PROFILE_SQL = f"""WITH {MSGS}, r AS (SELECT brand, {NORM.format("text")} AS norm FROM m WHERE NOT inbound), w AS (SELECT *, {WORDS.format("norm")} AS words, ({_ANY(ACTIONABLE)}) AS act FROM r),
 g AS (SELECT *, ({_ANY(GENERIC)}) AND NOT act AND NOT contains(norm, '?') AS gen, words >= 8 AS sub FROM w),
 h AS (SELECT brand, sum(n) FILTER (rn <= 5) AS top_n, count(*) AS nd FROM (SELECT brand, norm, count(*) AS n, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, norm) AS rn FROM g GROUP BY 1, 2) GROUP BY 1),
 p AS (SELECT brand, count(*) AS messages, quantile_cont(words::DOUBLE, 0.5) AS median_words, count(*) FILTER (sub) AS s, count(*) FILTER (act) AS a, count(*) FILTER (gen) AS g, count(*) FILTER (sub AND NOT gen) AS c FROM g GROUP BY 1),
 prof AS (SELECT brand, messages, median_words, round(s / messages, 8) AS substantive_share, round(a / messages, 8) AS actionable_share, round(g / messages, 8) AS generic_share, round(c / messages, 8) AS contained_share,
 round(nd / messages, 8) AS unique_ratio, round(1 - nd / messages, 8) AS duplicate_rate, round(top_n / messages, 8) AS top_template_share FROM p JOIN h USING (brand))"""


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(messages(spark, d).where(~F.col("inbound")), "brand", "text", ACTIONABLE, GENERIC)


@query("brand_profile", PROFILE_SQL + " SELECT * FROM prof")
def brand_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)


@query("select_brand", PROFILE_SQL + " SELECT brand, messages, contained_share FROM prof ORDER BY contained_share DESC NULLS LAST, messages DESC NULLS LAST, lower(brand), brand LIMIT 1")
def select_brand(spark: SparkSession, d: str) -> DataFrame:
    return profile.select_best(_profile(spark, d), ["contained_share", "messages"]).select("brand", "messages", "contained_share")


@query("weighted_brand", PROFILE_SQL + """ SELECT brand, weight_set, score FROM (SELECT *, row_number() OVER (PARTITION BY weight_set ORDER BY score DESC, lower(brand), brand) AS rn FROM (
 SELECT brand, 'balanced' AS weight_set, round(contained_share * 0.5 + unique_ratio * 0.5, 8) AS score FROM prof UNION ALL SELECT brand, 'action', round(actionable_share * 0.7 + unique_ratio * 0.3, 8) FROM prof)) WHERE rn = 1""")
def weighted_brand(spark: SparkSession, d: str) -> DataFrame:
    sets = {"balanced": {"contained_share": 0.5, "unique_ratio": 0.5}, "action": {"actionable_share": 0.7, "unique_ratio": 0.3}}
    return profile.weighted(_profile(spark, d), sets)


@query("median_words_by_source", f"SELECT source, count(*) AS docs, quantile_cont(({WORDS.format('text')})::DOUBLE, 0.5) AS median_words FROM documents GROUP BY 1")
def median_words_by_source(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", tx.word_count(F.col("text")).alias("w"))
    return docs.groupBy("source").agg(F.count("*").alias("docs"), F.percentile("w", 0.5).alias("median_words"))


@query("token_entropy", """WITH t AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS token FROM documents), c AS (SELECT source, token, count(*) AS n FROM t GROUP BY 1, 2),
 p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c) SELECT source, count(*) AS keys, round(CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * ln(p)) / ln(count(*)) END, 6) AS entropy FROM p GROUP BY 1""")
def token_entropy(spark: SparkSession, d: str) -> DataFrame:
    return profile.entropy(profile.token_counts(table(spark, d, "documents"), "source", "text"), "source", "n")


_TEMPORAL = "SELECT doc_id, CASE WHEN rn <= floor(n * 0.7) THEN 'TRAIN' WHEN rn <= floor(n * 0.85) THEN 'DEVELOPMENT' ELSE 'GOLD' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rn, count(*) OVER () AS n FROM documents)"


@query("temporal_split", _TEMPORAL)
def temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.temporal_split(table(spark, d, "documents"), "n_chars", "doc_id")


@query("hash_split", "SELECT doc_id, CASE WHEN u < 0.7 THEN 'TRAIN' WHEN u < 0.85 THEN 'DEVELOPMENT' ELSE 'GOLD' END AS split FROM (SELECT doc_id, ('0x' || substr(sha256('s1:' || doc_id), 1, 16))::UBIGINT::DOUBLE / pow(2, 64) AS u FROM documents)")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.hash_split(table(spark, d, "documents"), "doc_id", "s1")


@query("time_bins", "SELECT event_id, least((rn - 1) * 7 // n, 6)::BIGINT AS bin FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)")
def time_bins(spark: SparkSession, d: str) -> DataFrame:
    return splits.time_bins(table(spark, d, "events"), "ts", "event_id", 7)


KEYED = f"k AS (SELECT doc_id AS id, {SPLIT_OF} AS split, unnest([{LEAK.format('text')}, substr({NORM.format('text')}, 1, 240)]) AS raw_key FROM documents WHERE {WORDS.format('text')} >= 8), kk AS (SELECT id, split, sha256(raw_key) AS key FROM k)"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    docs = split_docs(spark, d).where(tx.word_count(F.col("text")) >= 8).select(F.col("doc_id").alias("id"), "split", tx.normalized_reply(F.col("text")).alias("norm"))
    keys = F.array(F.sha2(tx.numbers_masked(F.col("norm")), 256), F.sha2(F.substr("norm", F.lit(1), F.lit(240)), 256))
    return written(docs.select("id", "split", F.explode(keys).alias("key")))  # read several times: texts are normalised once


@query("exact_collisions", f"WITH {KEYED} SELECT key AS key_hash, count(DISTINCT split) AS splits, count(DISTINCT id) AS ids, min(id) AS first_id FROM kk GROUP BY key HAVING count(DISTINCT split) > 1")
def exact_collisions(spark: SparkSession, d: str) -> DataFrame:
    return splits.exact_collisions(_keyed(spark, d))


@query("decontaminate_exact", f"""WITH {KEYED}, t AS (SELECT DISTINCT key FROM kk WHERE split = 'TRAIN'), dg AS (SELECT DISTINCT id FROM kk WHERE split = 'DEVELOPMENT' AND key IN (SELECT key FROM t)),
 o AS (SELECT key FROM t UNION SELECT key FROM kk WHERE split = 'DEVELOPMENT' AND id NOT IN (SELECT id FROM dg)), gg AS (SELECT DISTINCT id FROM kk WHERE split = 'GOLD' AND key IN (SELECT key FROM o))
 SELECT DISTINCT id, split, id IN (SELECT id FROM dg UNION SELECT id FROM gg) AS dropped FROM kk""")
def decontaminate_exact(spark: SparkSession, d: str) -> DataFrame:
    return splits.decontaminate_exact(_keyed(spark, d))


PAIRS = f"""n AS (SELECT doc_id AS id, {SPLIT_OF} AS split, {LEAK.format('text')} AS t FROM documents),
 g AS (SELECT id, split, CASE WHEN t = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length(t) - 3, 2)), lambda i: substr(t, i, 5))) END AS grams FROM n),
 s AS (SELECT id, split, len(grams) AS n, unnest(list_sort(list_transform(grams, lambda x: md5(x)))[1:12]) AS h FROM g), u AS (SELECT h FROM s GROUP BY h HAVING count(*) BETWEEN 2 AND 250),
 c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM s x JOIN s y USING (h) WHERE h IN (SELECT h FROM u) AND x.id < y.id AND x.split <> y.split AND least(x.n, y.n) >= 0.92::DOUBLE * greatest(x.n, y.n)),
 pairs AS (SELECT * FROM (SELECT a, b, round(len(list_intersect(x.grams, y.grams))::DOUBLE / (len(x.grams) + len(y.grams) - len(list_intersect(x.grams, y.grams))), 8) AS similarity FROM c JOIN g x ON x.id = a JOIN g y ON y.id = b) WHERE similarity >= 0.92)"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    return splits.near_pairs(split_docs(spark, d), "doc_id")


@query("near_duplicate_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d)


@query("decontaminate_near", f"""WITH {PAIRS}, b AS (SELECT p.*, x.split AS sa, y.split AS sb, row_number() OVER (ORDER BY -similarity, a, b) AS place FROM pairs p JOIN n x ON x.id = a JOIN n y ON y.id = b),
 z AS (SELECT place, a AS early, sa AS se, b AS late, sb AS sl FROM b UNION ALL SELECT place, b, sb, a, sa FROM b), dv AS (SELECT late, min(place) AS gone_at FROM z WHERE se = 'TRAIN' AND sl = 'DEVELOPMENT' GROUP BY 1),
 gone AS (SELECT late FROM dv UNION SELECT late FROM z WHERE se = 'TRAIN' AND sl = 'GOLD' UNION SELECT z.late FROM z LEFT JOIN dv ON dv.late = z.early WHERE se = 'DEVELOPMENT' AND sl = 'GOLD' AND (gone_at IS NULL OR place < gone_at))
 SELECT id, split, id IN (SELECT late FROM gone) AS dropped FROM n""")
def decontaminate_near(spark: SparkSession, d: str) -> DataFrame:
    assigned = split_docs(spark, d).select(F.col("doc_id").alias("id"), "split")
    return splits.decontaminate_near(assigned, _near(spark, d))


# A value that more than 250 documents share proposes no pairs above, as in the semantics followed there. These two have no such
# limit: documents with equal grams are compared once for each split, and tokens count beside characters.
@query("near_duplicate_pairs_whole", None)
def near_duplicate_pairs_whole(spark: SparkSession, d: str) -> DataFrame:
    return splits.near_pairs(split_docs(spark, d), "doc_id", token_threshold=0.9, most=None)


@query("decontaminate_near_whole", None)
def decontaminate_near_whole(spark: SparkSession, d: str) -> DataFrame:
    docs = split_docs(spark, d)
    members = splits.copies(docs, "doc_id")
    pairs = splits.near_pairs(docs, "doc_id", token_threshold=0.9, most=None)
    found = splits.decontaminate_near(members.where("id = rep").select("id", "split"), pairs).select(F.col("id").alias("rep"), "dropped")
    return members.join(found, "rep").select("id", "split", "dropped")


@query("sanitize_text", r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', '<URL>', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<EMAIL>', 'g'), '@[A-Za-z0-9_]+', '<HANDLE>', 'g'), '[0-9]{7,}', '<NUMBER>', 'g'), '\s+', ' ', 'g'), ' ')) AS clean_hash FROM documents""")
def sanitize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.sanitize_public(F.col("text")), 256).alias("clean_hash"))


_SCORE = lambda i: " + ".join(f"contains(lower(text), '{s}')::INT" for s in i.signals) or "0"
INTENT_SQL = "CASE WHEN greatest(s0, s1, s2) = 0 THEN 'other' WHEN s0 >= s1 AND s0 >= s2 THEN 'billing' WHEN s1 >= s2 THEN 'access' ELSE 'playback' END"
INTENTS = f"i AS (SELECT doc_id, {INTENT_SQL} AS intent FROM (SELECT doc_id, {', '.join(f'({_SCORE(x)}) AS s{k}' for k, x in enumerate(TAXONOMY.intents[:3]))} FROM documents))"


@query("intent_rules", f"WITH {INTENTS} SELECT * FROM i")
def intent_rules(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", taxonomy.provisional_intent(F.col("text"), TAXONOMY).alias("intent"))


_WHOLE = lambda i: " + ".join(f"regexp_matches(lower(text), '(^|[^a-z0-9]){s}($|[^a-z0-9])')::INT" for s in i.signals)


@query("provisional_labels", f"""WITH s AS (SELECT doc_id, {', '.join(f'({_WHOLE(x)}) AS s{k}' for k, x in enumerate(WHOLE.intents[:3]))}, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS tk, ({' OR '.join(f"contains(lower(text), '{x}')" for x in SENSITIVE)}) AS sens FROM documents),
 r AS (SELECT *, list_reverse_sort([s0, s1, s2, 0]) AS rk, (s0 > 0)::INT + (s1 > 0)::INT + (s2 > 0)::INT AS act FROM s), q AS (SELECT *, rk[1] AS top, rk[2] AS sec, CASE WHEN s0 = rk[1] THEN 'billing' WHEN s1 = rk[1] THEN 'access' WHEN s2 = rk[1] THEN 'playback' ELSE 'other' END AS name FROM r),
 c AS (SELECT *, top = 0 OR top = sec AS unsure, CASE WHEN top = 0 THEN 0.20 WHEN top = sec THEN 0.35 ELSE round(least(0.94::DOUBLE, 0.54::DOUBLE + 0.12::DOUBLE * top + 0.06::DOUBLE * (top - sec)), 2) END::DOUBLE AS conf FROM q)
 SELECT doc_id, CASE WHEN unsure THEN 'UNSURE' ELSE name END AS suggested_intent, conf AS intent_confidence, CASE WHEN unsure OR sens OR act >= 3 OR name = 'other' THEN 'ESCALATE' ELSE 'AUTO_HANDLE' END AS suggested_action,
 array_to_string(list_filter([CASE WHEN top > 0 AND top = sec THEN 'INTENT_TIE' END, CASE WHEN tk <= 5 THEN 'LOW_CONTEXT' END, CASE WHEN conf < 0.6 THEN 'LOW_INTENT_CONFIDENCE' END, CASE WHEN NOT unsure AND act > 1 THEN 'MULTI_INTENT_SIGNAL' END,
 CASE WHEN top = 0 THEN 'NO_TAXONOMY_SIGNAL' END, CASE WHEN (top > 0 AND top = sec) OR (NOT unsure AND act > 1 AND top - sec <= 1) THEN 'TAXONOMY_BOUNDARY' END], lambda x: x IS NOT NULL), '|') AS flags FROM c""")
def provisional_labels(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", taxonomy.label(F.col("text"), WHOLE, SENSITIVE).alias("label")).select("doc_id", "label.*")


@query("round_robin_sample", "SELECT doc_id, lang, rn FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('rr:' || doc_id), doc_id) AS rn FROM documents) ORDER BY rn, lang LIMIT 60")
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.round_robin(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", "rr", 60).select("doc_id", "lang", F.col("rn").cast("bigint").alias("rn"))


@query("hash_sample_quota", "SELECT doc_id, source, rn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('q:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 3")
def hash_sample_quota(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quota_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", "q", 3).select("doc_id", "source", F.col("rn").cast("bigint").alias("rn"))


@query("challenge_proxies", f"""WITH {INTENTS} SELECT d.doc_id, contains(text, '?') AS has_question, len(regexp_extract_all(text, '[.!?]')) >= 3 AS many_sentences, regexp_matches(text, '[0-9]') AS has_number, {WORDS.format('text')} <= 5 AS low_context, intent = 'other' AS boundary FROM documents d JOIN i USING (doc_id)""")
def challenge_proxies(spark: SparkSession, d: str) -> DataFrame:
    intent = taxonomy.provisional_intent(F.col("text"), TAXONOMY)
    flags = sampling.challenge_flags(F.col("text"), intent == "other")
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in flags.items()))


@query("topic_quotas", """WITH c AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), e AS (SELECT *, size * 50.0::DOUBLE / sum(size) OVER () AS x FROM c), f AS (SELECT *, greatest(floor(x), 1) AS seats, row_number() OVER (ORDER BY x - floor(x) DESC, lang) AS turn FROM e)
 SELECT lang, size, (seats + CASE WHEN turn <= 50 - sum(seats) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""")
def topic_quotas(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quotas(table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("size")), "lang", 50)


GOLD = """g AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS gold, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'stupid') THEN 'toxic' WHEN regexp_matches(text, '[#%&|]|!!') THEN 'poor' ELSE 'good' END AS pred,
 1 + length(text) % 5 AS ra, 1 + (length(text) + quality) % 5 AS rb, quality FROM labels l JOIN documents USING (doc_id))"""
CELLS = GOLD + """, n AS (SELECT unnest(['good', 'poor', 'toxic']) AS l), cells AS (SELECT x.l AS gold, y.l AS pred, (SELECT count(*) FROM g WHERE g.gold = x.l AND g.pred = y.l) AS n FROM n x, n y),
 k AS (SELECT l AS label, (SELECT sum(n) FROM cells WHERE gold = l)::BIGINT AS support, (SELECT sum(n) FROM cells WHERE pred = l)::BIGINT AS pr, (SELECT n FROM cells WHERE gold = l AND pred = l) AS hit FROM n),
 cm AS (SELECT label, support, round(coalesce(hit / nullif(pr, 0), 0), 8) AS precision, round(coalesce(hit / nullif(support, 0), 0), 8) AS recall, round(coalesce(2.0 * hit / nullif(pr + support, 0), 0)::DOUBLE, 8) AS f1 FROM k)"""
LABELS = ["good", "poor", "toxic"]


def _graded(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    low = F.lower("text")
    pred = F.when(F.contains(low, F.lit("idiot")) | F.contains(low, F.lit("stupid")), "toxic").when(F.col("text").rlike("[#%&|]|!!"), "poor").otherwise("good")
    gold = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    return j.select("doc_id", gold.alias("gold"), pred.alias("pred"), (1 + F.length("text") % 5).alias("ra"), (1 + (F.length("text") + F.col("quality")) % 5).alias("rb"), "quality")


@query("confusion", f"WITH {CELLS} SELECT * FROM cells")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(_graded(spark, d), LABELS)


@query("class_metrics", f"WITH {CELLS} SELECT * FROM cm")
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.class_metrics(metrics.confusion(_graded(spark, d), LABELS))


@query("overall_metrics", f"WITH {CELLS} SELECT round((SELECT sum(n) FROM cells WHERE gold = pred) / (SELECT sum(n) FROM cells), 8) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM cm")
def overall_metrics(spark: SparkSession, d: str) -> DataFrame:
    cells = metrics.confusion(_graded(spark, d), LABELS)
    return metrics.overall(metrics.class_metrics(cells), cells)


@query("action_metrics", f"""WITH {GOLD}, c AS (SELECT count(*) AS n, count(*) FILTER (gold <> 'good' AND pred <> 'good') AS tp, count(*) FILTER (gold = 'good' AND pred <> 'good') AS fp, count(*) FILTER (gold <> 'good' AND pred = 'good') AS fn, count(*) FILTER (gold = 'good' AND pred = 'good') AS tn FROM g)
 SELECT n, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 8) AS false_escalation,
 round(coalesce(fn / nullif(tp + fn, 0), 0), 8) AS missed_escalation, round(coalesce(fn / nullif(fn + tn, 0), 0), 8) AS unsafe_auto, round((fn + tn) / n, 8) AS coverage FROM c""")
def action_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.action_metrics(_graded(spark, d), F.col("gold") != "good", F.col("pred") != "good")


@query("ece_brier", f"""WITH {GOLD}, c AS (SELECT quality::DOUBLE AS y, (doc_id % 11) / 10.0::DOUBLE AS c FROM g), b AS (SELECT least(floor(c * 5), 4) AS b, count(*) AS n, avg(y) AS y, avg(c) AS c, sum(pow(y - c, 2)) AS s FROM c GROUP BY 1)
 SELECT sum(n)::BIGINT AS n, round(sum(n * abs(y - c)) / sum(n), 8) AS ece, round(sum(s) / sum(n), 8) AS brier FROM b""")
def ece_brier(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration(_graded(spark, d), F.col("quality"), (F.col("doc_id") % 11) / F.lit(10.0), 5)


@query("agreement", f"""WITH {GOLD}, v AS (SELECT v, row_number() OVER (ORDER BY v) AS pos FROM (SELECT ra AS v FROM g UNION SELECT rb FROM g)), p AS (SELECT ra, rb, x.pos AS pa, y.pos AS pb FROM g JOIN v x ON x.v = ra JOIN v y ON y.v = rb),
 ma AS (SELECT pa, count(*) AS na FROM p GROUP BY 1), mb AS (SELECT pb, count(*) AS nb FROM p GROUP BY 1), due AS (SELECT sum(na * nb * pow(pa - pb, 2)) AS due FROM ma, mb),
 xa AS (SELECT pa, rank() OVER (ORDER BY pa) + (count(*) OVER (PARTITION BY pa) - 1) / 2.0 AS r, row_number() OVER () AS k FROM p), ra_ AS (SELECT DISTINCT pa, rank() OVER (ORDER BY pa) + (count(*) OVER (PARTITION BY pa) - 1) / 2.0 AS x FROM p), rb_ AS (SELECT DISTINCT pb, rank() OVER (ORDER BY pb) + (count(*) OVER (PARTITION BY pb) - 1) / 2.0 AS y FROM p)
 SELECT count(*) AS n, round(avg((ra = rb)::INT), 8) AS exact, round(avg((abs(ra - rb) <= 1)::INT), 8) AS within_one, round(1 - sum(pow(pa - pb, 2)) * count(*) / (SELECT due FROM due), 8) AS kappa, round(corr(x::DOUBLE, y::DOUBLE), 8) AS spearman FROM p JOIN ra_ USING (pa) JOIN rb_ USING (pb)""")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    return metrics.agreement(_graded(spark, d), "ra", "rb")


_PREF = "SELECT CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'TIE' END AS f, CASE length(text) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'TIE' END AS s FROM documents"


@query("order_bias", f"SELECT count(*) AS n, round(avg((f <> CASE s WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE 'TIE' END)::INT), 8) AS flip_rate, round(((count(*) FILTER (f = 'A')) + (count(*) FILTER (s = 'A'))) / (2 * count(*)), 8) AS first_position_share FROM ({_PREF})")
def order_bias(spark: SparkSession, d: str) -> DataFrame:
    said = lambda n: F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").otherwise("TIE")
    return metrics.order_bias(table(spark, d, "documents").select(said(F.col("doc_id")).alias("first"), said(F.length("text")).alias("second")))


#: How often a replicate draws a row, from the hash of seed, key and block of eight replicates.
def times_sql(seed: str, key: str, rep: str) -> str:
    hexed = f"substr(sha256('{seed}:' || {key} || ':' || ({rep} // 8)), 1 + 8 * ({rep} % 8), 8)"
    return "(" + " + ".join(f"(('0x' || {hexed})::UBIGINT >= {bound})::INT" for bound in metrics.POISSON) + ")"


BOOT = f"""v AS (SELECT source, sum((lang = 'en')::INT) AS num, count(*) AS den FROM documents GROUP BY source), d AS (SELECT r, num, den, {times_sql('b', 'source', 'r')} AS times FROM v, range(500) t(r)),
 x AS (SELECT r, round(coalesce(sum(times * num) / nullif(sum(times * den), 0), 0), 10) AS x FROM d WHERE times > 0 GROUP BY 1)"""


@query("bootstrap_ratio", f"WITH {BOOT} SELECT 'share' AS statistic, (SELECT round(sum(num) / sum(den), 8) FROM v) AS estimate, round(quantile_cont(x, 0.025), 8) AS low, round(quantile_cont(x, 0.975), 8) AS high FROM x")
def bootstrap_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Sources are what is drawn: all documents of one come together."""
    per = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("num"), F.count("*").alias("den"))
    sums = {"num": F.col("num"), "den": F.col("den")}
    return metrics.bootstrap_of(per, F.col("source"), "b", 500, sums, {"share": tx.ratio(F.col("num"), F.col("den"))})
