"""Queries on ingestion, thread quality, full profiles, text rules, composers and the verifier."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.durable import shared_dir
from threadloom.operators import gates, profile, threads
from threadloom.plans.core_queries import ACTIONABLE, GENERIC
from threadloom.plans.registry import query
from threadloom.plans.views import FAULTS, MSGS, NORM, WORDS, messages, with_faults
from threadloom.sources import exports
from threadloom.sources.tables import table

_ID = "(conv_id * 1000 + turn)"
#: What parsing the export below gives. Every fifth kind of trouble that an export has occurs in it.
PARSED = f"""x AS (SELECT conv_id, turn, {_ID} AS id, text FROM conversations), parsed AS (SELECT CASE WHEN turn % 6 IN (4, 5) THEN NULL ELSE id::VARCHAR END AS message_id,
 CASE turn % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS inbound, CASE turn % 3 WHEN 0 THEN 1506852000 + 86400 * (turn % 9) WHEN 1 THEN 1509487840 + turn % 10 END::BIGINT AS created,
 CASE WHEN turn = 0 OR turn % 5 = 3 THEN NULL ELSE (id - 1)::VARCHAR END AS parent_id, CASE turn % 2 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS children, CASE WHEN turn % 6 IN (4, 5) THEN 1 ELSE 0 END::BIGINT AS malformed_ids,
 ((turn % 2 = 0)::INT + (turn > 0 AND turn % 5 = 3)::INT)::BIGINT AS malformed_lineage, turn % 4 = 3 AS invalid_inbound, ({WORDS.format(NORM.format('text'))})::BIGINT AS words, text FROM x)"""


def raw_export(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as rows of an export, all strings, with every kind of malformed value."""
    n, t = F.col("conv_id") * 1000 + F.col("turn"), F.col("turn")
    word = lambda c: c.cast("string")
    listed = F.when(t % 2 == 0, F.concat(F.lit('["'), word(n + 1), F.lit('", "oops"]'))).otherwise(F.concat(word(n + 1), F.lit(", "), word(n + 2)))
    time = F.when(t % 3 == 0, F.concat(F.lit("2017-10-0"), word(1 + t % 9), F.lit("T10:00:00Z"))).when(t % 3 == 1, F.concat(F.lit("Tue Oct 31 22:10:4"), word(t % 10), F.lit(" +0000 2017"))).otherwise("soon")
    return table(spark, d, "conversations").select(
        F.when(t % 6 == 5, F.concat(F.lit("m"), word(n))).when(t % 6 == 4, F.concat(word(n), F.lit(","), word(n + 1))).otherwise(word(n)).alias("Message_ID"),
        F.concat(F.lit(" author "), word(F.col("conv_id"))).alias("account_id"),
        F.when(t % 4 == 0, " TRUE ").when(t % 4 == 1, "no").when(t % 4 == 2, "").otherwise("maybe").alias("is_inbound"),
        time.alias("timestamp"),
        F.col("text").alias("message"),
        listed.alias("response_tweet_ids"),
        F.when(t == 0, "nan").when(t % 5 == 3, F.concat(word(n - 1), F.lit(","), word(n - 2))).otherwise(word(n - 1)).alias("parent_id"),
    )


def _aliased(raw: DataFrame) -> DataFrame:
    found = exports.resolve(raw.columns)
    return raw.select(*(F.col(found[c]).alias(c) for c in exports.ALIASES))


def _shown(parsed: DataFrame) -> DataFrame:
    return parsed.select("message_id", "inbound", F.unix_timestamp("created_at").alias("created"), "parent_id", F.size("children").cast("bigint").alias("children"), F.col("malformed_ids").cast("bigint"), F.col("malformed_lineage").cast("bigint"), "invalid_inbound", "words", F.sha2("text", 256).alias("text_hash"))


_SHOWN = "SELECT message_id, inbound, created, parent_id, children, malformed_ids, malformed_lineage, invalid_inbound, words, sha256(text) AS text_hash FROM parsed"


@query("parsed_messages", f"WITH {PARSED} {_SHOWN}")
def parsed_messages(spark: SparkSession, d: str) -> DataFrame:
    return _shown(exports.parse(_aliased(raw_export(spark, d))))


@query("csv_export", f"WITH {PARSED} {_SHOWN}")
def csv_export(spark: SparkSession, d: str) -> DataFrame:
    """The export written as CSV, with line breaks and quotes in texts, and read again."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"  # read lazily, so never written again
    raw_export(spark, d).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return _shown(exports.parse(exports.read_csv(spark, path)))


@query("ingest_counters", f"""WITH {PARSED}, twice AS (SELECT * FROM parsed UNION ALL SELECT * FROM parsed) SELECT count(*) AS rows, sum(malformed_ids)::BIGINT AS malformed_ids, sum(malformed_lineage)::BIGINT AS malformed_lineage, count(*) FILTER (invalid_inbound) AS invalid_inbound,
 count(message_id) - count(DISTINCT message_id) AS duplicates, count(*) FILTER (created IS NULL) AS timestamp_failures, count(DISTINCT message_id) AS kept, (SELECT sum(length(text)) FROM parsed WHERE message_id IS NOT NULL)::BIGINT AS kept_chars FROM twice""")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    """Every row comes twice, the second time with another text; the first row of an id is kept."""
    parsed = exports.parse(_aliased(raw_export(spark, d)))
    twice = parsed.withColumn("seq", F.lit(1)).unionByName(parsed.withColumn("text", F.concat(F.lit("later "), "text")).withColumn("seq", F.lit(2)))
    kept, counters = exports.ingest(twice, "seq")
    return counters.join(F.broadcast(kept.agg(F.count("*").alias("kept"), F.sum(F.length("text")).alias("kept_chars"))))  # one row each


_REFS = "r AS (SELECT up AS source, id AS child FROM f WHERE up IS NOT NULL UNION SELECT id, (conv_id * 1000 + turn + 1)::VARCHAR FROM f UNION SELECT id, lead(id, 2) OVER (PARTITION BY conv_id ORDER BY turn) FROM f)"
_REFS = _REFS.replace("FROM f)", "FROM f QUALIFY lead(id, 2) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL)")
_ROOTS = f"""e AS (SELECT f.id, f.up FROM f JOIN f AS p ON f.up = p.id), reach(id, anc) AS (SELECT id, up FROM e UNION SELECT r.id, e.up FROM reach r JOIN e ON r.anc = e.id), cyc AS (SELECT DISTINCT id FROM reach WHERE id = anc),
 rc AS (SELECT r.id, min(r.anc) AS root FROM reach r JOIN cyc ON r.anc = cyc.id GROUP BY 1), rn AS (SELECT id, min(anc) AS root FROM reach WHERE anc NOT IN (SELECT id FROM e) GROUP BY 1),
 rt AS (SELECT f.id, coalesce(rc.root, rn.root, f.id) AS root, rc.root IS NOT NULL AS cyclic FROM f LEFT JOIN rc USING (id) LEFT JOIN rn USING (id)), sz AS (SELECT root, count(*) AS n FROM rt GROUP BY 1)"""


def _listed(m: DataFrame) -> DataFrame:
    """Child references: what answers a message, the next number (missing after the last), and the one after next."""
    from pyspark.sql import Window

    word = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    after = F.lead("message_id", 2).over(Window.partitionBy("conv_id").orderBy("turn"))
    later = m.select(word("message_id").alias("source"), word(after).alias("child")).where(F.col("child").isNotNull())
    return m.where(F.col("parent_id").isNotNull()).select(word("parent_id").alias("source"), word("message_id").alias("child")).union(m.select(word("message_id"), word(F.col("message_id") + 1))).union(later).distinct()


@query("thread_quality", f"""WITH RECURSIVE {MSGS}, {FAULTS}, {_ROOTS}, {_REFS}
 SELECT (SELECT count(*) FROM f) AS messages, (SELECT count(*) FROM f WHERE inbound) AS inbound_messages, (SELECT count(*) FROM f WHERE NOT inbound) AS outbound_messages, (SELECT count(*) FROM f WHERE inbound IS NULL) AS unknown_direction, (SELECT count(DISTINCT author) FROM f) AS authors,
 (SELECT count(*) FROM f WHERE up = id) AS self_references, (SELECT count(*) FROM e) AS linked, (SELECT count(*) FROM f WHERE up IS NOT NULL AND up NOT IN (SELECT id FROM f)) AS orphans, (SELECT count(*) FROM sz) AS threads, (SELECT count(*) FROM sz WHERE n = 1) AS single_message,
 (SELECT count(*) FROM sz WHERE n = 2) AS two_message, (SELECT count(*) FROM sz WHERE n >= 3) AS multi_turn, (SELECT count(*) FROM f WHERE up IS NULL) AS root_messages, (SELECT count(*) FROM r) AS child_references, (SELECT count(*) FROM r WHERE child NOT IN (SELECT id FROM f)) AS missing_children,
 (SELECT count(*) FROM r JOIN f ON f.id = r.child WHERE f.up IS DISTINCT FROM r.source) AS inconsistent_children, (SELECT count(*) FROM f c JOIN f p ON c.up = p.id WHERE c.turn < p.turn) AS chronological_inconsistencies,
 (SELECT count(DISTINCT root) FROM (SELECT up FROM f WHERE up IS NOT NULL GROUP BY 1 HAVING count(*) > 1) b JOIN rt ON rt.id = b.up) AS branching_threads, (SELECT count(DISTINCT root) FROM rt WHERE cyclic) AS cyclic_components""")
def thread_quality(spark: SparkSession, d: str) -> DataFrame:
    m = with_faults(messages(spark, d))
    return threads.quality(m, _listed(m), threads.roots(m))


@query("missing_children", f"WITH {MSGS}, {FAULTS}, {_REFS} SELECT source, child FROM r WHERE child NOT IN (SELECT id FROM f)")
def missing_children(spark: SparkSession, d: str) -> DataFrame:
    m = with_faults(messages(spark, d))
    return threads.missing_children(m.withColumn("message_id", F.col("message_id").cast("string")), _listed(m))


@query("brand_threads", f"""WITH RECURSIVE {MSGS}, {FAULTS}, {_ROOTS}, o AS (SELECT f.*, rt.root, sz.n, p.id AS present FROM f JOIN rt USING (id) JOIN sz USING (root) LEFT JOIN f p ON f.up = p.id WHERE NOT f.inbound),
 lp AS (SELECT b.brand, c.id FROM f b JOIN f c ON b.up = c.id WHERE NOT b.inbound AND c.inbound UNION SELECT b.brand, c.id FROM f b JOIN f c ON c.up = b.id WHERE NOT b.inbound AND c.inbound),
 q AS (SELECT lp.brand, count(*) AS pairs, count(DISTINCT id) AS customers, count(DISTINCT {NORM.format('text')}) AS different FROM lp JOIN f USING (id) GROUP BY 1),
 w AS (SELECT brand, count(*) AS messages, count(DISTINCT root) AS threads, count(DISTINCT CASE WHEN n >= 3 THEN root END) AS multi_turn_threads, count(present) AS linked, count(*) FILTER (up IS NOT NULL AND present IS NULL) AS orphaned FROM o GROUP BY 1)
 SELECT brand, coalesce(customers, 0) AS customers, coalesce(pairs, 0) AS pairs, threads, multi_turn_threads, round(linked / messages, 8) AS parent_completeness, round(orphaned / messages, 8) AS orphan_rate, round(coalesce(different / customers, 0), 8) AS customer_diversity FROM w LEFT JOIN q USING (brand)""".replace("JOIN f USING (id) GROUP BY 1)", "JOIN f ON f.id = lp.id GROUP BY 1)").replace("count(DISTINCT id) AS customers", "count(DISTINCT lp.id) AS customers"))
def brand_threads(spark: SparkSession, d: str) -> DataFrame:
    m = with_faults(messages(spark, d))
    return profile.thread_profile(threads.with_roots(m, threads.roots(m)), threads.linked_pairs(m))


@query("top_template", f"WITH {MSGS} SELECT brand, sha256(t) AS template_hash, n FROM (SELECT brand, {NORM.format('text')} AS t, count(*) AS n, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, {NORM.format('text')}) AS rn FROM m WHERE NOT inbound GROUP BY 1, 2) WHERE rn = 1")
def top_template(spark: SparkSession, d: str) -> DataFrame:
    return profile.top_templates(messages(spark, d).where(~F.col("inbound")), "brand", "text").select("brand", F.sha2("template", 256).alias("template_hash"), "n")


@query("volume_floor", "SELECT source, count(*) AS messages FROM documents GROUP BY 1 HAVING count(*) >= (SELECT count(*) / count(DISTINCT source) FROM documents)")
def volume_floor(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    n, k = docs.agg(F.count("*"), F.count_distinct("source")).first()
    return profile.volume_floor(docs, "source", -(-n // k))


@query("extreme_brands", "WITH p AS (SELECT source, avg(n_chars) AS v FROM documents GROUP BY 1) SELECT (SELECT source FROM p ORDER BY v DESC, source LIMIT 1) AS highest, (SELECT source FROM p ORDER BY v, source LIMIT 1) AS lowest")
def extreme_brands(spark: SparkSession, d: str) -> DataFrame:
    return profile.extreme(table(spark, d, "documents").groupBy("source").agg(F.avg("n_chars").alias("v")), "v", "source")


@query("ordinal_values", "SELECT source, round(coalesce(avg(CASE WHEN n_chars > 3000 THEN 1.0 WHEN n_chars > 1000 THEN 0.5 WHEN n_chars > 200 THEN 0.0 END), 0.5)::DOUBLE, 8) AS value FROM documents GROUP BY 1")
def ordinal_values(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("n_chars") > 3000, "HIGH").when(F.col("n_chars") > 1000, "MEDIUM").when(F.col("n_chars") > 200, "LOW")
    return profile.ordinal(table(spark, d, "documents").withColumn("level", level), "source", "level")


@query("corpus_manifest", f"""WITH {MSGS}, t AS (SELECT conv_id, count(*) AS n, count(*) FILTER (inbound) AS c, count(*) FILTER (NOT inbound) AS b, min(turn) AS first, max(turn) AS last FROM m GROUP BY 1 HAVING count(*) FILTER (inbound) > 0 AND count(*) FILTER (NOT inbound) > 0)
 SELECT count(*) AS threads, sum(n)::BIGINT AS messages, sum(c)::BIGINT AS customer_messages, sum(b)::BIGINT AS brand_messages, min(first) AS start_time, max(last) AS end_time FROM t""")
def corpus_manifest(spark: SparkSession, d: str) -> DataFrame:
    nested = threads.timed(threads.nested(messages(spark, d)))
    return nested.agg(F.count("*").alias("threads"), F.sum("message_count").alias("messages"), F.sum("customer_messages").alias("customer_messages"), F.sum("brand_messages").alias("brand_messages"), F.min(F.col("turns")[0]["turn"]).alias("start_time"), F.max(F.element_at("turns", -1)["turn"]).alias("end_time"))


@query("last_turns", f"WITH {MSGS} SELECT conv_id, sha256(string_agg(text, ' | ' ORDER BY turn)) AS context_hash, count(*) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM m WHERE conv_id IN (SELECT conv_id FROM m GROUP BY 1 HAVING count(*) FILTER (inbound) > 0 AND count(*) FILTER (NOT inbound) > 0)) WHERE rn <= 6 GROUP BY 1")
def last_turns(spark: SparkSession, d: str) -> DataFrame:
    last = F.reverse(F.slice(F.reverse("turns"), 1, 6))
    return threads.nested(messages(spark, d)).select("conv_id", F.sha2(F.array_join(F.transform(last, lambda t: t["text"]), " | "), 256).alias("context_hash"), F.size(last).cast("bigint").alias("turns"))


@query("review_pack", f"WITH {MSGS} SELECT conv_id, sha256(string_agg('[' || turn || '] ' || coalesce(author, 'unknown') || ': ' || text, chr(10) ORDER BY turn)) AS pack_hash FROM m GROUP BY 1")
def review_pack(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.coalesce("author", F.lit("unknown")), F.lit(": "), "text")
    lines = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return messages(spark, d).groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256).alias("pack_hash"))


@query("public_replies", f"WITH {MSGS}, r AS (SELECT message_id, {NORM.format('text')} AS norm FROM m WHERE NOT inbound) SELECT message_id, {WORDS.format('norm')} >= 8 AND NOT (contains(norm, '@') OR contains(norm, 'nicht')) AS usable, contains(norm, 'tion') OR contains(norm, 'ung') AS risky FROM r")
def public_replies(spark: SparkSession, d: str) -> DataFrame:
    replies = messages(spark, d).where(~F.col("inbound"))
    return replies.select("message_id", gates.usable_reply(F.col("text"), 8, ["@", "nicht"]).alias("usable"), gates.has_risk(F.col("text"), ["tion", "ung"]).alias("risky"))


_SENT = "list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_TOKS = "list_distinct(regexp_extract_all(lower({}), '[a-z][a-z'']+'))"
_HAS = lambda c, terms: "(" + " OR ".join(f"contains({c}, '{t.replace(chr(39), chr(39) * 2)}')" for t in terms) + ")"
_CONTENT = f"list_filter({_TOKS}, lambda w: length(w) > 2 AND NOT list_contains([{', '.join(repr(w) for w in tx.STOP_WORDS)}], w))"
#: Replies and customers for the answer rules: what customers say with question marks, and words that the rules know.
_ASKED = f"""a AS (SELECT message_id, text AS customer, 'Which ' || CASE turn % 4 WHEN 0 THEN 'device' WHEN 1 THEN 'app version' WHEN 2 THEN 'error message' ELSE 'album' END || ' do you have? ' || CASE WHEN turn % 3 = 0 THEN 'Tell us more?' WHEN turn % 3 = 1 THEN 'Try again.' ELSE '' END AS reply,
 text || CASE turn % 2 WHEN 0 THEN ' my iphone shows no error' ELSE '' END AS said FROM m)"""
_KNOWN = " OR ".join(f"({_HAS('lower(x)', ask)} AND {_HAS('lower(said)', known)})" for ask, known in tx.KNOWN_CONTEXT)


@query("answer_coverage", f"""WITH {MSGS}, {_ASKED}, s AS (SELECT *, {_SENT.format('reply')} AS ss FROM a), u AS (SELECT message_id, len(ss) AS n, len(list_filter(ss, lambda x: suffix(x, '?'))) AS asks, len(list_filter(ss, lambda x: {_KNOWN})) AS known, len(list_filter(ss, lambda x: {_HAS('lower(x)', tx.GENERIC_QUESTIONS)})) AS generic, len({_CONTENT.format('said')}) AS c FROM s)
 SELECT message_id, n > 0 AND asks = n AS question_only, n > 0 AND asks = n AND (known > 0 OR (c >= 4 AND generic = n)) AS failure, c::BIGINT AS content_tokens FROM u""")
def answer_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    what = F.when(t % 4 == 0, "device").when(t % 4 == 1, "app version").when(t % 4 == 2, "error message").otherwise("album")
    reply = F.concat(F.lit("Which "), what, F.lit(" do you have? "), F.when(t % 3 == 0, "Tell us more?").when(t % 3 == 1, "Try again.").otherwise(""))
    said = F.concat("text", F.when(t % 2 == 0, " my iphone shows no error").otherwise(""))
    rows = messages(spark, d).select("message_id", reply.alias("reply"), said.alias("said"))
    return rows.select("message_id", tx.question_only(F.col("reply")).alias("question_only"), tx.coverage_failure(F.col("reply"), F.col("said")).alias("failure"), F.size(tx.content_tokens(F.col("said"))).cast("bigint").alias("content_tokens"))


#: Some texts hold the bars that divide a context, and some a backslash.
_SAID = "text || CASE turn % 5 WHEN 1 THEN ' || BRAND: no' WHEN 2 THEN ' | \\| x' ELSE '' END"


@query("customer_texts", f"""WITH x AS (SELECT conv_id * 1000 + turn AS message_id, turn % 3 = 0 AS other, {_SAID} AS message FROM conversations)
 SELECT message_id, sha256(CASE WHEN other THEN message ELSE message || ' again again' END) AS only_hash, CASE WHEN NOT other AND message <> 'again' THEN 'again' ELSE '' END AS beyond FROM x""")
def customer_texts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a context are escaped where it is made, so that none is taken apart by what somebody wrote."""
    message = F.concat("text", F.when(F.col("turn") % 5 == 1, " || BRAND: no").when(F.col("turn") % 5 == 2, " | \\| x").otherwise(""))
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "turn", message.alias("message"))
    parts = F.array(F.concat(F.lit("CUSTOMER: "), "message"), *map(F.lit, ("BRAND: ok", "CUSTOMER: again", "CUSTOMER: again")))
    rows = rows.withColumn("context", F.when(F.col("turn") % 3 == 0, "BRAND: hello").otherwise(tx.joined_context(parts)))
    return rows.select("message_id", F.sha2(tx.customer_only(F.col("context"), F.col("message")), 256).alias("only_hash"), F.array_join(tx.customer_context(F.col("context"), F.col("message")), "|").alias("beyond"))


MARKERS = {"unsupported_action": ["we have refunded", "tionre"], "private_inspection": ["your account shows"], "payment_promise": ["credited", "ungver"], "policy_claim": ["our policy", "nicht die"]}
BLOCKED = ["nicht", "leau"]
ALLOWED = ["tion", "ment", "ung"]
_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, 'https?://\\S+|www\\.\\S+|<(?:url|email|mention|number)>', ' ', 'g'), '@[A-Za-z0-9_]+', ' ', 'g'), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z]{{2,}}', ' ', 'g'), '\\b[0-9]{{7,}}\\b', ' ', 'g'), '(^|\\s)/[A-Z]{{1,3}}(\\s|$|[.!?])', '\\1\\2', 'g'), '\\s+', ' ', 'g'), '\\s+([,.!?])', '\\1', 'g'), ' -')"
_REPLY = f"""c AS (SELECT message_id, text, {_CLEAN.format('text')} AS clean FROM m WHERE NOT inbound), u AS (SELECT message_id, text, list_filter(list_transform({_SENT.format('clean')}, lambda x: trim(regexp_replace(x, '^(?:hey|hi|hello)(?: there)?[,.!]*\\s*', '', 'i'))), lambda x: len(regexp_extract_all(x, '[A-Za-z][A-Za-z'']+')) >= 4 AND NOT {_HAS('lower(x)', BLOCKED)}
 AND NOT suffix(x, ':') AND NOT (contains(lower(x), ' at ') AND NOT suffix(x, '?')) AND (suffix(x, '?') OR {_HAS('lower(x)', ALLOWED)})) AS ss FROM c), g AS (SELECT message_id, text, rtrim(substr(array_to_string(ss[1:2], ' '), 1, 420)) AS reply FROM u)"""
_COVER = f"CASE WHEN len({_TOKS.format('reply')}) = 0 THEN 0.0 ELSE len(list_intersect({_TOKS.format('reply')}, {_TOKS.format('text')})) / len({_TOKS.format('reply')}) END"
_CODES = f"""list_filter([CASE WHEN regexp_matches(reply, '(?i)@[a-z0-9_]+|https?://|www\\.|[a-z0-9_.+-]+@[a-z0-9_.-]+\\.[a-z]{{2,}}|\\b[0-9]{{7,}}\\b|(?:^|\\s)/[a-z]{{1,3}}\\b') THEN 'PII_LEAK' END, {', '.join(f"CASE WHEN {_HAS('lower(reply)', MARKERS[k])} THEN '{v}' END" for k, v in gates.MARKER_CODES.items())},
 CASE WHEN trim(reply) = '' THEN 'MISSING_EVIDENCE' END, CASE WHEN cover < 0.8 THEN 'GROUNDING_FAILURE' END], lambda x: x IS NOT NULL)"""


@query("verified_reply", f"WITH {MSGS}, {_REPLY}, v AS (SELECT *, {_COVER} AS cover FROM g) SELECT message_id, sha256(reply) AS reply_hash, array_to_string({_CODES}, '|') AS codes, round(cover, 6) AS coverage FROM v")
def verified_reply(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d).where(~F.col("inbound")).select("message_id", "text", gates.compose(F.col("text"), BLOCKED, ALLOWED).alias("reply"))
    cases = F.array(F.struct(F.lit("own").alias("id"), F.col("text").alias("reply")))
    checked = m.withColumn("check", gates.verify(F.col("reply"), cases, F.array(F.lit("own")), F.lit(""), MARKERS))
    return checked.select("message_id", F.sha2("reply", 256).alias("reply_hash"), F.array_join("check.codes", "|").alias("codes"), F.col("check.coverage").alias("coverage"))


@query("covering_reply", None)
def covering_reply(spark: SparkSession, d: str) -> DataFrame:
    """For every thread a reply from its first two brand messages that covers what the customer said."""
    nested = threads.nested(messages(spark, d))
    cases = F.transform(F.filter("turns", lambda t: ~t["inbound"]), lambda t: F.struct(t["message_id"].cast("string").alias("id"), t["text"].alias("reply")))
    rows = nested.select("conv_id", cases.alias("cases"), threads.role_text(F.col("turns"), True).alias("customer"))
    built = rows.withColumn("own", gates.compose_covering(F.col("cases"), F.col("customer"), BLOCKED, ALLOWED))
    check = gates.verify(F.col("own.reply"), F.col("cases"), F.col("own.evidence_ids"), F.col("customer"), MARKERS, referenced_only=True, check_answer=True)
    return built.select("conv_id", "own.reply", F.array_join("own.evidence_ids", "|").alias("evidence"), F.array_join(check["codes"], "|").alias("codes"))
