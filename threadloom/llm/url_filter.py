"""URL filtering: listed rules by host and path, and association rules that FP-growth mines from labelled pages.

Listed rules. A rule fits its host and all subdomains where the path starts with the rule's; the longest wins. Every host suffix of a
page meets the rules' hosts, which tell at which lengths they have paths; the prefixes of these lengths meet the rules by equality.
So no page is compared with a host's rules one by one, however many they are.

Mined rules. A URL becomes a set of tokens: host labels by their place from the right, path segments by place, extension, query
parameters, fragment and scheme, digits as ``#``. FP-growth over the labelled pages' tokens and labels gives association rules; those of a
token set to a label stay if support, confidence and lift suffice, and no rule of fewer tokens with the same verdict is as sure. A rule
is indexed by its rarest token. Distinct token sets meet the index by their tokens, and candidates are verified; the surest rule
that fits decides (then the best supported, then the first in order of its text). Mining and matching take all tokens of a page.

Which pages are counted: all labelled ones. FP-growth drops the items below ``support`` before it builds its trees, and holds on the driver those in
a share of ``support`` of the pages: at most the mean number of tokens of a page / support. Rules are a table, and Spark decides by its size how
they are joined.

Cases: null URLs and URLs without ``://`` have an empty host and path and no token, and get the default verdict; pages may repeat, and each is
judged; a page with several labels is blocked if one says so; null ids are judged and never labelled; without labels or rules the default
holds; empty tables give empty results; ids may have any type; columns beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import slim, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The tokens of a URL, without repeats; none if it has no ``://``."""
    digits = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "#")
    filled = lambda c, by: F.filter(F.split(c, by), lambda x: x != "")
    placed = lambda mark, items: F.transform(items, lambda x, i: F.concat(F.lit(mark), (i + 1).cast("string"), F.lit(":"), digits(x)))
    marked = lambda mark, items: F.transform(items, lambda x: F.concat(F.lit(mark), digits(x)))
    one = lambda mark, c: F.when(c != "", F.array(F.concat(F.lit(mark), digits(c)))).otherwise(F.array().cast("array<string>"))
    rest = _rest(url)
    found = F.concat(
        placed("h", F.reverse(filled(host, r"\."))), placed("p", filled(path, "/")), one("ext:", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)),
        marked("q:", filled(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&")), one("f:", F.regexp_extract(rest, "#(.*)$", 1)), one("s:", F.substring_index(url, "://", 1)),
    )
    return F.when(rest.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def parsed(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path and tokens of every row."""
    frame = slim(pages, page_id=page_id, url=url)
    frame = frame.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return frame.select("*", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))


def listed(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule and rule_verdict of every distinct host and path that a rule (host, path, verdict) fits.

    Of equally long rules the first in order of host, path and verdict holds. Rules with a null host or path fit nothing.
    """
    sites = sites.where("host <> ''").select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min("verdict").alias("rule_verdict"))
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))  # distinct lengths of paths
    near = sites.select("host", "path", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
    near = near.select("host", "path", "rule_host", F.explode("lengths").alias("length")).where(F.col("length") <= F.length("path"))
    fits = near.withColumn("rule_path", F.substr("path", F.lit(1), F.col("length"))).join(rules, ["rule_host", "rule_path"])
    rank = F.struct(-(F.length("rule_host") + F.length("rule_path")), "rule_host", "rule_path")
    return fits.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), rank).alias("best")).select("host", "path", "best.*")


def mine(labelled: DataFrame, support: float = 0.01, least: int = 20, confidence: float = 0.6, lift: float = 1.2) -> DataFrame:
    """antecedent, key (its rarest token), verdict, confidence and pages of the rules that labelled pages (tokens, verdict) give.

    A token set must occur on a share of ``support`` of the labelled pages and on ``least`` pages, each with the verdict.
    """
    spark = labelled.sparkSession
    schema = "antecedent array<string>, key string, verdict string, confidence double, pages bigint"
    baskets = labelled.where(F.size("tokens") > 0).select(F.concat("tokens", F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items"))
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), minConfidence=confidence).fit(baskets)
    verdict = F.regexp_extract(F.col("consequent")[0], "^verdict:(.*)$", 1)
    found = model.associationRules.where((verdict != "") & (F.col("lift") >= lift)).where(~F.exists("antecedent", lambda t: t.startswith("verdict:")))
    rules = written(found.select(F.sort_array("antecedent").alias("antecedent"), verdict.alias("verdict"), "confidence", F.round(F.col("support") * n).cast("bigint").alias("pages")))
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    keys = rules.select("antecedent", F.explode("antecedent").alias("token")).join(single, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    rules = written(rules.join(keys, "antecedent").select("antecedent", "key", "verdict", "confidence", "pages"))
    shorter = rules.select("key", F.col("antecedent").alias("shorter"), "verdict", F.col("confidence").alias("as_sure"))
    implied = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("key")).join(shorter, ["key", "verdict"])
    implied = implied.where((F.size("shorter") < F.size("antecedent")) & (F.col("as_sure") >= F.col("confidence")) & (F.size(F.array_except("shorter", "antecedent")) == 0))
    return written(rules.join(implied.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti").select("antecedent", "key", "verdict", "confidence", "pages"))


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens, mined (the rule's tokens), mined_verdict and confidence of every distinct token set that a mined rule fits."""
    sets = token_sets.select("tokens").distinct()
    met = sets.select("tokens", F.explode("tokens").alias("key")).join(rules, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.struct(-F.col("confidence"), -F.col("pages"), F.array_join("antecedent", " "), "verdict")
    return met.groupBy("tokens").agg(F.min_by(F.struct(F.array_join("antecedent", " ").alias("mined"), F.col("verdict").alias("mined_verdict"), "confidence"), best).alias("best")).select("tokens", "best.*")


def judge(pages: DataFrame, rules: DataFrame, labels: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url", **mining: float) -> DataFrame:
    """page_id, host, path, rule, verdict, mined and confidence of every page.

    ``rules`` has host, path and verdict; ``labels`` page_id and verdict (``allow`` or ``block``). A page's label is its listed rule's verdict, else what ``labels`` says.
    The verdict is the listed rule's, else that of the mined rule that fits, else ``default``.
    """
    frame = parsed(pages, page_id, url)
    ruled = written(frame.join(listed(frame, rules), ["host", "path"], "left"))
    known = slim(labels, page_id="page_id", verdict="verdict").where("page_id IS NOT NULL AND verdict IS NOT NULL").groupBy("page_id").agg(F.max("verdict").alias("label"))
    labelled = ruled.join(known, "page_id", "left").select("tokens", F.coalesce("rule_verdict", "label").alias("verdict")).where("verdict IS NOT NULL")
    found = matched(ruled, mine(labelled, **mining))
    judged = ruled.join(found, "tokens", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "mined_verdict", F.lit(default)).alias("verdict"), "mined", "confidence")
