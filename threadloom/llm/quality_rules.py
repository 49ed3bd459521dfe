"""Quality rules in DataFrame functions alone: base counts, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted: one over every document (the raw corpus), one over
trusted documents (every document whose id is labelled as good). A document's score is the mean log ratio of its n-grams; it is kept if no base rule fails and the score
reaches a fixed threshold. The ratios are one array of ``buckets`` doubles, a scalar subquery of the scoring query.

Every count is over whole texts and all documents. Only the semi join of documents and good labels may shuffle texts; it
drops null ids first, and AQE splits its skewed partitions. Three-word windows are compared by 64-bit
hashes within one document.

Cases: null texts have no words and fail the base rules; empty tables give empty results; without trusted documents every
ratio is 0, so that only the base rules decide; repeated rows are counted and scored row by row; null ids are scored, and
never trusted; ids may have any type; texts of any length are counted whole; a score at the threshold is kept; columns beside
the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import slim
from threadloom.llm.spans import let

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space."""
    return F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")


def repeated_words(tokens: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(tokens) - 3), lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)))

    def covered(ordered: Column) -> Column:
        same = lambda e, k: F.get(ordered, k)["h"] == e["h"]
        twice = F.filter(ordered, lambda e, k: F.coalesce(same(e, k - 1), F.lit(False)) | F.coalesce(same(e, k + 1), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.sequence(e["i"], e["i"] + 2)))))

    def of(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
            let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)
        )

    return F.when(F.size(tokens) < 4, 0).otherwise(let(hashes, of)).cast("bigint")


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tokens and the base counts of every row."""
    frame = slim(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    frame = frame.select("doc_id", "text", words(F.col("text")).alias("tokens"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    size = lambda c: F.length(c).cast("bigint")
    return frame.select(
        "doc_id",
        "tokens",
        F.size("tokens").cast("bigint").alias("n_words"),
        size(F.translate("text", _SPACES, "")).alias("word_chars"),
        (size("text") - size(F.translate("text", _SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("tokens")).alias("n_repeat_words"),
    )


def _bucket(buckets: int, *words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int")


def gram_rows(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket of every unigram and bigram of the column ``text``, row by row, so that all of it runs in generated code."""
    tokens = texts.select(words(F.coalesce("text", F.lit(""))).alias("tokens"))
    pairs = tokens.select(F.inline(F.arrays_zip(F.col("tokens").alias("w"), F.slice("tokens", F.lit(2), F.size("tokens")).alias("v"))))
    both = F.array(_bucket(buckets, F.col("w")), F.when(F.col("v").isNotNull(), _bucket(buckets, F.col("w"), F.col("v"))))
    return pairs.select(F.explode(both).alias("bucket")).where(F.col("bucket").isNotNull())


def total_ratio(tokens: Column, ratios: Column, buckets: int) -> Column:
    """The sum of the log ratios of a document's unigrams and bigrams."""
    follows = lambda i: F.get(tokens, i + 1)
    own = F.transform(tokens, lambda w, i: F.get(ratios, _bucket(buckets, w)) + F.when(i < F.size(tokens) - 1, F.get(ratios, _bucket(buckets, w, follows(i)))).otherwise(0.0))
    return F.aggregate(own, F.lit(0.0), lambda a, b: a + b)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row with ``ratios``, an array of log(p trusted / p raw) by bucket. ``trusted`` has ids, ``doc_id``."""
    frame = slim(docs, doc_id=doc_id, text=text)

    # A hash join builds on ids alone and never sorts texts.
    target = frame.join(trusted.hint("shuffle_hash"), "doc_id", "left_semi")
    both = gram_rows(frame, buckets).withColumn("trusted", F.lit(0)).unionAll(gram_rows(target, buckets).withColumn("trusted", F.lit(1)))
    counts = both.groupBy("bucket").agg(F.count_if(F.col("trusted") == 0).alias("raw"), F.sum("trusted").alias("target"))
    spark = docs.sparkSession
    full = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    table = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("t"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"))
    p = lambda count, total: (count + 1) / (total + buckets)
    return table.select(
        F.when(F.col("n_target") == 0, F.transform("t", lambda x: F.lit(0.0)))
        .otherwise(F.transform("t", lambda x: F.log(p(x["target"], F.col("n_target")) / p(x["raw"], F.col("n_raw")))))
        .alias("ratios")
    )


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", good: str = "quality") -> DataFrame:
    """The ids labelled 1."""
    frame = slim(labels, doc_id=doc_id, good=good)
    return frame.where((F.col("good") == 1) & F.col("doc_id").isNotNull()).select("doc_id")


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_words: int = 50,
    most_repeated: int = 50,
    threshold: float = -0.5,
    buckets: int = 1 << 16,
) -> DataFrame:
    """doc_id, base counts, base_failed, score (mean log ratio, 0 without n-grams) and kept of every row."""
    ratios = log_ratios(docs, trusted_ids(labels), buckets, doc_id, text).scalar()
    # The optimizer folds this column into the sum below; it is never written out row by row.
    counted = base_counts(docs, doc_id, text).withColumn("ratios", ratios)
    total = total_ratio(F.col("tokens"), F.col("ratios"), buckets)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    scored = counted.withColumn("score", F.when(F.col("n_words") == 0, 0.0).otherwise(total / (2 * F.col("n_words") - 1)))
    return scored.drop("tokens", "ratios").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
