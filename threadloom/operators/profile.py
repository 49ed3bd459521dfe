"""Support profiles of brands, audit signals and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx


def reply_flags(text: Column, actionable: list[str], generic: list[str], least_words: int = 8) -> dict[str, Column]:
    """Substantive, actionable, generic and contained, by substrings and length."""
    acts = tx.any_contains(text, actionable)
    bland = tx.any_contains(text, generic) & ~acts & ~F.contains(text, F.lit("?"))
    long = tx.word_count(text) >= least_words
    return {"substantive": long, "actionable": acts, "generic": bland, "contained": long & ~bland}


def profile(messages: DataFrame, brand: str, text: str, actionable: list[str], generic: list[str], least: int = 1, top: int = 5) -> DataFrame:
    """One row a brand over its messages: volume, median words, shares of reply kinds, duplicates and template concentration."""
    norm = tx.normalized_reply(F.col(text))
    flags = reply_flags(F.col("norm"), actionable, generic)
    rows = messages.select(F.col(brand).alias("brand"), norm.alias("norm")).withColumn("words", tx.word_count(F.col("norm"))).withColumns(flags)
    per_text = rows.groupBy("brand", "norm").agg(F.count("*").alias("n"))
    # The largest of each salted part first, so that no task sorts all replies of a brand.
    salted = per_text.select("brand", "n", F.pmod(F.xxhash64("norm"), F.lit(64)).alias("salt"))
    largest = lambda rows, *by: rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n")))).where(F.col("rn") <= top)
    head = largest(largest(salted, "brand", "salt"), "brand").groupBy("brand").agg(F.sum("n").alias("top_n"))
    head = head.join(per_text.groupBy("brand").agg(F.count("*").alias("distinct_replies")), "brand")
    main = rows.groupBy("brand").agg(
        F.count("*").alias("messages"),
        F.percentile("words", 0.5).alias("median_words"),
        *(F.count_if(f).alias(f"n_{f}") for f in flags),
    )
    share = lambda c: F.round(tx.ratio(F.col(c), F.col("messages")), 8)
    return main.where(F.col("messages") >= least).join(head, "brand").select(
        "brand", "messages", "median_words", *(share(f"n_{f}").alias(f"{f}_share") for f in flags),
        share("distinct_replies").alias("unique_ratio"), F.round(1 - tx.ratio(F.col("distinct_replies"), F.col("messages")), 8).alias("duplicate_rate"), share("top_n").alias("top_template_share"),
    )


def thread_profile(messages: DataFrame, pairs: DataFrame, brand: str = "brand") -> DataFrame:
    """One row a brand on its threads, from messages with root and thread_size (``threads.with_roots``) and linked pairs (brand,
    customer_message): linked customers and pairs, threads, threads of three messages or more, how complete its links to parents
    are, and how varied its customers' messages are."""
    out = messages.where(~F.col("inbound"))
    ids = messages.select(F.col("message_id").alias("_p"), F.lit(True).alias("present"))
    mine = out.join(ids, out["parent_id"] == ids["_p"], "left").groupBy(brand).agg(
        F.count("*").alias("messages"),
        F.count_distinct("root").alias("threads"),
        F.count_distinct(F.when(F.col("thread_size") >= 3, F.col("root"))).alias("multi_turn_threads"),
        F.count_if("present").alias("linked"),
        F.count_if(F.col("parent_id").isNotNull() & F.col("present").isNull()).alias("orphaned"),
    )
    said = messages.select(F.col("message_id").alias("customer_message"), F.sha2(tx.normalized_reply(F.col("text")), 256).alias("norm"))
    asked = pairs.join(said, "customer_message").groupBy(brand).agg(F.count("*").alias("pairs"), F.count_distinct("customer_message").alias("customers"), F.count_distinct("norm").alias("different"))
    share = lambda a, b: F.round(tx.ratio(F.col(a), F.col(b)), 8)
    return mine.join(asked, brand, "left").fillna(0, ["pairs", "customers", "different"]).select(
        brand, "customers", "pairs", "threads", "multi_turn_threads", share("linked", "messages").alias("parent_completeness"),
        share("orphaned", "messages").alias("orphan_rate"), share("different", "customers").alias("customer_diversity"),
    )


def top_templates(messages: DataFrame, brand: str, text: str) -> DataFrame:
    """The most frequent normalised reply of each brand, and how often; ties by text."""
    counts = messages.groupBy(brand, tx.normalized_reply(F.col(text)).alias("template")).agg(F.count("*").alias("n"))
    return counts.groupBy(brand).agg(F.min(F.struct((-F.col("n")).alias("less"), "template")).alias("best")).select(brand, F.col("best.template").alias("template"), (-F.col("best.less")).alias("n"))


def volume_floor(messages: DataFrame, brand: str, least: int) -> DataFrame:
    return messages.groupBy(brand).agg(F.count("*").alias("messages")).where(F.col("messages") >= least)


def extreme(profiles: DataFrame, metric: str, name: str = "brand") -> DataFrame:
    """The brands with the highest and the lowest value; ties by name."""
    first = lambda c: F.min(F.struct(c.alias("v"), F.col(name).alias("name")))["name"]
    return profiles.agg(first(-F.col(metric)).alias("highest"), first(F.col(metric)).alias("lowest"))


def ordinal(rows: DataFrame, group: str, level: str) -> DataFrame:
    """The mean of manual levels: HIGH 1, MEDIUM one half, LOW 0; one half where there are none."""
    value = F.when(F.col(level) == "HIGH", 1.0).when(F.col(level) == "MEDIUM", 0.5).when(F.col(level) == "LOW", 0.0)
    return rows.groupBy(group).agg(F.round(F.coalesce(F.avg(value), F.lit(0.5)), 8).alias("value"))


def select_best(profiles: DataFrame, priority: list[str], name: str = "brand") -> DataFrame:
    """The row that comes first by the metrics in order, larger first and missing last, then by name."""
    return profiles.orderBy(*(F.desc_nulls_last(c) for c in priority), F.lower(name), name).limit(1)


def weighted(profiles: DataFrame, weights: dict[str, dict[str, float]], name: str = "brand") -> DataFrame:
    """For every set of weights (each summing to 1) the best brand and its score."""
    for own in weights.values():
        if abs(sum(own.values()) - 1) > 1e-9:
            raise ValueError("weights must sum to 1")
    scored = profiles.select(name, F.explode(F.array(*(F.struct(F.lit(s).alias("weight_set"), F.round(sum(F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in own.items()), 8).alias("score")) for s, own in weights.items()))).alias("s"))
    best = Window.partitionBy("weight_set").orderBy(F.desc("score"), F.lower(name), name)
    return scored.select(name, "s.*").withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def entropy(counts: DataFrame, group: str, count: str) -> DataFrame:
    """Shannon entropy of the counts of each group, as a share of the most it could be; 0 for a single key."""
    total = counts.groupBy(group).agg(F.sum(count).alias("total"))
    p = F.col(count) / F.col("total")
    return counts.join(total, group).groupBy(group).agg(F.count("*").alias("keys"), F.round(F.when(F.count("*") <= 1, 0.0).otherwise(-F.sum(p * F.log(p)) / F.log(F.count("*"))), 6).alias("entropy"))


def token_counts(docs: DataFrame, group: str, text: str) -> DataFrame:
    return docs.select(F.col(group), F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))).alias("token")).groupBy(group, "token").agg(F.count("*").alias("n"))


def saturated(value: Column, full: float) -> Column:
    return F.least(F.coalesce(value, F.lit(0.0)) / full, F.lit(1.0))


def risk_surface(docs: DataFrame, group: str, text: str, terms: list[str]) -> DataFrame:
    """group, entropy of its tokens, and the share of its texts with any risky term."""
    lexical = entropy(token_counts(docs, group, text), group, "n").select(group, "entropy")
    risky = docs.groupBy(group).agg(F.round(tx.ratio(F.count_if(tx.any_contains(F.lower(text), terms)), F.count("*")), 8).alias("risk_share"))
    return risky.join(lexical, group)
