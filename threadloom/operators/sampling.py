"""Deterministic samples: hash order, quotas, round robin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx


def quota_sample(rows: DataFrame, group: str, key: str, seed: str, quota: int) -> DataFrame:
    """The first ``quota`` rows of each group in hash order."""
    order = Window.partitionBy(group).orderBy(tx.hash_rank(seed, F.col(key)), key)
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= quota)


def round_robin(rows: DataFrame, group: str, key: str, seed: str, n: int) -> DataFrame:
    """One row of each group in turn, groups in name order and hash order within, until ``n``."""
    order = Window.partitionBy(group).orderBy(tx.hash_rank(seed, F.col(key)), key)
    head = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    return head.orderBy("rn", group).limit(n)


def challenge_flags(text: Column, boundary: Column) -> dict[str, Column]:
    """What makes a message hard: questions, several sentences, digits, few words, a near tie of intents."""
    return {
        "has_question": F.contains(text, F.lit("?")),
        "many_sentences": F.size(F.regexp_extract_all(text, F.lit("[.!?]"), F.lit(0))) >= 3,
        "has_number": text.rlike("[0-9]"),
        "low_context": tx.word_count(text) <= 5,
        "boundary": boundary,
    }


def case_flags(text: Column) -> Column:
    """What makes a case hard to judge, as an array of names: few or many words, several clauses, risky terms, several devices."""
    low = F.lower(text)
    tokens = F.size(F.regexp_extract_all(low, F.lit("[a-z][a-z']+"), F.lit(0)))
    times = lambda pattern: F.size(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)))
    devices = sum((F.contains(low, F.lit(x)).cast("int") for x in ("iphone", "android", "windows", "mac", "speaker")), F.lit(0))
    flags = {
        "VERY_SHORT": tokens <= 5, "UNUSUALLY_LONG": tokens >= 60, "MULTI_CLAUSE": (times(r"\?") >= 2) | (times(" and ") + times(" but ") >= 2),
        "RISK_TERMS": tx.any_contains(low, ["hacked", "password", "charged", "refund", "payment"]), "MULTI_DEVICE": devices >= 2,
    }
    return F.array_compact(F.array(*(F.when(c, n) for n, c in flags.items())))


def rare_lexicon(docs: DataFrame, key: str, text: str, train: DataFrame, mean: float = 3.0) -> DataFrame:
    """key, rare: whether the distinct tokens of a text occur fewer than ``mean`` times on average in the training texts."""
    tokens = lambda rows: rows.select(F.col(key).alias("key"), F.explode(tx.token_set(F.col(text))).alias("token"))
    counts = train.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    means = tokens(docs).join(counts, "token", "left").groupBy("key").agg((F.sum(F.coalesce("n", F.lit(0))) / F.count("*")).alias("mean"))
    return docs.select(F.col(key).alias("key")).join(means, "key", "left").select(F.col("key").alias(key), F.coalesce(F.col("mean") < mean, F.lit(False)).alias("rare"))


def candidates(rows: DataFrame, intent: str, key: str, proxies: Column, seed: str, n_representative: int, n_challenge: int) -> DataFrame:
    """key, kind, candidate_id: representative rows, intents in turn, then of the rest those with most proxies (an array)."""
    first = round_robin(rows, intent, key, seed, n_representative).select(key, F.lit("REPRESENTATIVE").alias("kind"), F.struct("rn", intent).alias("place"))
    rest = rows.join(first.select(key), key, "left_anti").withColumn("size", F.size(proxies)).where(F.col("size") > 0)
    hard = rest.withColumn("rank_hash", tx.hash_rank(seed, F.col(key))).orderBy(F.desc("size"), "rank_hash", key).limit(n_challenge)
    number = lambda df, kind, order: df.select(key, F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind[0]}-"), F.lpad(F.row_number().over(Window.orderBy(*order)).cast("string"), 3, "0")).alias("candidate_id"))
    return number(first, "REPRESENTATIVE", ["place"]).unionByName(number(hard, "CHALLENGE", [F.desc("size"), "rank_hash", key]))  # of the chosen rows alone


def quotas(counts: DataFrame, group: str, n: int) -> DataFrame:
    """Seats by largest remainder, at least one each. ``counts`` has the group and its size, ``size``."""
    total = F.sum("size").over(Window.partitionBy())
    exact = F.col("size") * n / F.col("total")
    floored = counts.withColumn("total", total).withColumn("seats", F.greatest(F.floor(exact), F.lit(1))).withColumn("rest", exact - F.floor(exact))
    left = F.lit(n) - F.sum("seats").over(Window.partitionBy())
    order = F.row_number().over(Window.orderBy(F.desc("rest"), group))
    return floored.withColumn("left", left).withColumn("turn", order).select(group, "size", (F.col("seats") + F.when(F.col("turn") <= F.col("left"), 1).otherwise(0)).cast("bigint").alias("quota"))
