"""Evaluation metrics and statistics as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.durable import written
from threadloom.functions.text import ratio
from threadloom.operators.contracts import digest_tree


def confusion(rows: DataFrame, labels: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """gold, pred, n for every pair of labels, zeros included. A row with any other label, or none, is an error."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], f"{gold} string")
    grid = names.join(names.select(F.col(gold).alias(pred)), how="cross")  # labels x labels: a handful of rows
    listed = lambda c: F.when(F.col(c).isin(labels), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {c} label: "), F.coalesce(F.col(c), F.lit("null"))))).alias(c)
    return grid.join(rows.groupBy(gold, pred).agg(F.count("*").alias("n")).select(listed(gold), listed(pred), "n"), [gold, pred], "left").fillna(0, ["n"])


def class_metrics(cells: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """label, support, precision, recall, f1 from confusion cells."""
    by_gold = cells.groupBy(F.col(gold).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0)).alias("hit"))
    by_pred = cells.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("predicted"))
    p, r = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
    return by_gold.join(by_pred, "label").select("label", "support", F.round(p, 8).alias("precision"), F.round(r, 8).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 8).alias("f1"))


def overall(classes: DataFrame, cells: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """accuracy, macro_f1 over all labels, weighted_f1."""
    acc = cells.agg(F.round(ratio(F.sum(F.when(F.col(gold) == F.col(pred), F.col("n")).otherwise(0)), F.sum("n")), 8).alias("accuracy"))
    f1 = classes.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 6).alias("weighted_f1"))
    return acc.join(F.broadcast(f1))


def action_metrics(rows: DataFrame, gold: Column, pred: Column) -> DataFrame:
    """Escalation as the positive class; ``gold`` and ``pred`` are true for escalate. A row without one of them is an error."""
    there = lambda c, name: F.coalesce(c, F.raise_error(F.lit(f"a row has no {name} action")).cast("boolean"))
    r = rows.select(there(gold, "gold").alias("g"), there(pred, "predicted").alias("p"))
    c = r.agg(F.count("*").alias("n"), F.count_if(F.expr("g and p")).alias("tp"), F.count_if(F.expr("not g and p")).alias("fp"), F.count_if(F.expr("g and not p")).alias("fn"), F.count_if(F.expr("not g and not p")).alias("tn"))
    x = lambda a, b: F.round(ratio(a, b), 8)
    tp, fp, fn, tn, n = (F.col(k) for k in ("tp", "fp", "fn", "tn", "n"))
    return c.select("n", "tp", "fp", "fn", "tn", x(tp, tp + fp).alias("precision"), x(tp, tp + fn).alias("recall"), x(2 * tp, 2 * tp + fp + fn).alias("f1"), x(fp, fp + tn).alias("false_escalation"), x(fn, tp + fn).alias("missed_escalation"), x(fn, fn + tn).alias("unsafe_auto"), x(fn + tn, n).alias("coverage"))


def quantiles(rows: DataFrame, columns: list[str], at: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """column, quantile, value: linear between neighbours, to six places."""
    vector = lambda c: F.percentile(c, F.array(*map(F.lit, at)))
    wide = rows.agg(*(vector(c).alias(c) for c in columns))
    long = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns))).alias("x")
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, at)).alias("quantile"), F.col("x.values").alias("value"))).alias("y")
    return wide.select(long).select("x.column", each).select("column", "y.quantile", F.round("y.value", 6).alias("value"))


def recall_mrr(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Mean recall at k and mean reciprocal rank over queries with relevant items. ``ranked`` has query, item, rank; ``relevant`` query, item."""
    sizes = relevant.groupBy("query").agg(F.count("*").alias("size"))
    hits = ranked.join(relevant, ["query", "item"]).groupBy("query").agg(F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"))
    joined = sizes.join(hits, "query", "left").fillna(0, ["found"])
    return joined.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("found") / F.col("size")), 8).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 8).alias("mrr"))


def calibration(rows: DataFrame, correct: Column, confidence: Column, bins: int) -> DataFrame:
    """Expected calibration error and Brier score."""
    r = rows.select(correct.cast("double").alias("y"), confidence.alias("c"))
    place = F.least(F.floor(F.col("c") * bins), F.lit(bins - 1))
    b = r.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("c").alias("c"), F.sum(F.pow(F.col("y") - F.col("c"), F.lit(2.0))).alias("s"))
    return b.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("y") - F.col("c"))) / F.sum("n"), 8).alias("ece"), F.round(F.sum("s") / F.sum("n"), 8).alias("brier"))


def agreement(rows: DataFrame, a: str, b: str, weights: str = "quadratic", most_labels: int = 1000) -> DataFrame:
    """n, exact, within_one, weighted kappa (weights by position among the observed labels) and Spearman's rho with average ranks.

    Ratings have few labels, which is what is broadcast: more than ``most_labels`` are an error.
    """
    power = {"linear": 1, "quadratic": 2}[weights]
    pairs = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    pairs = written(pairs)
    seen = written(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct())
    if seen.count() > most_labels:
        raise ValueError(f"more than {most_labels} different ratings")
    seen = written(seen.withColumn("pos", F.row_number().over(Window.orderBy("v"))))  # at most most_labels rows
    cells = pairs.join(F.broadcast(seen.select(F.col("v").alias("a"), F.col("pos").alias("pa"))), "a").join(F.broadcast(seen.select(F.col("v").alias("b"), F.col("pos").alias("pb"))), "b")
    base = cells.agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n"), 8).alias("exact"), F.round(F.sum(F.when(F.abs(F.col("a") - F.col("b")) <= 1, F.col("n")).otherwise(0)) / F.sum("n"), 8).alias("within_one"), F.sum(F.col("n") * F.pow(F.abs(F.col("pa") - F.col("pb")), F.lit(power))).alias("seen"))
    ma, mb = cells.groupBy("pa").agg(F.sum("n").alias("na")), cells.groupBy("pb").agg(F.sum("n").alias("nb"))
    due = ma.join(F.broadcast(mb)).agg(F.sum(F.col("na") * F.col("nb") * F.pow(F.abs(F.col("pa") - F.col("pb")), F.lit(power))).alias("due"))  # labels x labels
    kappa = F.when(F.col("due") == 0, 1.0).otherwise(F.round(1 - F.col("seen") * F.col("n") / F.col("due"), 8))
    ranks = lambda m, p, n: m.select(p, (F.sum(n).over(Window.orderBy(p)) - (F.col(n) - 1) / 2.0).alias(f"r{p}"))
    ranked = cells.join(F.broadcast(ranks(ma, "pa", "na")), "pa").join(F.broadcast(ranks(mb, "pb", "nb")), "pb")
    s = ranked.agg(*(F.sum(F.col("n") * e).alias(k) for k, e in {"sx": F.col("rpa"), "sy": F.col("rpb"), "xx": F.col("rpa") * F.col("rpa"), "yy": F.col("rpb") * F.col("rpb"), "xy": F.col("rpa") * F.col("rpb"), "w": F.lit(1.0)}.items()))
    var = (F.col("w") * F.col("xx") - F.col("sx") * F.col("sx")) * (F.col("w") * F.col("yy") - F.col("sy") * F.col("sy"))
    rho = F.when(var <= 0, 0.0).otherwise(F.round((F.col("w") * F.col("xy") - F.col("sx") * F.col("sy")) / F.sqrt(var), 8))
    return base.join(F.broadcast(due)).join(F.broadcast(s)).select("n", "exact", "within_one", kappa.alias("kappa"), rho.alias("spearman"))


def order_bias(rows: DataFrame) -> DataFrame:
    """Flip rate and position shares of pairwise preferences asked in both orders. ``rows`` has first and second, each A, B or TIE by position."""
    mirrored = F.when(F.col("second") == "A", "B").when(F.col("second") == "B", "A").otherwise("TIE")
    return rows.agg(F.count("*").alias("n"), F.round(ratio(F.count_if(F.col("first") != mirrored), F.count("*")), 8).alias("flip_rate"), F.round(ratio(F.count_if(F.col("first") == "A") + F.count_if(F.col("second") == "A"), 2 * F.count("*")), 8).alias("first_position_share"))


#: A Poisson(1) number is how many of these bounds a 32-bit hash reaches: the distribution function times 2^32. Twelve are all that 32 bits tell apart.
POISSON = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(12)]


def multiplicities(rows: DataFrame, key: Column, seed: str, samples: int) -> DataFrame:
    """``rows`` with rep (0 to samples - 1) and times: how often each replicate draws the row, Poisson(1) by a hash of the seed, the key and
    the replicate. Draws of rows do not depend on each other, so nothing is numbered or joined; replicates without a row in them do not come."""
    block = F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // 8))).alias("block")
    hashed = rows.select("*", key.cast("string").alias("_key"), block).withColumn("_hash", tx.hash_rank(seed, F.col("_key"), F.col("block")))
    each = hashed.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_at")).withColumn("rep", F.col("block") * 8 + F.col("_at")).where(F.col("rep") < samples)
    number = F.conv(F.substr("_hash", 1 + 8 * F.col("_at"), F.lit(8)), 16, 10).cast("bigint")
    times = sum((number >= bound).cast("int") for bound in POISSON)
    return each.withColumn("times", times).where("times > 0").drop("_key", "_hash", "_at", "block")


def bootstrap_of(rows: DataFrame, key: Column, seed: str, samples: int, sums: dict[str, Column], statistics: dict[str, Column], level: float = 0.95) -> DataFrame:
    """statistic, estimate, low, high: percentile intervals of statistics of sums.

    ``sums`` are numbers of a row by name; ``statistics`` are expressions of their totals. Each replicate weighs rows by ``multiplicities``,
    and totals are added up where the rows are, so that a task sends on one row a replicate and nothing grows with rows times replicates.
    An empty table is an error.
    """
    values = rows.select(key.alias("_row"), *(F.coalesce(s.cast("double"), F.lit(0.0)).alias(n) for n, s in sums.items()))
    drawn = multiplicities(values, F.col("_row"), seed, samples).groupBy("rep").agg(*(F.sum(F.col("times") * F.col(n)).alias(n) for n in sums))
    whole = values.agg(F.count("*").alias("_n"), *(F.sum(n).alias(n) for n in sums))
    whole = whole.select(F.when(F.col("_n") > 0, F.lit(-1)).otherwise(F.raise_error(F.lit("there are no values"))).alias("rep"), *sums)
    long = F.explode(F.array(*(F.struct(F.lit(n).alias("statistic"), F.round(s.cast("double"), 10).alias("x")) for n, s in statistics.items()))).alias("s")
    both = whole.unionByName(drawn.withColumn("rep", F.col("rep").cast("int"))).select("rep", long).select("rep", "s.*")
    own, tail = F.when(F.col("rep") >= 0, F.col("x")), (1 - level) / 2
    ends = [F.round(F.percentile(own, q), 8).alias(n) for n, q in (("low", tail), ("high", 1 - tail))]
    return both.groupBy("statistic").agg(F.round(F.max(F.when(F.col("rep") < 0, F.col("x"))), 8).alias("estimate"), *ends)


def label_sums(labels: list[str], gold: str = "gold", pred: str = "pred") -> dict[str, Column]:
    """What ``label_statistics`` adds up over rows."""
    g, p = F.col(gold), F.col(pred)
    out = {"n": F.lit(1), "right": g == p}
    for x in labels:
        out |= {f"{x}_hit": (g == x) & (p == x), f"{x}_support": g == x, f"{x}_said": p == x}
    return out


def label_statistics(labels: list[str]) -> dict[str, Column]:
    """Accuracy, macro F1 over all labels, and each label's precision, recall and F1, of the totals of ``label_sums``."""
    out = {"accuracy": ratio(F.col("right"), F.col("n"))}
    f1 = []
    for x in labels:
        hit, support, said = (F.col(f"{x}_{n}") for n in ("hit", "support", "said"))
        f1.append(ratio(2 * hit, support + said))
        out |= {f"{x}_precision": ratio(hit, said), f"{x}_recall": ratio(hit, support), f"{x}_f1": f1[-1]}
    return out | {"macro_f1": sum(f1[1:], f1[0]) / len(labels)}


def correct_and_safe(rows: DataFrame, right: Column, gold_auto: Column, auto: Column, approved: Column) -> DataFrame:
    """numerator, denominator, value: cases handled automatically, rightly so, with the right intent and an approved reply."""
    good = right & gold_auto & auto & F.coalesce(approved, F.lit(False))
    return rows.agg(F.count_if(good).alias("numerator"), F.count("*").alias("denominator"), F.round(ratio(F.count_if(good), F.count("*")), 8).alias("value"))


def slices(rows: DataFrame, by: str, key: str, right: Column, action_right: Column, auto: Column) -> DataFrame:
    """by, n, intent_accuracy, action_accuracy, coverage and a digest of the ids (``contracts.digest_tree``)."""
    share = lambda c: F.round(ratio(F.count_if(c), F.count("*")), 8)
    found = rows.groupBy(by).agg(F.count("*").alias("n"), share(right).alias("intent_accuracy"), share(action_right).alias("action_accuracy"), share(auto).alias("coverage"))
    digests = digest_tree(rows, key, by).select(F.col(by).alias("_by"), F.col("digest").alias("ids_digest"))
    return found.join(digests, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def repeatability(runs: DataFrame, case: str, run: str, score: str, most_runs: int = 10) -> DataFrame:
    """pairs, exact, within_one, kappa: the means over all pairs of runs, each pair aligned by case."""
    names = sorted(r[0] for r in runs.select(run).distinct().limit(most_runs + 1).collect())
    if not 2 <= len(names) <= most_runs:
        raise ValueError(f"there must be 2 to {most_runs} runs")
    found = None
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            side = lambda r, c: runs.where(F.col(run) == r).select(case, F.col(score).alias(c))
            one = agreement(side(x, "x").join(side(y, "y"), case), "x", "y")
            found = one if found is None else found.unionByName(one)
    return found.agg(F.count("*").alias("pairs"), *(F.round(F.avg(c), 8).alias(c) for c in ("exact", "within_one", "kappa")))


def rater_agreement(human: DataFrame, judge: DataFrame, keys: list[str], dimensions: list[str]) -> DataFrame:
    """dimension, n, exact, within_one, kappa, spearman for the cases that both have rated."""
    both = written(human.select(*keys, *(F.col(d).alias(f"h_{d}") for d in dimensions)).join(judge.select(*keys, *(F.col(d).alias(f"j_{d}") for d in dimensions)), keys))
    found = None
    for d in dimensions:
        one = agreement(both, f"h_{d}", f"j_{d}").withColumn("dimension", F.lit(d))
        found = one if found is None else found.unionByName(one)
    return found
