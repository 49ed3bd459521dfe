"""Samples by strata, holdouts, failure cohorts, review items and execution orders. All are deterministic: order is by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx


def stratified(rows: DataFrame, strata: list[Column], key: str, seed: str, n: int) -> DataFrame:
    """``n`` rows, one of each stratum in turn: strata in the order of their names joined by bars, hash order within.

    Only the first ``n`` of each stratum can be chosen, so only these are ordered together.
    """
    named = rows.withColumn("stratum", F.concat_ws("|", *(s.cast("string") for s in strata)))
    order = Window.partitionBy("stratum").orderBy(tx.hash_rank(seed, F.col("stratum"), F.col(key)), key)
    head = named.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    return head.orderBy("rn", "stratum").limit(n).drop("rn")


def development_sample(rows: DataFrame, always: Column, strata: list[Column], key: str, seed: str, n: int) -> DataFrame:
    """All rows that ``always`` marks, and strata in turn up to ``n``; too many of the first are an error."""
    fixed = rows.where(always)
    have = fixed.count()
    if have > n:
        raise ValueError(f"{have} rows must be in the sample, which has {n}")
    return fixed.withColumn("stratum", F.lit("ALWAYS")).unionByName(stratified(rows.where(~always), strata, key, seed, n - have))


def holdout(rows: DataFrame, excluded: DataFrame, changed: Column, strata: list[Column], key: str, seed: str, n_changed: int, n_same: int) -> DataFrame:
    """Eligible rows (those without ``excluded`` keys) by strata: so many that changed, so many that did not."""
    left = rows.join(excluded.select(key).distinct(), key, "left_anti").withColumn("changed", changed)
    own = lambda flag, n, name: stratified(left.where(F.col("changed") == flag), strata, key, f"{seed}:{name}", n)
    return own(True, n_changed, "changed").unionByName(own(False, n_same, "unchanged"))


def cohorts(rows: DataFrame, tests: dict[str, tuple[Column, int]], key: str, seed: str) -> DataFrame:
    """cohort, key, rank: for each named test its first rows in hash order; a row may be in several."""
    named = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(name).alias("cohort"), F.lit(n).alias("most"))) for name, (test, n) in tests.items())))
    long = rows.select(key, F.explode(named).alias("c")).select(key, "c.*")
    order = Window.partitionBy("cohort").orderBy(tx.hash_rank(seed, F.col("cohort"), F.col(key)), key)
    return long.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= F.col("most")).drop("most")


def without_reuse(rows: DataFrame, strata: dict[str, Column], key: str, seed: str, n: int) -> DataFrame:
    """stratum, key: for each stratum in order its first ``n`` rows in hash order that no earlier stratum has taken."""
    taken = None
    for name, test in strata.items():
        free = rows.where(test).select(key)
        if taken is not None:
            free = free.join(taken.select(key), key, "left_anti")
        own = free.withColumn("_h", tx.hash_rank(seed, F.lit(name), F.col(key))).orderBy("_h", key).limit(n).select(F.lit(name).alias("stratum"), key)
        taken = own if taken is None else taken.unionByName(own)
    return taken


def execution_order(key: Column, seed: str, first: str = "original", second: str = "revised") -> tuple[Column, Column]:
    """Which of two systems is shown first, decided by a hash."""
    early = F.substr(tx.hash_rank(seed, key), F.lit(1), F.lit(1)) < "8"
    return F.when(early, first).otherwise(second), F.when(early, second).otherwise(first)


def expanded(cases: DataFrame, systems: list[str]) -> DataFrame:
    """Every case for every system."""
    return cases.withColumn("system", F.explode(F.array(*map(F.lit, systems))))


def carried_over(new: DataFrame, old: DataFrame, key: str, label: str, default: str) -> DataFrame:
    """A new sample with the labels that earlier rows had; others get the default."""
    known = old.select(key, F.col(label).alias("_old")).dropDuplicates([key])
    return new.join(known, key, "left").withColumn(label, F.coalesce("_old", F.lit(default))).drop("_old")


def remapped(rows: DataFrame, mapping: DataFrame, key: str, new_key: str, system: str, renames: dict[str, str]) -> DataFrame:
    """Rows under the ids that a mapping (key, new_key) gives, and systems under new names."""
    table = F.create_map(*(F.lit(x) for pair in renames.items() for x in pair))
    return rows.join(mapping.select(key, new_key), key).withColumn(system, F.coalesce(F.try_element_at(table, F.col(system)), F.col(system))).drop(key)


def excerpts(cases: Column, n: int, chars: int) -> Column:
    """The first n past replies (array of structs with reply), sanitised and clipped."""
    return F.transform(F.slice(cases, 1, n), lambda c: tx.clipped(c["reply"], chars))


def review_items(cases: DataFrame, predictions: DataFrame, key: str, n_evidence: int = 2, chars: int = 200) -> DataFrame:
    """Cases with their prediction, clipped context and evidence, as a person reviews them."""
    joined = cases.join(predictions, key)
    return joined.select(key, "system", "action", tx.clipped(F.col("message"), chars).alias("message"), tx.clipped(F.col("context"), chars).alias("context"), F.array_join(excerpts(F.col("cases"), n_evidence, chars), " || ").alias("evidence"))
