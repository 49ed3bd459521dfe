"""Distributions and their shift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distribution(rows: DataFrame, field: str, by: str) -> DataFrame:
    """by, value, n, rate."""
    n = rows.groupBy(by, F.col(field).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = rows.groupBy(by).agg(F.count("*").alias("total"))
    return n.join(total, by).select(by, "value", "n", F.round(F.col("n") / F.col("total"), 8).alias("rate"))


def shift(left: DataFrame, right: DataFrame) -> DataFrame:
    """value, points: the difference of two distributions (value, rate) in percentage points, over all values; and its level."""
    both = left.select("value", F.col("rate").alias("x")).join(right.select("value", F.col("rate").alias("y")), "value", "full")
    points = F.round(100 * F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))), 6)
    return both.select("value", points.alias("points")).withColumn("level", F.when(F.col("points") < 15, "LOW").when(F.col("points") <= 30, "MODERATE").otherwise("HIGH"))


def variance_by_case(rows: DataFrame, case: str, score: str) -> DataFrame:
    return rows.groupBy(case).agg(F.count("*").alias("runs"), F.round(F.var_pop(score), 8).alias("variance"))


def system_summary(rows: DataFrame, system: str, score: str, passed: Column) -> DataFrame:
    return rows.groupBy(system).agg(F.count("*").alias("n"), F.round(F.avg(score), 8).alias("mean"), F.median(score).alias("median"), F.round(F.count_if(passed) / F.count("*"), 8).alias("pass_rate"))
