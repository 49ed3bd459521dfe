"""Validation of people's labels before an evaluation: every rule over labels, frozen cases, splits and taxonomy, in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.durable import written

VERSIONS = ("taxonomy_version", "sampling_version", "split_version")


@dataclass(frozen=True)
class Contract:
    """What labels may say, and how many of them and of frozen cases there must be."""

    intents: tuple[str, ...]
    actions: tuple[str, ...]
    difficulties: tuple[str, ...]
    risk_tags: tuple[str, ...]
    taxonomy_version: str
    brand: str
    cases: int
    least: int = 150
    most: int = 250
    source: str = "human"
    status: str = "FINALIZED"
    annotator: str = "candidate"


def _row_rules(contract: Contract) -> dict[str, Column]:
    """Rules that a label breaks (true), in order. Those on its frozen case hold only where it has one."""
    c = F.col
    differs = lambda column, value: ~c(column).eqNullSafe(F.lit(value))
    unlisted = lambda column, values: ~F.coalesce(c(column).isin(*values), F.lit(False))
    tags = F.filter(F.split(F.coalesce("risk_tags", F.lit("")), r"\|"), lambda t: t != "")
    zoned = F.coalesce(c("reviewed_at").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.lit(False)) & c("reviewed_at").try_cast("timestamp").isNotNull()
    has = c("frozen_thread").isNotNull()
    return {
        "NOT_HUMAN": differs("annotation_source", contract.source), "NOT_FINALIZED": differs("status", contract.status), "ANNOTATOR": differs("annotator", contract.annotator), "REVIEWED_AT": ~zoned,
        "INTENT": unlisted("gold_intent", contract.intents), "ACTION": unlisted("gold_action", contract.actions), "DIFFICULTY": unlisted("difficulty", contract.difficulties),
        "REASON": F.trim(F.coalesce("gold_action_reason", F.lit(""))) == "", "RISK_TAGS": F.size(F.array_except(tags, F.array(*map(F.lit, contract.risk_tags)))) > 0,
        "NOT_FROZEN": ~has, "THREAD": has & ~c("thread_id").eqNullSafe(c("frozen_thread")), "PROTECTED": has & c("protected"),
        **{v.upper(): has & ~c(v).eqNullSafe(c(f"frozen_{v}")) for v in VERSIONS}, "TAXONOMY": has & differs("taxonomy_version", contract.taxonomy_version),
    }


def validate(labels: DataFrame, frozen: DataFrame, manifest: DataFrame, protected: DataFrame, contract: Contract, brands: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Errors (place, rule, case_id), each once and in the order of the rules, and one row of status.

    ``labels`` has case_id, thread_id, the label's columns and the versions; ``frozen`` case_id, thread_id and the versions; ``manifest`` the case_ids of
    the frozen set; ``protected`` the thread_ids that no label may have; ``brands`` are those that manifest and taxonomy name. Rules on
    tables have no case_id, except for a case that is labelled twice. status is READY without any error, else BLOCKED.
    """
    cases = frozen.groupBy("case_id").agg(F.min("thread_id").alias("frozen_thread"), *(F.min(v).alias(f"frozen_{v}") for v in VERSIONS))
    barred = protected.select("thread_id").distinct().withColumn("protected", F.lit(True))
    rows = labels.join(cases, "case_id", "left").join(barred, "thread_id", "left").withColumn("protected", F.coalesce("protected", F.lit(False)))
    rules = _row_rules(contract)
    one = lambda k, name, test: F.when(test, F.struct(F.lit(k).alias("place"), F.lit(name).alias("rule")))
    broken = rows.select("case_id", F.explode(F.array_compact(F.array(*(one(k, n, t) for k, (n, t) in enumerate(rules.items(), 6))))).alias("e")).select("e.*", "case_id")
    twice = labels.groupBy("case_id").count().where("count > 1").select(F.lit(4).alias("place"), F.lit("DUPLICATE_CASE").alias("rule"), "case_id")
    sizes = frozen.agg(F.count("*").alias("frozen")).join(F.broadcast(labels.agg(F.count("*").alias("labels"))))  # one row each
    ids = manifest.groupBy("case_id").agg(F.count("*").alias("n"))
    parted = ids.join(cases.select("case_id", F.lit(1).alias("own")), "case_id", "full").agg(F.count_if(F.col("n").isNull() | F.col("own").isNull() | (F.col("n") > 1)).alias("apart"))
    whole = sizes.join(F.broadcast(parted)).withColumn("brand", F.lit(any(b != contract.brand for b in brands)))
    tables = {"CASE_COUNT": F.col("frozen") != contract.cases, "MANIFEST": F.col("apart") > 0, "BRAND": F.col("brand"), "LABEL_COUNT": ~F.col("labels").between(contract.least, contract.most)}
    place = {"CASE_COUNT": 1, "MANIFEST": 2, "BRAND": 3, "LABEL_COUNT": 5}
    general = whole.select(F.explode(F.array_compact(F.array(*(one(place[n], n, t) for n, t in tables.items())))).alias("e")).select("e.*", F.lit(None).cast(labels.schema["case_id"].dataType).alias("case_id"))
    errors = written(general.unionByName(twice).unionByName(broken).distinct())
    found = sizes.join(F.broadcast(errors.agg(F.count("*").alias("errors"))))
    return errors, found.select(F.when(F.col("errors") == 0, "READY").otherwise("BLOCKED").alias("status"), "labels", "frozen", "errors")
