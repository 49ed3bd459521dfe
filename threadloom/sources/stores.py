"""Sinks, keyed stores, configuration overlays and file digests."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from threadloom.operators.contracts import insert_only, replace_only
from threadloom.sources.exports import SchemaError


def read_threads(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Nested threads from JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_threads(threads: DataFrame, path: str) -> None:
    threads.write.mode("overwrite").json(path)


def write_profiles(profiles: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV with a fixed order of columns. Profiles are a row a brand."""
    profiles.select(columns).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def manifest(rows: DataFrame) -> str:
    """A one-row result as JSON with sorted keys."""
    return json.dumps(rows.first().asDict(recursive=True), sort_keys=True, indent=2, default=str)


def checked_csv(spark: SparkSession, path: str, header: list[str], keys: list[str]) -> DataFrame:
    """A CSV with exactly this header, whose keys are unique each."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if rows.columns != header:
        raise SchemaError(f"the header must be {', '.join(header)}")
    for key in keys:
        if not rows.groupBy(key).count().where("count > 1").isEmpty():
            raise SchemaError(f"{key} must be unique")
    return rows


class KeyedStore:
    """A Parquet table by key, in numbered versions: a version is complete before it becomes the current one."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str) -> None:
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def _log(self) -> DataFrame:
        return self.spark.read.schema("name string").json(f"{self.path}/log")

    def version(self) -> int:
        try:
            return self._log().agg(F.max("version")).first()[0] or 0
        except AnalysisException as error:  # the log begins with the first version
            if error.getCondition() == "PATH_NOT_FOUND":
                return 0
            raise

    def load(self) -> DataFrame:
        now = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self._log().where(F.col('version') == now).first().name}") if now else self.spark.createDataFrame([], self.schema)

    def _put(self, rows: DataFrame) -> None:
        """Writes the rows under a name of their own, then claims the next number; a number that another writer has is an error."""
        new, name = self.version() + 1, uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}")
        try:
            self.spark.createDataFrame([(new, name)], "version bigint, name string").coalesce(1).write.mode("errorifexists").json(f"{self.path}/log/version={new}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_ALREADY_EXISTS":
                raise RuntimeError(f"version {new} of {self.path} has been written meanwhile; load it and try again") from error
            raise

    def save(self, rows: DataFrame) -> None:
        """Adds rows whose key is new; others stay as they are."""
        self._put(insert_only(self.load(), rows, self.key))

    def replace(self, rows: DataFrame) -> None:
        """Overwrites rows whose key is known."""
        self._put(replace_only(self.load(), rows, self.key))

    def progress(self, wanted: DataFrame) -> tuple[int, int]:
        """How many of the wanted keys are stored, and how many there are."""
        return wanted.join(self.load().select(self.key), self.key, "left_semi").count(), wanted.count()


class PairedStore:
    """Two keyed stores whose keys must be the same, such as ratings and the notes on them.

    The second is written first, and ``load`` takes only what both have, so that a writer that stops in between loses nothing
    that was complete.
    """

    def __init__(self, first: KeyedStore, second: KeyedStore) -> None:
        if first.key != second.key:
            raise ValueError("both stores need the same key")
        self.first, self.second = first, second

    def save(self, first: DataFrame, second: DataFrame) -> None:
        key = self.first.key
        left, right = first.select(key), second.select(key)
        if not left.exceptAll(right).isEmpty() or not right.exceptAll(left).isEmpty():
            raise ValueError("both sides must have the same keys")
        self.second.save(second)
        self.first.save(first)

    def load(self) -> DataFrame:
        return self.first.load().join(self.second.load(), self.first.key)


def profiling_config(document: dict) -> dict:
    """A profiling configuration with defaults, checked: counts are positive, term lists are there and lower case, priorities known."""
    own = {"minimum_outbound_messages": 1, "minimum_substantive_words": 8, "top_template_count": 5, "selection_priority": ["contained_share", "messages"]} | document
    problems = [f"{n} must be a positive number" for n in ("minimum_outbound_messages", "minimum_substantive_words", "top_template_count") if not isinstance(own[n], int) or own[n] < 1]
    for name in ("actionable_terms", "generic_terms"):
        terms = own.get(name)
        if not terms or any(t != t.lower() or not t.strip() for t in terms):
            problems.append(f"{name} must be lower-case terms")
    if len(set(own["selection_priority"])) != len(own["selection_priority"]):
        problems.append("selection_priority must not repeat a metric")
    if problems:
        raise ValueError("; ".join(problems))
    return own


def system_manifest(spark: SparkSession, thresholds: dict[str, float], path: str) -> dict:
    """What makes up a system: its thresholds, and the digest of each of its files."""
    return {"thresholds": dict(sorted(thresholds.items())), "files": {r.path.rsplit("/", 1)[-1]: r.sha256 for r in file_digests(spark, path).collect()}}


def overlay(base: dict, own: dict) -> dict:
    """Configuration over its base: dictionaries are merged one level deep."""
    return base | {k: base[k] | v if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in own.items()}


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
