"""The corpus pipeline: language, near-duplicates, contamination, personal data, tokens.

Each stage takes all documents that its predecessor kept and returns those that it keeps, with the columns of documents; the
last returns token ids. Further columns of documents are left behind by the first stage, whatever their names. An empty table
passes every stage as an empty table, and texts of any length are read whole. What each stage does with nulls, repeats and
ties is said at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, decontam, langid, neardup, pii
from threadloom.llm.common import read, written
from threadloom.llm.queries import ranks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Texts go to Python in batches of at most ``rows`` rows and about ``size`` bytes, as executors hold several batches beside
    their heaps: some for each core, in the JVM and in the Python worker. A smaller number of rows that the session has stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(name))
    spark.conf.set(name, rows if own <= 0 else min(own, rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has an identifiable language.

    Null texts, empty texts and texts without a letter go. Each row is judged alone, so repeated rows fare alike, and null ids,
    languages and sources stay as they are. Where no language can be learned, every row goes.
    """
    _small_batches(spark)
    found = langid.identify(docs, langid.train(docs), keep=COLUMNS)
    return found.where(F.col("predicted") != "und").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more): the smallest id.

    Rows that share an id are one document, and stay or go together; of those with the same text as well the first by
    language, source and length stays. Rows with a null id, and null and empty texts, resemble nothing and stay.
    """
    _small_batches(spark)
    found = neardup.near_duplicates(docs, shingle=5, share=80)
    gone = found.where(F.col("doc_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct()
    first = F.min(F.struct("lang", "source", "n_chars")).alias("first")
    with_id = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti").groupBy("doc_id", "text").agg(first)
    return with_id.select("doc_id", "text", "first.*").select(COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of the benchmark. Each row is judged by its own text, whatever its id; null texts have no words
    and stay; with an empty benchmark every row stays."""
    _small_batches(spark)
    found = decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"), keep=["lang", "source", "n_chars"])
    return found.where("n_hit = 0").select(COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data replaced by their kinds, and n_chars as it is then. Null texts stay null."""
    found = pii.detect(docs, keep=["lang", "source"])
    clean = found.select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("text"), "lang", "source")
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of every row; null texts encode as empty ones."""
    _small_batches(spark)
    # Earlier stages have filled the executors' heaps: fewer states and runs leave room beside them.
    return bpe.round_trip(docs, ranks(), most_states=60_000, most_runs=150_000).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("private", private),
    ("tokens", tokens),
]

#: SQL cannot express the stages; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs)
    return docs
