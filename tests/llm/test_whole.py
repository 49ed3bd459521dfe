"""Queries over whole tables, against brute force on small data directories."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import langid, quality_rules


def say(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))


def test_every_good_label_is_trusted(spark):
    """Where all documents are labelled 1, both multinomials are the same, so that every ratio is 0; 5,200 is more than the former limit."""
    docs = spark.range(5200).selectExpr("id AS doc_id", "concat('word', id, ' and ', id % 7) AS text")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    scored = quality_rules.apply_rules(docs, labels.unionAll(labels.where("doc_id < 9")), buckets=1 << 10)
    assert [tuple(r) for r in scored.select("score").distinct().collect()] == [(0.0,)]


def test_every_labelled_language_is_learned(spark):
    """A rare language among many rows without a label, a frequent one, and one that has only a long text."""
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'lorem ipsum dolor' AS text", "CASE WHEN id % 2 = 0 THEN 'la' END AS lang")
    rare = spark.createDataFrame([(k, t, lang) for k in range(20_000, 20_010) for t, lang in [("ein kleines Haus", "de"), ("une petite maison " * 1200, "fr")]], rows.schema)
    model = langid.train(rows.unionAll(rare), sample_rows=20)
    assert model.languages == ["de", "fr", "la"]
    only = langid.train(rows.select("doc_id", "text", F.when(F.col("doc_id") == 4, "la").alias("lang")).where("doc_id <> 0"), sample_rows=20)
    assert only.languages == ["la"]


def test_pipeline_judges_each_row_by_its_own_text(spark, tmp_path):
    rng = random.Random(3)
    item, clean = say(rng, 40), say(rng, 40)
    docs = spark.createDataFrame([(1, clean, "en", "s", 7), (1, "x " + item, "en", "s", 8), (None, item, "en", "s", 9), (None, clean, "de", "t", None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {(1, clean, "en", "s", 7), (None, clean, "de", "t", None)}
