"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import alignment, bpe, chat, langid, neardup, pii, quality_model, quality_rules, secret_scan, spans, substring_dedup, url_filter, whitening
from threadloom.llm.common import read, written
from threadloom.llm.decontam import decontaminate


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of transcripts with absent, wrong and varied markers; n_right lines of n_lines got the role of their turn. The model
    never sees held-out conversations."""
    parts = written(chat.transcripts(read(spark, sf_dir, "conversations")))
    parsed = chat.parse_parts(parts, chat.train(parts.where(~chat.held_out(F.col("conv_id")))))
    truth = F.flatten(F.transform("turns", lambda t: F.array_repeat(t["role"], F.size(F.split(t["text"], "\n")))))
    right = F.zip_with("line_roles", truth, lambda a, b: F.coalesce((a == b).cast("bigint"), F.lit(0).cast("bigint")))
    return parsed.select(
        "conv_id",
        "part",
        chat.held_out(F.col("conv_id")).alias("held_out"),
        F.size("parsed").cast("bigint").alias("n_turns"),
        F.size("line_roles").cast("bigint").alias("n_lines"),
        F.aggregate(right, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("n_right"),
        F.array_join(F.transform("parsed", lambda t: t["role"]), ",").alias("roles"),
        F.sha2(F.encode("rendered", "UTF-8"), 256).alias("rendered_sha256"),
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality_model.score(docs, quality_model.train(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        quality_model.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def _span_digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts of base spans by kind, the hash of the base spans, and all spans, from doc_id and spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in kinds),
        F.sha2(spans.joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.detect(read(spark, sf_dir, "documents")), ["email", "ip", "card", "phone"])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secret_scan.scan(read(spark, sf_dir, "documents")), ["assign", "access", "hex"])


OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM pat),
win AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, win.n AS n, item_id FROM win JOIN pat USING (p)),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""

def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, share=85)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), F.col("predicted").alias("lang_pred"), "score")


def ranks() -> dict[bytes, int]:
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), ranks()).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


#: The contract's rules.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels beside the listed rules' verdicts: a page whose id is labelled of low quality or toxic is to be blocked."""
    bad = (F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(bad, "block").when(F.col("quality") == 1, "allow").alias("verdict"))
    return url_filter.judge(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), labels)


def vocabularies() -> tuple[str, bytes]:
    """The JSON of the byte-level tokenizer and the model of the piece tokenizer, as the driver reads them."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), *vocabularies())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_pii": op2_pii,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_language_id": op4_language_id,
    "op5_bpe": op5_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_chat_format": op7_chat_format,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_secret_scan": op10_secret_scan,
    "op11_url_filter": op11_url_filter,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {"op8_decontaminate": OP8_SQL}
