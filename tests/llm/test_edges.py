"""Nulls, empty and very long texts, ties, repeats, empty tables, string ids and columns with clashing names, for every operator
and every stage of the pipeline; Viterbi and boosting against plain versions."""

from __future__ import annotations

import hashlib
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import bpe, chat, decontam, langid, neardup, pii, quality_model, quality_rules, queries, secret_scan, substring_dedup

CLASH = "_id int, _text int, spans int, score int, predicted int, text_hash int, kinds int, tokens int, node int, print int, part int, items int, ids int, base int, candidates int, lang string"
LONG = " ".join(f"w{k * 7919 % 20011}" for k in range(20_000))


@pytest.fixture(scope="module")
def clashing(spark):
    """String ids and many columns named like an operator's own; a very long text, twice, near-equal; null, empty, repeats."""
    texts = [LONG, LONG + " end", None, "", "x@y.co the the", "x@y.co the the", "12 34 !!", LONG.upper()]
    rows = [(f"d{k}", t, *[k] * 15, "en") for k, t in enumerate(texts)] + [("d4", "x@y.co the the", *[9] * 15, "en"), (None, "x@y.co the the", *[9] * 15, None)]
    return spark.createDataFrame(rows, f"doc_id string, text string, {CLASH}").repartition(2)


def by_id(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_every_operator_takes_clashing_columns_and_string_ids(spark, clashing):
    kept = by_id(substring_dedup.remove_repeats(clashing))
    assert [kept[f"d{k}"][0].n_removed for k in (0, 1, 7)] == [0, 20_000, 0] and kept["d2"][0].n_words == 0 and len(kept["d4"]) == 2
    near = by_id(neardup.near_duplicates(clashing, shingle=3, share=85))
    assert {k: r[0].component_id for k, r in near.items()} == {"d0": "d0", "d1": "d0", "d2": "d2", "d3": "d3", "d4": "d4", "d5": "d4", "d6": "d6", "d7": "d0", None: None}
    assert near["d0"][0].n_shingles == 19_998 and near[None][0].kept
    found = by_id(pii.detect(clashing, keep=["_id", "_text"]))
    assert [len(found[k][0].spans) for k in ("d2", "d3", "d4", None)] == [0, 0, 1, 1] and found["d1"][0]["_id"] == 1 and found["d2"][0].text is None
    secrets = by_id(secret_scan.scan(clashing))
    assert len(secrets) == 9 and all(not r.spans for rows in secrets.values() for r in rows)
    hits = by_id(decontam.decontaminate(clashing, spark.createDataFrame([("i", " ".join(LONG.split()[500:560]), 1)], "item_id string, text string, pattern int"), keep=["lang"]))
    assert [hits[f"d{k}"][0].n_hit for k in range(8)] == [60, 60, 0, 0, 0, 0, 0, 60] and hits["d0"][0].lang == "en" and len(hits["d0"][0].spans) == 1
    encoded = by_id(bpe.round_trip(clashing, queries.ranks()))
    assert encoded["d0"][0].text == LONG and encoded["d2"][0].text == "" and encoded["d7"][0].text == LONG.upper()
    scored = by_id(langid.identify(clashing, langid.train(clashing), keep=["doc_id", "_text", "kinds"]))
    assert [scored[f"d{k}"][0].predicted for k in (0, 2, 3, 6)] == ["en", "und", "und", "und"] and scored["d1"][0]["_text"] == 1
    labels = spark.createDataFrame([(f"d{k}", k % 2, 0) for k in range(8)] + [("d0", 1, 1), (None, 1, 1)], "doc_id string, quality int, text int")
    rules = by_id(quality_rules.apply_rules(clashing, labels, buckets=256))
    assert rules["d0"][0].n_words == 20_000 and rules["d2"][0].base_failed and len(rules["d4"]) == 2 and rules["d4"][0].score == rules["d4"][1].score
    grades = by_id(quality_model.score(clashing, quality_model.train(clashing, labels)))
    assert len(grades) == 9 and grades["d4"][0].score == grades["d5"][0].score == grades[None][0].score


def test_every_operator_takes_an_empty_table(spark, clashing):
    none = clashing.where("false")
    labels = spark.createDataFrame([], "doc_id string, quality int")
    for frame in (
        substring_dedup.remove_repeats(none), neardup.near_duplicates(none), pii.detect(none), secret_scan.scan(none), decontam.decontaminate(none, spark.createDataFrame([], "item_id string, text string")),
        bpe.round_trip(none, queries.ranks()), langid.identify(none, langid.train(none)), quality_rules.apply_rules(none, labels, buckets=64), quality_model.score(none, quality_model.train(none, labels)),
    ):
        assert frame.count() == 0


def test_every_stage_takes_nulls_repeats_long_texts_and_empty_tables(spark, tmp_path):
    item = " ".join(f"bench{k}" for k in range(30))
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans int, predicted int"
    rows = [(1, LONG, "en", "a", 1, 1, 1), (2, LONG + " x", "en", "a", 1, 1, 1), (3, None, "en", "a", None, 1, 1), (4, "", "en", "a", 0, 1, 1), (5, "mail x@y.co now", "en", "b", 1, 1, 1), (5, "mail x@y.co now", "en", "a", 1, 1, 1), (6, "so " + item, None, None, None, 1, 1), (None, LONG, "en", "a", 1, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    stages, columns = dict(corpus_pipeline.STAGES), corpus_pipeline.COLUMNS
    ids = lambda frame: sorted((r.doc_id is None, r.doc_id) for r in frame.collect())
    flat = lambda *n: sorted((x is None, x) for x in n)
    run = lambda name, frame=docs: stages[name](spark, frame, str(tmp_path))
    assert ids(run("language")) == flat(1, 2, 5, 5, 6, None) and run("language").columns == columns
    near = run("near_duplicates").collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in near) == flat(1, 3, 4, 5, 6, None) and [r.source for r in near if r.doc_id == 5] == ["a"]
    assert ids(run("decontaminate")) == flat(1, 2, 3, 4, 5, 5, None)
    private = {r.doc_id: r for r in run("private").collect()}
    assert private[5].text == "mail <email> now" and private[5].n_chars == 16 and private[3].text is None and private[2].text == LONG + " x"
    tokens = {r.doc_id: r for r in run("tokens").collect()}
    assert len(tokens) == 7 and tokens[3].n_tokens == tokens[4].n_tokens == 0 and tokens[1].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert all(run(name, docs.where("false")).count() == 0 for name in stages)


def test_viterbi_over_words_equals_exhaustive_search(spark):
    rng = random.Random(2)
    say = {"en": "the of and thing ble ation".split(), "de": "der die ung heit keit ble".split(), "fr": "les des ion eau ment of".split()}
    rows = [(i, " ".join(rng.choices(say[lang], k=30)), lang) for i, lang in enumerate(rng.choices(list(say), k=200))]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), penalty=2.0)
    pool = sorted({w for own in say.values() for w in own} | {"12", "привет", "theung"})
    texts = [" ".join(rng.choices(pool, k=rng.randint(1, 7))) for _ in range(40)]
    table = {w: model.table[r[0]] for w, r in zip(pool, model.rows(pool))}

    def value(words, labels):
        return sum(float(table[w][k]) for w, k in zip(words, labels)) - 2.0 * sum(a != b for a, b in zip(labels, labels[1:]))

    for text, (_, _, spans) in zip(texts, model.spans(texts)):
        words = text.split()
        if spans:
            own = [k for a, b, k in spans for _ in range(b - a)]
            assert len(own) == len(words)
            assert abs(value(words, own) - max(value(words, p) for p in product(range(3), repeat=len(words)))) < 1e-4
    foreign, mixed = model.spans(["привет мир", "the of and привет"])
    assert foreign[0] == model.languages[0] and foreign[1] == 0 and mixed[1] == pytest.approx(8 / 14)


def test_tables_score_as_a_plain_loop_and_boosting_takes_the_best_cuts():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_model.fit(x, y, rounds=20)

    def plain(row):
        total = model.intercept
        for f, (edges, table) in enumerate(zip(model.edges, model.tables)):
            total += table[sum(row[f] >= e for e in edges)]
        for a, b, ea, eb, table in model.pairs:
            total += table[sum(row[a] >= e for e in ea)][sum(row[b] >= e for e in eb)]
        return total

    assert np.allclose(model.logits(x), [plain(r) for r in x])
    assert ((model.scores(x) >= 0.5) == y).mean() > 0.9  # neither feature alone tells anything
    assert (model.pairs[0][0], model.pairs[0][1]) == (0, 1)
    grad, hess = rng.normal(size=9), rng.random(9)
    gain = lambda k: sum(grad[s].sum() ** 2 / (hess[s].sum() + 2.0) for s in (slice(None, k), slice(k, None))) - grad.sum() ** 2 / (hess.sum() + 2.0)
    assert quality_model._cut(grad, hess, 2.0)[1] == max(range(1, 9), key=gain)


def test_held_out_roles_are_recovered_without_most_markers(spark):
    """Conversations with their own ways of speaking, as op7 meets them."""
    rng = random.Random(8)
    rows = []
    for c in range(300):
        for t in range(6):
            ask = t % 2 == 0
            text = " ".join(rng.choices("why how can you see it".split(), k=rng.randint(3, 7))) + "?" if ask else "\n".join("Well " + " ".join(rng.choices("this works if you turn that off".split(), k=14)) + "." for _ in range(rng.randint(1, 3)))
            rows.append((c, t, "user" if ask else "assistant", text))
    parts = chat.transcripts(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    model = chat.train(parts.where(~chat.held_out(F.col("conv_id"))))
    right = total = 0
    for r in chat.parse_parts(parts.where(chat.held_out(F.col("conv_id"))), model).collect():
        truth = [t.role for t in r.turns for _ in t.text.split("\n")]
        right += sum(a == b for a, b in zip(truth, r.line_roles))
        total += len(truth)
    assert total > 300 and right / total > 0.97
