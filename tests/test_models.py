"""Vocabularies, the classifier and clusters against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import models, vocabulary


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    say = {"en": "the of and thing able nation red".split(), "de": "der die und heit keit bär rot".split(), "fr": "les des élan eau ment rouge".split()}
    return [(k, " ".join(rng.choices(say[lang] + ["x1", "common", "shared"], k=rng.randint(3, 12))), lang) for k, lang in enumerate(rng.choices(list(say), [5, 2, 1], k=150))]


def plain_terms(text: str) -> list[str]:
    words = [w for w in text.replace("ä", "a").replace("é", "e").split() if len(w) > 1]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_terms_are_chosen_as_counted(spark, texts):
    docs = spark.createDataFrame([*texts, (1000, None, "en"), (1001, "", "en")], "doc_id int, text string, lang string")
    found = vocabulary.select_terms(docs, "doc_id", models.Features._words("text"), 25, 3, 0.4, ["shared"]).orderBy("place").collect()
    bags = [Counter(plain_terms(t)) for _, t, _ in texts]
    tf, df = sum(bags, Counter()), Counter(t for b in bags for t in b)
    fit = sorted((t for t in tf if 3 <= df[t] <= 0.4 * 152 and t != "shared"), key=lambda t: (-tf[t], t))[:25]
    assert [(r.term, r.place, r.df) for r in found] == [(t, k, df[t]) for k, t in enumerate(sorted(fit))]
    assert all(r.idf == pytest.approx(math.log(153 / (1 + r.df)) + 1) for r in found)
    one = spark.range(1).select(vocabulary.without_accents(F.lit("Ünïcødé é ß")).alias("x")).first().x
    assert one == "Unicøde e ß"


def dense(frame, size: int) -> tuple[list, np.ndarray]:
    rows = sorted(frame.collect(), key=lambda r: r.key)
    x = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        x[i, r.places] = r.ws
    return [r.key for r in rows], x


def test_the_classifier_equals_a_dense_fit(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id int, text string, lang string")
    features = models.Features(most_words=40, most_chars=60)
    train = docs.where("doc_id < 100")
    vocabularies = features.vocabularies(train, "doc_id", "text")
    keys, x = dense(*features.rows(docs, "doc_id", "text", vocabularies))
    assert x.shape == (150, sum(v.count() for v, _ in vocabularies))
    assert set(np.round((x * x).sum(1), 6)) <= {0.52, 0.36, 0.16, 0.0} and np.round((x * x).sum(1)[0], 6) == 0.52
    names = ["de", "en", "fr"]
    y = np.array([names.index(lang) for _, _, lang in texts])
    own = y[:100]
    weight = 100 / (3 * np.bincount(own)[own])
    w, b, rate = np.zeros((x.shape[1], 3)), np.zeros(3), 0.5
    for _ in range(6000):
        z = x[:100] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - np.eye(3)[own]) * weight[:, None] / 100
        w -= rate * (x[:100].T @ g + w / 100)
        b -= rate * g.sum(0)
    z = x @ w + b
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    found = {r.doc_id: r for r in models.classify(train, docs, "lang", features=features).collect()}
    mine = np.array([found[k].probabilities for k in keys])
    loss = lambda q: -np.log(q[100:][np.arange(50), y[100:]]).mean()
    assert abs(loss(mine) - loss(p)) < 0.005 and np.abs(mine - p).max() < 0.02
    one = found[keys[0]]
    assert [a.name for a in one.alternatives][0] == one.intent and one.margin == pytest.approx(one.alternatives[0].score - one.alternatives[1].score, abs=2e-6)


def test_only_vectors_of_the_fit_are_written(spark, texts, monkeypatch):
    """And they meet their labels without a shuffle; probabilities are those of the fitted model."""
    docs = spark.createDataFrame([*texts, (1000, None, "en"), (1001, "unknown", None)], "doc_id int, text string, lang string")
    seen, fits, write, fit = [], [], models.as_vectors, models.LogisticRegression.fit
    monkeypatch.setattr(models, "as_vectors", lambda df, size: seen.append(df) or write(df, size))
    monkeypatch.setattr(models.LogisticRegression, "fit", lambda self, df: fits.append(fit(self, df)) or fits[-1])
    features = models.Features(most_words=40, most_chars=60)
    found = {r.doc_id: r.probabilities for r in models.classify(docs.where("doc_id < 100"), docs, "lang", features=features, rounds=5).collect()}
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert len(seen) == 1 and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(doc_id") == 1
    rows, size = features.rows(docs, "doc_id", "text", features.vocabularies(docs.where("doc_id < 100"), "doc_id", "text"))
    known = fits[0].transform(write(rows, size)).collect()
    assert len(found) == len(known) == 152 and all(found[r.key] == pytest.approx(list(r.probability), abs=1e-12) for r in known)
    assert models._probabilities(rows, np.zeros((2, size)), np.array([np.inf, 0.0])).first().p == [1.0, 0.0]


def test_clusters_equal_plain_k_means_from_ten_starts(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.6, (40, 5)) for c in (0, 2, 4)]).round(3)
    places = list(range(5))
    rows = spark.createDataFrame([(i, places, v.tolist()) for i, v in enumerate(x)], "key int, places array<int>, ws array<double>").repartition(3)
    centres = models.fit_clusters(rows, 5, 3, "s", starts=4, cut=7)
    import hashlib

    best = (np.inf, None)
    for s in range(4):
        order = sorted(range(120), key=lambda i: (hashlib.sha256(f"s:{s}:{i}".encode()).hexdigest(), i))[:3]
        c = x[order]
        for _ in range(100):
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            to = d.argmin(1)
            new = np.array([x[to == k].mean(0) if (to == k).any() else c[k] for k in range(3)])
            if np.allclose(new, c, atol=1e-12):
                break
            c = new
        total = ((x - c[to]) ** 2).sum()
        if total < best[0] - 1e-9:
            best = total, c
    assert np.allclose(centres, best[1], atol=1e-6)
    found = {r.key: r for r in models.assigned(rows, centres).collect()}
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert [found[i].cluster for i in range(120)] == d.argmin(1).tolist() and np.allclose([found[i].distance for i in range(120)], np.sqrt(d.min(1)))
    assert models.fit_clusters(rows.where("false"), 5, 3).shape == (0, 5) and models.assigned(rows, np.zeros((0, 5))).count() == 0


def test_clusters_of_texts_have_terms_and_members(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id int, text string, lang string")
    members, terms, nearest = models.clusters(docs, 3, most_terms=60)
    assert members.count() == 150 and nearest.groupBy("cluster").count().where("count > 5").count() == 0
    assert {r.cluster for r in terms.collect()} == {r.cluster for r in members.select("cluster").distinct().collect()}
    means = models.distances_to_means(spark.createDataFrame([(1, [0], [1.0]), (2, [1], [1.0]), (3, [], [])], "key int, places array<int>, ws array<double>"), spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "key int, cluster bigint"))
    assert {r.key: round(r.distance, 6) for r in means.collect()} == {1: round(math.sqrt(0.5), 6), 2: round(math.sqrt(0.5), 6), 3: 0.0}


def test_a_documents_terms_are_weighed_in_its_own_row(spark):
    docs = spark.createDataFrame([(1, "red cat red", ["a", "a", "z"]), (2, "dog", []), (3, None, None)], "doc_id int, text string, letters array<string>")
    words = spark.createDataFrame([("cat", 0, 2.0), ("red", 1, 3.0)], "term string, place int, idf double")
    letters = spark.createDataFrame([("a", 0, 1.0)], "term string, place int, idf double")
    rows = vocabulary.packed(docs, "doc_id", [vocabulary.Kind(F.split("text", " "), words, 0.6), vocabulary.Kind(F.col("letters"), letters, 0.4, 2)])
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 2  # no term is shuffled: the documents are dealt out, once
    a, b = 2.0, 3.0 * (1 + math.log(2))
    found = {r.key: (r.places, r.ws) for r in rows.collect()}
    assert found[2] == found[3] == ([], []) and found[1][0] == [0, 1, 2]
    assert found[1][1] == pytest.approx([0.6 * a / math.hypot(a, b), 0.6 * b / math.hypot(a, b), 0.4])
    none = spark.createDataFrame([], words.schema)
    assert [(r.places, r.ws) for r in vocabulary.packed(docs, "doc_id", [vocabulary.Kind(F.col("letters"), none)]).collect()] == [([], [])] * 3


def test_terms_are_counted_before_they_are_shuffled(spark):
    """A batch gives a row for each of its terms, not for each time one occurs."""
    import pyarrow as pa

    lists = pa.array([["b", "a", "b"], None, [], ["a", None], ["a"]], pa.list_(pa.string()))
    (out,) = vocabulary._counted(iter([pa.RecordBatch.from_arrays([lists], ["terms"])]))
    assert {r["term"]: (r["tf"], r["df"]) for r in out.to_pylist()} == {"a": (3, 3), "b": (2, 1)}
    (none,) = vocabulary._counted(iter([pa.RecordBatch.from_arrays([lists.slice(1, 2)], ["terms"])]))
    assert none.num_rows == 0


def test_vectors_are_a_table_that_no_python_makes(spark):
    rows = spark.createDataFrame([(1, [0, 3], [1.0, 2.0]), (2, [], [])], "key int, places array<int>, ws array<double>")
    out = vocabulary.as_vectors(rows, 5)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    found = {r.key: r.features for r in out.collect()}
    assert found[1].toArray().tolist() == [1, 0, 0, 2, 0] and found[2].toArray().tolist() == [0] * 5


def test_character_terms_are_counted_by_word_as_in_whole_texts(spark):
    from threadloom.operators import retrieval

    docs = spark.createDataFrame([(1, "red red  a bär"), (2, "read 𝒳𝒴"), (3, ""), (4, None)], "doc_id int, text string")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    counted = lambda terms, **more: {tuple(r) for r in vocabulary.select_terms(docs, "doc_id", terms, 1000, **more).select("term", "place", "df", "idf").collect()}
    assert counted(words, sizes=(3, 4, 5)) == counted(retrieval.char_terms(F.col("text"))) != set()
    chosen = vocabulary.select_terms(docs, "doc_id", words, 8, sizes=(3, 4))
    by_word, whole = (vocabulary.packed(docs, "doc_id", [k]).orderBy("key").collect() for k in (vocabulary.Kind(words, chosen, sizes=(3, 4)), vocabulary.Kind(retrieval.char_terms(F.col("text"), (3, 4)), chosen)))
    assert [r.places for r in by_word] == [r.places for r in whole] and all(a.ws == pytest.approx(b.ws) for a, b in zip(by_word, whole))
