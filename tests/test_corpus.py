"""Decontamination, the freeze, retrieval, bootstrap and gates against plain versions, and what must not be lost silently."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import contracts, freeze, gates, metrics, retrieval, splits
from threadloom.plans import registry

RANK = {"TRAIN": 0, "DEVELOPMENT": 1, "GOLD": 2}


def say(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def grams(text: str) -> set:
    return {text[i : i + 5] for i in range(max(len(text) - 4, 1))} if text else set()


def near_loop(docs: list[tuple], assigned: dict, tokens: float, chars: float, k: int, most: int) -> tuple[dict, int]:
    """The loop written out: all pairs of a pass in order, the later split goes, until nothing does. ids that stay, and passes."""
    kept, passes = dict(assigned), 0
    signature = {d[:3]: sorted(hashlib.md5(g.encode()).hexdigest() for g in d[4])[:k] for d in docs}
    while True:
        passes += 1
        values = defaultdict(list)
        for d in docs:
            if d[0] in kept:
                for h in signature[d[:3]]:
                    values[d[2], h].append(d)
        found = {}
        for own in values.values():
            for a, b in combinations(sorted(own), 2) if len(own) <= most else ():
                if a[1] != b[1] and a[0] != b[0]:
                    t, c = jaccard(a[3], b[3]), jaccard(a[4], b[4])
                    if t >= tokens or c >= chars:
                        found[a[0], b[0], a[2]] = max(round(t, 6), round(c, 6))
        gone = 0
        for (a, b, _), _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            if a in kept and b in kept:
                del kept[a if RANK[kept[a]] > RANK[kept[b]] else b]
                gone += 1
        if not gone:
            return kept, passes


@pytest.mark.parametrize("most", [4, 10, 250])
def test_near_decontamination_equals_the_loop_written_out(spark, most):
    rng = random.Random(most)
    bases = [say(rng, 12).split() for _ in range(6)]
    texts = {}
    for i in range(90):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = say(rng, 1)
        texts[i] = " ".join(words)
    split = {i: list(RANK)[rng.randrange(3)] for i in texts}
    docs = [(i, split[i], kind, set(t.split()), grams(t)) for i, t in texts.items() for kind in (["CUSTOMER", "BRAND"] if i % 2 else ["CUSTOMER"])]
    rows = spark.createDataFrame([(i, s, k, sorted(t), sorted(g)) for i, s, k, t, g in docs], "id bigint, split string, kind string, tokens array<string>, grams array<string>")
    found = splits.decontaminate_near_repeated(spark.createDataFrame(list(split.items()), "id bigint, split string"), rows, 0.8, 0.85, 12, most).collect()
    kept, passes = near_loop(docs, split, 0.8, 0.85, 12, most)
    assert len(found) == 90 and {r.id for r in found if not r.dropped} == set(kept)
    assert max(r["pass"] or 0 for r in found) == passes - 1 and (most == 250 or passes > 2)


def test_near_decontamination_of_threads_equals_the_loop_over_a_whole_table(spark):
    from threadloom.plans.retrieval_queries import leaks

    d = "/root/testdata/sf0.01"
    docs = [(r.id, r.split, r.kind, set(r.tokens), set(r.grams)) for r in leaks(spark, d).collect()]
    found = {r.id: r for r in registry.QUERIES["decontaminate_near_repeated"](spark, d).collect()}
    kept, _ = near_loop(docs, {i: r.split for i, r in found.items()}, 0.9, 0.92, 12, 250)
    assert {i for i, r in found.items() if not r.dropped} == set(kept) and len({k[2] for k in docs}) == 2


def test_signatures_find_nearly_all_near_pairs(spark):
    """Recall against all pairs of the documents of a whole table."""
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.doc_id % 3, r.flat) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.normalize_for_leakage(F.col("text")).alias("flat")).collect()]
    sets = [(i, s, grams(t)) for i, s, t in rows]
    sets.sort(key=lambda x: len(x[2]))
    want = set()
    for n, (i, s, g) in enumerate(sets):
        for j, t, h in sets[n + 1 :]:
            if len(g) < 0.92 * len(h):
                break
            if s != t and g and jaccard(g, h) >= 0.92:
                want.add((min(i, j), max(i, j)))
    found = {(r.a, r.b) for r in registry.QUERIES["near_duplicate_pairs"](spark, d).collect()}
    assert len(want) > 3 and found <= want and len(found) >= 0.99 * len(want)


def freeze_plain(items: list[dict], topics: list, targets: dict, seed: str, t_alike: float, c_alike: float) -> list:
    chosen, out = [], []
    for bucket, target in targets.items():
        own = [x for x in items if x["bucket"] == bucket]
        quotas = freeze.topic_quotas(Counter(x["topic"] for x in own), topics, target)
        flags = set()
        for topic in topics:
            bins = set()
            for _ in range(quotas.get(topic, 0)):
                free = [x for x in own if x["topic"] == topic and x not in chosen and not any(any(a == b and a or jaccard(set(a.split()), set(b.split())) >= t_alike or jaccard(grams(a), grams(b)) >= c_alike for a, b in zip(x["texts"], y["texts"])) for y in chosen)]
                rank = lambda x: (-len(set(x["flags"]) - flags), x["bin"] in bins, -round(min([1 - jaccard(set(x["texts"][-1].split()), set(y["texts"][-1].split())) for y in chosen] or [1.0]), 8), hashlib.sha256(f"{seed}:{bucket}:{topic}:{x['id']}".encode()).hexdigest())  # noqa: E731,B023
                best = min(free, key=rank)
                chosen.append(best)
                flags |= set(best["flags"])
                bins.add(best["bin"])
                out.append((best["id"], bucket, topic, len(out) + 1))
    return out


@pytest.mark.parametrize("heap", [3, 256])
def test_the_freeze_equals_the_plain_greedy_choice(spark, heap):
    rng = random.Random(5)
    pool = [say(rng, 9) for _ in range(40)]
    items = []
    for i in range(160):
        text = rng.choice(pool)
        text = text if rng.random() < 0.3 else text.replace(text.split()[2], say(rng, 1)) + " " + say(rng, rng.randint(0, 6))
        items.append({"id": i, "bucket": "A" if i % 4 else "B", "topic": rng.choice(["x", "x", "y", "z"]), "bin": rng.randrange(4), "flags": rng.sample(["p", "q", "r", "s"], rng.randrange(3)), "texts": [say(rng, 3), text.strip()]})
    frame = spark.createDataFrame([tuple(x.values()) for x in items], "id bigint, bucket string, topic string, bin int, flags array<string>, texts array<string>")
    targets = {"A": 20, "B": 8} if heap > 3 else {"A": 6, "B": 4}
    found = freeze.freeze(frame, ["x", "y", "z", "w"], targets, "s", 0.6, 0.7, heap=heap).orderBy("position").collect()
    assert [tuple(r) for r in found] == freeze_plain(items, ["x", "y", "z", "w"], targets, "s", 0.6, 0.7)


def test_quotas_and_an_exhausted_quota(spark):
    assert freeze.topic_quotas({"a": 90, "b": 9, "c": 1}, ["a", "b", "c", "d"], 10) == {"a": 7, "b": 2, "c": 1}
    assert freeze.topic_quotas({"a": 2, "b": 2}, ["a", "b"], 4) == {"a": 2, "b": 2}
    with pytest.raises(ValueError, match="cannot be shared"):
        freeze.topic_quotas({"a": 2, "b": 2}, ["a", "b"], 5)
    same = spark.createDataFrame([(k, "A", "x", 0, [], ["one two three four five"]) for k in range(5)], "id int, bucket string, topic string, bin int, flags array<string>, texts array<string>")
    with pytest.raises(ValueError, match="exhaust the quota of 'x'"):
        freeze.freeze(same, ["x"], {"A": 2}, "s")


def test_passes_of_the_freeze_write_nothing(spark, monkeypatch):
    """Candidates are written once, without their n-grams; copies and near copies, also of other tokens, are met by every pass."""
    rng = random.Random(8)
    pool = [say(rng, 30) for _ in range(12)]
    texts = [t for t in pool for _ in range(9)] + [t.replace(" ", "") for t in pool] + [t.replace(" ", "", 1) for t in pool] + [""]
    items = [{"id": i, "bucket": "A", "topic": "x", "bin": i % 5, "flags": rng.sample(["p", "q"], rng.randrange(3)), "texts": [text]} for i, text in enumerate(texts)]
    frame = spark.createDataFrame([tuple(x.values()) for x in items], "id bigint, bucket string, topic string, bin int, flags array<string>, texts array<string>")
    tables, write = [], freeze.written
    monkeypatch.setattr(freeze, "written", lambda df: tables.append(df) or write(df))
    found = freeze.freeze(frame, ["x"], {"A": 14}, "s", heap=4).orderBy("position").collect()
    assert [tuple(r) for r in found] == freeze_plain(items, ["x"], {"A": 14}, "s", 0.9, 0.92)
    assert len(tables) == 1 and "grams" not in tables[0].columns


def test_freeze_of_a_whole_table(spark):
    found = registry.QUERIES["freeze_rows"](spark, "/root/testdata/sf0.001").collect()
    assert Counter(r.bucket for r in found) == {"REPRESENTATIVE": 24, "CHALLENGE": 12} and len({r.id for r in found}) == 36


def test_top_k_by_blocks_equals_all_sums(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    vector = lambda n: {w: rng.random() for w in rng.sample(words, n)}
    asked, docs = {f"q{k}": vector(6) for k in range(12)}, {k: vector(rng.randint(1, 25)) for k in range(300)}
    docs |= {k: dict(docs[k - 300]) for k in range(300, 340)}  # ties
    frame = lambda rows, kind: spark.createDataFrame([(k, t, w) for k, v in rows.items() for t, w in v.items()], f"key {kind}, term string, w double")
    scored = spark.sparkContext.accumulator(0)
    found = defaultdict(list)
    for r in retrieval.top_by_weights(frame(asked, "string"), frame(docs, "bigint"), 4, entries=30, rows=16, scored=scored).orderBy("query", "rank").collect():
        found[r["query"]].append((r.doc, r.similarity))
    for q, v in asked.items():
        every = sorted((-round(sum(w * own.get(t, 0) for t, w in v.items()), 6), d) for d, own in docs.items() if set(v) & set(own))
        assert found[q] == [(d, -s) for s, d in every[:4]]
    assert 0 < scored.value < 12 * 340
    assert retrieval.top_by_weights(frame({}, "string"), frame(docs, "bigint"), 4).count() == 0 and retrieval.top_by_weights(frame(asked, "string"), frame({}, "bigint"), 4).count() == 0


def test_similar_sets_have_a_group_in_common(spark):
    """Of any size, also where the sizes' classes differ; and one value that all documents have proposes no pairs."""
    rng = random.Random(3)
    rows = []
    for n in [*range(1, 60), 97, 211, 600]:
        own = [rng.getrandbits(63) for _ in range(n)]
        for t in (0.9, 0.92):
            m = int(n * t + 1 - 1e-9)  # as small as it may be
            rows += [(len(rows), own, t), (len(rows) + 1, own[:m], t)]
            d = int((1 - t) / (1 + t) * 2 * n + 1e-9) // 2
            rows += [(len(rows), own, t), (len(rows) + 1, own[d:] + [rng.getrandbits(63) for _ in range(d)], t)]
    frame = spark.createDataFrame(rows, "id int, v array<bigint>, t double")
    found = set()
    for t in (0.9, 0.92):
        base = frame.where(F.col("t") == t).select("id", F.when(F.col("id") % 2 == 0, "TRAIN").otherwise("GOLD").alias("split"), splits._group_keys(F.col("v"), t).alias("keys"))
        found |= {tuple(r) for r in splits._meetings(base).collect()}
    assert {(k, k + 1) for k in range(0, len(rows), 2)} <= found
    texts = [" ".join(say(rng, 40).split()) for _ in range(40)]
    docs = spark.createDataFrame([(k, ("TRAIN", "GOLD")[k % 2], "the same words begin " + x) for k, x in enumerate(texts)], "id int, split string, text string")
    base = docs.select("id", "split", splits._group_keys(splits._hashed(tx.char_ngrams(F.col("text"))), 0.92).alias("keys"))
    assert splits._meetings(base).count() < 20


def test_products_of_matrices_equal_all_sums(spark, monkeypatch):
    """Terms that many queries have and rare ones, of two kinds, in several parts; equal sums go by document, and queries without any term in common have none."""
    monkeypatch.setattr(retrieval, "_COMMON", 0.3)
    rng = random.Random(19)
    words = [f"{kind}:{k}" for kind in "wc" for k in range(30)]
    vector = lambda n: {w: rng.random() for w in rng.sample(words, n) + ["w:all"]}
    asked, docs = {f"q{k}": vector(rng.randint(2, 20)) for k in range(25)}, {k: vector(rng.randint(1, 25)) for k in range(300)}
    docs |= {k: dict(docs[k - 300]) for k in range(300, 340)}  # ties
    asked["alone"], docs[999] = {"w:nowhere": 1.0}, {"c:elsewhere": 1.0}
    frame = lambda rows, kind: spark.createDataFrame([(k, t, w) for k, v in rows.items() for t, w in v.items()], f"key {kind}, term string, w double")
    found = defaultdict(list)
    for r in retrieval.top_by_products(frame(asked, "string"), frame(docs, "bigint"), 4, ("w:", "c:"), entries=90, rows=16).orderBy("query", "rank").collect():
        found[r["query"]].append((r.doc, r.similarity))
        for kind in ("w:", "c:"):
            assert abs(r[kind] - sum(w * docs[r.doc].get(t, 0) for t, w in asked[r["query"]].items() if t.startswith(kind))) < 1e-12
    for q, v in asked.items():
        every = sorted((-round(sum(w * own.get(t, 0) for t, w in v.items()), 6), d) for d, own in docs.items() if set(v) & set(own))
        assert found[q] == [(d, -s) for s, d in every[:4]]
    assert retrieval.top_by_products(frame({}, "string"), frame(docs, "bigint"), 4).count() == 0 and retrieval.top_by_products(frame(asked, "string"), frame({}, "bigint"), 4).columns == ["query", "doc", "similarity", "rank"]
    assert retrieval.top_by_products(frame(asked, "string"), frame({}, "bigint"), 4).count() == 0


def test_few_pairs_are_scored(spark):
    """Items against all documents: most pairs are not added up to the end. The share falls as tables grow: blocks of a task know a k-th best."""
    d = "/root/testdata/sf0.01"
    terms = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']+"), F.lit(0))
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    weights, idf = retrieval.term_weights(docs, "doc_id", terms, least_docs=2)
    scored = spark.sparkContext.accumulator(0)
    found = retrieval.top_by_weights(retrieval.term_weights(items, "item_id", terms, idf)[0], weights, 5, scored=scored).count()
    assert found == 5 * items.count() and scored.value < 0.4 * docs.count() * items.count()


def test_vectors_without_queries(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "doc int, v array<double>")
    asked = spark.createDataFrame([], "query int, q array<double>")
    assert retrieval.vector_top_k(asked, v, 3).count() == 0
    assert retrieval.vector_top_k(spark.createDataFrame([(7, [1.0, 1.0])], "query int, q array<double>"), v.where("false"), 3).count() == 0


def test_unknown_and_missing_labels_are_errors(spark):
    rows = lambda *v: spark.createDataFrame(v, "gold string, pred string")
    assert metrics.confusion(rows(("a", "b"), ("a", "a")), ["a", "b"]).agg(F.sum("n")).first()[0] == 2
    for bad in (("a", "c"), ("c", "a"), ("a", None)):
        with pytest.raises(Exception, match="unknown (gold|pred) label"):
            metrics.confusion(rows(("a", "a"), bad), ["a", "b"]).collect()
    with pytest.raises(Exception, match="no predicted action"):
        metrics.action_metrics(rows(("a", None)), F.col("gold") == "a", F.col("pred") == "a").collect()


def test_a_query_without_cases_escalates(spark):
    cases = spark.createDataFrame([(1, 1, 0.9, 0.9, True, "r"), (1, 2, 0.8, 0.8, False, "r")], "query int, rank int, score double, similarity double, same_intent boolean, reply string")
    asked = spark.createDataFrame([(1, 0.9, 0.5), (2, 0.9, 0.5), (3, None, 0.0)], "query int, confidence double, margin double").unionByName(spark.createDataFrame([(1, 0.1, 0.01)], "query int, confidence double, margin double").where("query = 9"))
    limits = {"score": 0.4, "similarity": 0.15, "agreement": 0.6, "concentration": 0.6, "confidence": 0.5, "margin": 0.1}
    found = {r["query"]: r for r in gates.evidence(cases, limits, asked).collect()}
    assert found[1].reasons == ["INTENT_RETRIEVAL_MISMATCH", "TEMPLATE_CONCENTRATION"]
    assert all((found[k].reasons, found[k].intent_agreement, found[k].template_concentration) == (["INSUFFICIENT_EVIDENCE"], 0.0, 1.0) for k in (2, 3))
    low = gates.evidence(cases, limits, asked.where("query = 1").select("query", F.lit(0.2).alias("confidence"), F.lit(0.05).alias("margin"))).first()
    assert low.reasons[:2] == ["LOW_INTENT_CONFIDENCE", "AMBIGUOUS_INTENT"]
    with pytest.raises(Exception, match="no case"):
        gates.calibrated(asked, cases, {"score": (0.5, 0.0, 1.0)}).collect()


def test_multiplicities_are_poisson_and_intervals_cover(spark):
    rows = spark.range(2000)
    drawn = [r.times for r in metrics.multiplicities(rows, F.col("id"), "s", 20).collect()]
    assert len(drawn) == pytest.approx(40_000 * (1 - math.exp(-1)), rel=0.02) and sum(drawn) == pytest.approx(40_000, rel=0.02) and sum(x * x for x in drawn) == pytest.approx(80_000, rel=0.04)
    share = metrics.bootstrap_of(rows, F.col("id"), "s", 200, {"n": F.lit(1), "x": F.col("id") % 4 == 0}, {"share": tx.ratio(F.col("x"), F.col("n"))}).first()
    half = 1.96 * math.sqrt(0.25 * 0.75 / 2000)
    assert share.estimate == 0.25 and share.high - share.low == pytest.approx(2 * half, rel=0.25)
    with pytest.raises(Exception, match="no values"):
        metrics.bootstrap_of(rows.where("false"), F.col("id"), "s", 10, {"n": F.lit(1)}, {"n": F.col("n")}).collect()


def test_digests_of_sets_do_not_depend_on_order_and_keep_empty_groups(spark):
    rows = spark.createDataFrame([("a", str(k)) for k in range(500)] + [("b", "1"), ("b", "1"), ("c", None), (None, "1")], "g string, id string")
    found = {r.g: (r.ids, r.digest) for r in contracts.digest_tree(rows, "id", "g", 16).collect()}
    assert found["a"][0] == 500 and found["b"] == found[None] and found["b"][0] == 1
    again = {r.g: (r.ids, r.digest) for r in contracts.digest_tree(rows.orderBy(F.desc("id")).repartition(7), "id", "g", 16).collect()}
    assert found == again and contracts.digest_tree(rows.where("id <> '77'"), "id", "g", 16).where("g = 'a'").first().digest != found["a"][1]
    sliced = metrics.slices(rows, "g", "id", F.lit(True), F.lit(True), F.lit(True)).collect()
    assert {r.g: r.n for r in sliced} == {"a": 500, "b": 2, "c": 1, None: 1} and {r.g for r in sliced if r.ids_digest is None} == {"c"}


def test_contexts_keep_bars_and_signals_are_literal(spark):
    parts = ["CUSTOMER: a || CUSTOMER: b", "BRAND: x", "CUSTOMER: c\\| d\\", "CUSTOMER: e"]
    row = spark.createDataFrame([(parts,)], "p array<string>").select(tx.customer_parts(tx.joined_context(F.col("p"))).alias("x"), tx.signal_present(F.lit("a c++ b"), "c++").alias("y"), tx.signal_present(F.lit("axb"), "a.b").alias("z")).first()
    assert row.x == ["a || CUSTOMER: b", "c\\| d\\", "e"] and row.y and not row.z


def test_long_documents_are_compared(spark, tmp_path):
    rng = random.Random(7)
    texts = [say(rng, n) for n in (20, 700, 30, 900, 25, 600)]
    texts += [texts[1].replace(texts[1].split()[40], "other"), texts[3], texts[0]]
    item = " ".join(texts[5].split()[:500])
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    split, bags, own = list(RANK), [set(t.split()) for t in texts], [grams(t) for t in texts]
    pairs = [(a, b, round(jaccard(own[a], own[b]), 8), round(jaccard(bags[a], bags[b]), 8)) for a, b in combinations(range(9), 2) if a % 3 != b % 3]
    assert {tuple(r) for r in run("near_duplicate_pairs_whole")} == {(a, b, max(c, t)) for a, b, c, t in pairs if c >= 0.92 or t >= 0.9}
    assert {(a, b) for a, b, c, t in pairs if c >= 0.92} == {(1, 6), (3, 7), (0, 8)}
    assert {tuple(r) for r in run("decontaminate_near_whole")} == {(k, split[k % 3], k in (1, 7, 8)) for k in range(9)}
    asked = set(item.split())
    scored = sorted((-round(jaccard(bag, asked), 8), k) for k, bag in enumerate(bags) if bag & asked)[:3]
    assert [(r.doc_id, r.similarity) for r in sorted(run("benchmark_similarity"), key=lambda r: (-r.similarity, r.doc_id))] == [(k, -s) for s, k in scored] and scored[0][1] == 5


def test_audit_strata_take_no_thread_twice_and_name_what_is_missing(spark):
    from threadloom.operators import audits

    long = "we will do what we can to help you out"
    rows = [(f"m{r}{k}", "b", f"r{r}", 3 if r < 2 else 2, bool(k % 2), t) for r, texts in enumerate([(long, "x", "dm us"), (long, "y", "try a restart of it now please do it"), ("dm us", "z"), ("dm us", "w"), (long, "v")]) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "message_id string, brand string, root string, thread_size int, inbound boolean, text string")
    found = audits.audit_strata(frame, ["restart"], ["dm us"], "s", 1).collect()
    assert [r.category for r in found] == ["multi_turn", "high_public_containment", "generic_redirect", "repeated_template"] and len({r.root for r in found}) == 4
    with pytest.raises(ValueError, match="fewer than 3 threads of the category multi_turn"):
        audits.audit_strata(frame, ["restart"], ["dm us"], "s", 3)


def test_the_shared_folder_is_no_local_disk_of_a_cluster():
    from threadloom.functions.durable import shared

    assert shared("/x/warehouse", "local[8]") and shared("hdfs://n/x", "yarn") and not shared("file:/x", "yarn") and not shared("/x", "spark://h:1")


def test_pairs_that_differ_too_much_are_settled_where_they_meet(spark):
    """Parities reject pairs whose sets are too far apart, and never one that is alike; tokens alone may be what is alike."""
    rng = random.Random(11)
    bags = {0: {f"w{i}" for i in range(200)}, 1: {f"w{i}" for i in range(5, 203)}, 2: {f"v{i}" for i in range(200)}, 3: {f"w{i}" for i in range(40, 240)}}
    for i in range(4, 60):
        size, moved = rng.choice([1, 7, 180, 200]), rng.choice([0, 1, 6, 9, 30])
        bags[i] = {f"w{j}" for j in range(moved, size + moved)}
    sets = {i: (t, {f"{x}{k}" for x in t for k in range(4 if i % 5 else 3)}) for i, t in bags.items()}
    rows = spark.createDataFrame([(i, list(RANK)[i % 3], "X", sorted(t), sorted(g), "h") for i, (t, g) in sets.items()], "id bigint, split string, kind string, tokens array<string>, grams array<string>, h string")
    member = rows.select("*", F.size("tokens").alias("t"), F.size("grams").alias("n"), splits._parity("tokens", 256).alias("tp"), splits._parity("grams", 1024).alias("np"))
    found = {(r.a, r.b) for r in splits.proposed(member, 0.9, 0.92).collect()}
    alike = {(a, b) for a, b in combinations(sets, 2) if a % 3 != b % 3 and (jaccard(sets[a][0], sets[b][0]) >= 0.9 or jaccard(sets[a][1], sets[b][1]) >= 0.92)}
    assert alike <= found and (0, 1) in found and len(alike) > 20
    assert not {(0, 2), (1, 2), (1, 3), (2, 3)} & found


@pytest.mark.parametrize("most", [0, 3, 40, 10**6])
def test_weights_are_the_same_however_many_terms_are_sent_out(spark, most):
    """Frequent terms are weighed in a document's own row, the others are joined; lengths have all terms, also those that nobody asked for."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(900)]
    docs = {k: rng.sample(words, rng.choice([0, 1, 9, 30])) for k in range(60)}
    rows = [(k, " ".join(w)) for k, w in docs.items()] + [(7, "w1 w2 w2"), (60, None), (None, "w1 w3 w1")]
    docs[7], docs[None] = docs[7] + ["w1", "w2", "w2"], ["w1", "w3", "w1"]
    frame = spark.createDataFrame(rows, "id bigint, text string")
    bags = retrieval.counted(frame, "id", F.filter(F.split("text", " "), lambda w: w != ""))
    idf = retrieval.inverse_frequency(bags, frame, 2)
    df = {w: sum(w in own for own in docs.values()) for own in docs.values() for w in own}
    want = {}
    for k, own in docs.items():
        raw = {w: (1 + math.log(own.count(w))) * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w in own if df[w] >= 2}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        want |= {(k, w): x / norm for w, x in raw.items()}
    found = {(r.key, r.term): r.w for r in retrieval.weighted(bags, idf, most=most).collect()}
    assert found == pytest.approx(want, abs=1e-12) and len(want) > 200
    asked = spark.createDataFrame([("w1",), ("w3",), ("w40",), ("w1",), ("never",)], "term string")
    found = {(r.key, r.term): r.w for r in retrieval.weighted(bags, idf, only=asked, most=most).collect()}
    assert found == pytest.approx({k: x for k, x in want.items() if k[1] in ("w1", "w3", "w40")}, abs=1e-12)


def test_a_task_keeps_the_best_sets_whatever_the_parts(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    docs = {i: rng.sample(words, rng.choice([0, 1, 8, 20])) for i in range(90)} | {90: words[:1] + [f"v{i}" for i in range(511)]}
    items = {f"q{i}": rng.sample(words, rng.choice([0, 2, 9])) for i in range(20)} | {"one": words[:1]}
    frame = lambda x, c, t: spark.createDataFrame([*x.items(), (None if t == "string" else -1, None)], f"{c} {t}, ts array<string>")
    half = lambda a, b: math.floor(jaccard(set(a), set(b)) * 10**8 + 0.5) / 10**8
    want = {(q, d, s) for q, own in items.items() for s, d in [(-s, d) for s, d in sorted((-half(own, t), d) for d, t in docs.items() if set(own) & set(t))[:3]]}
    for entries in (10, 10**6):
        assert {(r.query, r.doc, r.similarity) for r in retrieval.set_top_k(frame(items, "query", "string"), frame(docs, "doc", "bigint").repartition(5), 3, entries).collect()} == want
    alone = retrieval.set_top_k(frame({"one": words[:1]}, "query", "string"), frame({90: docs[90]}, "doc", "bigint"), 3).collect()
    assert [r.similarity for r in alone] == [0.00195313] and "similarity#" in retrieval.set_top_k(frame({}, "query", "string"), frame(docs, "doc", "bigint"), 3)._jdf.queryExecution().toString()


def test_vectors_are_met_a_few_at_a_time_and_only_the_best_are_passed_on(spark):
    rng = np.random.default_rng(9)
    v = rng.integers(-2, 3, size=(80, 3)).astype(float) + 0.5
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(80, [float("nan"), 1.0, 1.0])], "doc int, v array<double>").repartition(3)
    asked = frame.where("doc % 9 = 0").select(F.col("doc").alias("query"), F.col("v").alias("q"))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    # What is no number comes first, as it does in SQL; equal ones come by document.
    want = {(i, j, k + 1) for i in range(0, 80, 9) for k, j in enumerate([80, *sorted((j for j in range(80) if j != i), key=lambda j: (-round(float(unit[i] @ unit[j]), 6), j))][:5])}
    for rows in (1, 7, 256):
        assert {(r.query, r.doc, r["rank"]) for r in retrieval.vector_top_k(asked, frame, 5, block=4, rows=rows).collect()} == want


def test_roots_send_no_table_of_ids_around(spark):
    from threadloom.operators import threads

    found = threads.roots(spark.createDataFrame([(str(k), str(k - 1) if k else None) for k in range(9)], "message_id string, parent_id string"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and {r.root for r in found.collect()} == {"0"}
