"""URL filtering, alignment of tokenizers and whitening, against brute force and on edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import alignment, queries, url_filter, whitening

SMALL = "/root/testdata/sf0.001"
CLASH = "n int, component int, batch int, doc int, host int, rule int, tokens int, verdict int, a int, b int"


# Whitening


def brute_whitening(rows):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = np.array(x, float) - np.array(sums, float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:32]
    return [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x], centred @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def test_whitening_equals_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.orderBy("vec_id").collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    deviation, whitened, explained = brute_whitening(rows)
    found = defaultdict(dict)
    for r in queries.op13_whitening(spark, SMALL).collect():
        found[r.vec_id][r.component] = r
    assert len(found) == len(rows) and all(set(own) == set(range(1, 33)) for own in found.values())
    mine = np.array([[found[i][k].whitened for k in range(1, 33)] for i, _ in rows])
    signs = np.sign((mine * whitened).sum(axis=0))
    assert np.allclose(mine * signs, whitened, atol=1e-7)
    assert [found[i][1].deviation for i, _ in rows] == deviation
    assert np.allclose([found[rows[0][0]][k].explained for k in range(1, 33)], explained, rtol=1e-9)
    assert {r.n for own in found.values() for r in own.values()} == {len(rows)} and max(r.identity_error for own in found.values() for r in own.values()) < 1e-8


def test_whitening_takes_unusable_vectors_repeats_and_strange_tables(spark):
    nan, inf = float("nan"), float("inf")
    schema = f"vec_id string, embedding array<double>, {CLASH}"
    rows = [("a", [1.0, 2.0, 5.0]), ("a", [1.0, 2.0, 5.0]), (None, [3.0, -1.0, 5.0]), ("c", [0.5, 0.25, 5.0]), ("d", None), ("e", [1.0, None, 0.0]), ("f", [nan, 1.0, 1.0]), ("g", [inf, 1.0, 1.0])]
    frame = spark.createDataFrame([(*r, *[1] * 10) for r in rows], schema).repartition(3)
    found = whitening.whiten(frame).collect()
    assert Counter(r.vec_id for r in found) == {"a": 6, None: 3, "c": 3}
    assert all((r.whitened is None) == (r.component == 3) for r in found)  # two axes vary
    assert {r.n for r in found} == {4} and found[0].identity_error < 1e-9 and sum(r.explained for r in found if r.vec_id == "c") == pytest.approx(1)
    x = np.array([[64 + 10**6, 128 + 10**6]] * 2 + [[192 + 10**6, -64 + 10**6], [32 + 10**6, 16 + 10**6]])
    assert next(r.deviation for r in found if r.vec_id == "c") == int(((4 * x[3] - x.sum(axis=0)) ** 2).sum())
    assert whitening.whiten(frame.where("false")).collect() == [] and whitening.whiten(frame.where("vec_id = 'd'")).count() == 0
    one = whitening.whiten(frame.where("vec_id = 'c'")).collect()
    assert [(r.whitened, r.deviation, r.explained) for r in one] == [(None, 0, 0.0)] * 3
    with pytest.raises(Exception, match="entries"):
        whitening.whiten(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "vec_id string, embedding array<double>")).collect()


def test_moments_merge_in_any_order_and_wide_deviations_are_exact():
    x = np.random.default_rng(1).integers(-1_000, 1_000, (500, 5))
    parts = [whitening.Moments.of(x[lo : lo + 37]) for lo in range(0, 500, 37)]
    whole, total = whitening.Moments.of(x), whitening.NOTHING
    for p in reversed(parts):
        total = total.merged(p)
    assert total.n == 500 and (total.sums == whole.sums).all() and np.allclose(total.scatter, whole.scatter, rtol=1e-12)
    assert whitening._deviations(np.array([[10**6 + 10**5], [10**6]]), 10**4, np.array([10**10])).to_pylist() == [10**18, 0]
    assert whitening._deviations(np.array([[10**6 + 10**6], [10**6]]), 10**8, np.array([10**14])).to_pylist() == [None, 0]


# Alignment


def brute_alignment(texts):
    """By whole texts and the two libraries: rows of n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_file, b_file = queries.vocabularies()
    a, b = Tokenizer.from_str(a_file), SentencePieceProcessor(model_proto=b_file)
    a.encode_special_tokens = True
    byte_of = {}
    others = 256
    for k in range(256):
        if 33 <= k < 127 or 161 <= k < 173 or 174 <= k:
            byte_of[chr(k)] = k
        else:
            byte_of[chr(others)], others = k, others + 1
    found, links = [], Counter()
    for text in texts:
        row = ([], [], [], [])
        if text:
            own_a, own_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in own_a]
            pieces = [b.id_to_piece(i) for i in own_b]
            bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
                ends_a, ends_b = ends(bytes_a), ends(bytes_b)
                cuts = sorted(set(ends_a) & set(ends_b))
                groups, last = [], 0
                for cut in cuts:
                    groups.append(",".join(str(i) for i, e in zip(own_a, ends_a) if last < e <= cut) + "|" + ",".join(str(i) for i, e in zip(own_b, ends_b) if last < e <= cut))
                    last = cut
                pairs = [(own_a[ends_a.index(c)], own_b[ends_b.index(c)]) for c in cuts]
                links.update(pairs)
                row = (own_a, own_b, groups, pairs)
        found.append(row)
    best = defaultdict(int)
    for (_, j), c in links.items():
        best[j] = max(best[j], c)
    return [(len(x), len(y), len(g), len(p), sum(links[q] == best[q[1]] for q in p), sum(links[q] for q in p), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for x, y, g, p in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_brute_force_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_tokenizer_alignment(spark, SMALL).collect()}
    assert found == dict(zip((d.doc_id for d in docs), brute_alignment([d.text for d in docs])))


ODD = [None, "", " ", "  two  spaces ", "a\n\nb \t c", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ under ▁x", "ﬁ Ａ é e\u0301 日本語 🙂👩‍👩‍👧", "a\u00a0b\u2003c \u2003 d\x1c e\x85f", "don't 've 12 345", "x\u0000y", "\ufeffa", "same same same", "same same same", "z" * 3000 + " end"]


def test_alignment_of_odd_texts_small_batches_split_ids_and_repeats(spark):
    frame = spark.createDataFrame([(f"d{k}" if k else None, t, *[1] * 10) for k, t in enumerate(ODD)] + [("d12", ODD[12], *[1] * 10)], f"doc_id string, text string, {CLASH}").repartition(3)
    brute = brute_alignment([*ODD, ODD[12]])
    want = Counter((f"d{k}" if k else None, brute[k]) for k in range(len(ODD))) + Counter([("d12", brute[12])])
    small = alignment.align(frame, *queries.vocabularies(), batch_bytes=20, per_task=1)
    assert Counter((r.doc_id, tuple(r[c] for c in COLUMNS)) for r in small.collect()) == want
    assert sum(row[0] == 0 for _, row in want.elements()) == 3  # null, empty, and bytes lost
    texts = {r.doc_id: r.groups for r in alignment.groups(frame, *queries.vocabularies()).collect()}
    assert texts["d1"] == "" and hashlib.sha256(texts["d9"].encode()).hexdigest() == brute[9][-1]
    assert alignment.align(frame.where("false"), *queries.vocabularies()).collect() == []


def test_parts_give_the_tokens_of_whole_texts():
    one = alignment.Aligner(*queries.vocabularies())
    assert one.cuts
    whole = alignment.Aligner(*queries.vocabularies())
    whole.cuts = False
    texts = [t for t in ODD if t]
    flat = lambda found: [e and (sum(e[0]), sum(e[1]), "".join(e[2])) for e in found]
    assert flat(one.entries(texts)) == flat(whole.entries(texts)) == flat(one.entries(texts))


# URLs


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match("[^?#]*", rest[len(host) :]).group()


def test_listed_rules_equal_brute_force_over_all_pages(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    found = queries.op11_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(urls)
    for r in found:
        host, path = brute_url(urls[r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_hosts_paths_and_rules_of_odd_urls(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://A.Example.ORG/ES/x", "x://example.org/es/?q#f", "://org/en", "http://example.org?/es/", "http://notexample.org/es/", "http://a.b.com/fr/1", "http://com/de/", "http://é.org/ü#a://b", "http://a.com:80/de/", "http://EXAMPLE.org/en/12", "a://b://c", "http://x.org./"]
    frame = spark.createDataFrame([(None if k == 4 else k, u, *[1] * 10) for k, u in enumerate(urls)], f"page_id long, url string, {CLASH}")
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    none = spark.createDataFrame([], "page_id long, verdict string")
    found = {r.page_id: r for r in url_filter.judge(frame, rules, none).collect()}
    assert len(found) == len(urls)
    for k, u in enumerate(urls):
        r, (host, path) = found[None if k == 4 else k], brute_url(u)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, brute_rule(host, path)[0], brute_rule(host, path)[1] or "allow")
    assert url_filter.judge(frame.where("false"), rules.where("false"), none).count() == 0


def brute_mine(baskets, support, least, confidence, lift):
    """Every token set of every basket, counted."""
    from itertools import combinations

    sets, both, labels = Counter(), Counter(), Counter()
    for tokens, verdict in baskets:
        labels[verdict] += 1
        for size in range(1, len(tokens) + 1):
            for own in combinations(sorted(tokens), size):
                sets[own] += 1
                both[own, verdict] += 1
    n = len(baskets)
    found = {(own, v): (c / sets[own], c) for (own, v), c in both.items() if c >= max(support * n, least) and c / sets[own] >= confidence and c / sets[own] / (labels[v] / n) >= lift}
    return {k: x for k, x in found.items() if not any(v == k[1] and set(own) < set(k[0]) and y[0] >= x[0] for (own, v), y in found.items())}


def test_mined_rules_and_matches_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    urls, labels = [], []
    for k in range(400):
        host, lang, ext = rng.choice(["bets", "news", "farm", "wiki"]), rng.choice(["en", "de"]), rng.choice(["", ".html", "?ref=1"])
        urls.append(f"https://{host}.example.net/{lang}/{k}{ext}")
        labels.append("block" if (host == "bets" or (host == "farm" and lang == "de")) != (rng.random() < 0.05) else "allow")
    pages = url_filter.parsed(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    tokens = {r.page_id: r.tokens for r in pages.collect()}
    assert tokens[0][:3] == ["h1:net", "h2:example", f"h3:{urls[0][8:12]}"] and "p2:#" in " ".join(tokens[0])
    labelled = pages.join(spark.createDataFrame(list(enumerate(labels)), "page_id long, verdict string"), "page_id").where("page_id < 300")
    rules = url_filter.mine(labelled, support=0.02, least=10)
    found = {(tuple(r.antecedent), r.verdict): (pytest.approx(r.confidence), r.pages) for r in rules.collect()}
    want = brute_mine([(tokens[k], labels[k]) for k in range(300)], 0.02, 10, 0.6, 1.2)
    assert found == want and (("h3:bets",), "block") in found
    for r in url_filter.matched(pages, rules).collect():
        fits = [(-c, -n, " ".join(own), v) for (own, v), (c, n) in want.items() if set(own) <= set(r.tokens)]
        assert (r.mined, r.mined_verdict) == min(fits)[2:]
    judged = url_filter.judge(pages.select("page_id", "url"), spark.createDataFrame([], "host string, path string, verdict string"), labelled.select("page_id", "verdict"), support=0.02, least=10).collect()
    right = [(r.verdict == "block") == (urls[r.page_id][8:12] == "bets" or urls[r.page_id][8:].startswith("farm.example.net/de")) for r in judged if r.page_id >= 300]
    assert len(right) == 100 and sum(right) >= 95


def test_rules_are_mined_from_late_tokens_too(spark):
    """What tells pages apart is the twentieth token of a URL, after parts that no two pages share."""
    urls = [f"https://a.example/{'/'.join(f'{chr(97 + k // 26)}{chr(97 + k % 26)}x{chr(97 + j)}' for j in range(18))}?kind={'bad' if k % 2 else 'good'}" for k in range(200)]
    labelled = url_filter.parsed(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).withColumn("verdict", F.when(F.col("page_id") % 2 == 1, "block").otherwise("allow"))
    assert {(tuple(r.antecedent), r.verdict) for r in url_filter.mine(labelled).collect()} >= {(("q:kind=bad",), "block"), (("q:kind=good",), "allow")}
