"""Hand-calculated cases for parsing, threads, splits, metrics and contracts."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators import cohorts, contracts, gates, metrics, retrieval, sampling, splits, taxonomy, threads
from threadloom.sources import exports, stores
from threadloom.streaming import ingest

EXPORT = '''ID,Account_Id,is_customer,timestamp,Message,parent_id,child_tweet_id
500,shop,no,2020-05-01T08:00:00Z,"Welcome, how can we help?",,501
501,ann,yes,2020-05-01T08:05:00Z,"the lamp
flickers ""a lot""",500,"[502, 503, 504]"
502,shop,f,2020-05-01T08:06:00Z,Unplug it first.,501,
503,shop,f,2020-05-01T08:04:00Z,Sorry to hear.,501,none
504,ann,t,,thanks,501,509
600,ben,y,Fri May 01 09:00:00 +0000 2020,box arrived empty,601,
601,shop,n,2020-05-01T09:10:00Z,We will look.,602,600
602,ben,1,2020-05-01T09:20:00Z,still empty,600,"601,600"
700,cat,maybe,2020-05-02T08:00:00Z,hello,,
bad,dan,1,2020-05-02T08:00:00Z,lost,700,
501,ann,yes,2020-05-01T08:05:00Z,again,500,
701,eve,1,2020-05-02T08:30:00Z,two parents,"700,500",
'''


@pytest.fixture(scope="module")
def export(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("export") / "export.csv"
    path.write_text("\ufeff" + EXPORT, encoding="utf-8")
    parsed = exports.parse(exports.read_csv(spark, str(path)))
    return exports.ingest(parsed.withColumn("seq", F.monotonically_increasing_id()), "seq")


def test_ingest_keeps_the_first_row_and_counts_what_is_wrong(export):
    messages, counters = export
    c = counters.first()
    assert (c.rows, messages.count(), c.duplicates, c.timestamp_failures, c.malformed_ids, c.malformed_lineage, c.invalid_inbound) == (12, 10, 1, 1, 1, 1, 1)
    assert messages.where("message_id = '501'").first().text == 'the lamp\nflickers "a lot"'


def test_bytes_that_are_not_text_are_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"id,author,inbound,text,parent_id\n1,a,1,caf\xe9,\n")
    with pytest.raises(Exception, match="not UTF-8"):
        exports.read_csv(spark, str(tmp_path / "x.csv")).collect()


def test_roots_and_cycles(export):
    found = {r.node: (r.root, r.cyclic) for r in threads.roots(export[0]).collect()}
    assert {k: v for k, v in found.items() if k in ("501", "504", "600", "601", "602", "700", "701")} == {
        "501": ("500", False), "504": ("500", False), "600": ("600", True), "601": ("600", True), "602": ("600", True), "700": ("700", False), "701": ("701", False)
    }


def test_roots_of_a_long_chain_and_of_what_leads_into_a_cycle(spark):
    rows = [(str(k), str(k - 1) if k else None) for k in range(300)] + [("a", "b"), ("b", "c"), ("c", "b"), ("z", "a")]
    found = {r.node: r.root for r in threads.roots(spark.createDataFrame(rows, "message_id string, parent_id string")).collect()}
    assert {found[str(k)] for k in range(300)} == {"0"} and {found[k] for k in "abcz"} == {"b"}


def test_thread_quality(export):
    messages, refs = export[0], exports.child_references(export[0])
    q = threads.quality(messages, refs, threads.roots(messages), "created_at").first()
    assert (q.messages, q.threads, q.single_message, q.two_message, q.multi_turn, q.branching_threads, q.linked, q.orphans, q.self_references) == (10, 4, 2, 0, 2, 1, 7, 0, 0)
    assert (q.root_messages, q.child_references, q.missing_children, q.inconsistent_children, q.chronological_inconsistencies, q.cyclic_components) == (3, 8, 1, 1, 3, 1)
    assert [tuple(r) for r in threads.missing_children(messages, refs).collect()] == [("504", "509")]


@pytest.mark.parametrize(("raw", "expected"), [("TRUE", True), ("0", False), ("yes", True), ("", None), ("unknown", None)])
def test_inbound(spark, raw, expected):
    assert spark.range(1).select(tx.parse_inbound(F.lit(raw))).first()[0] is expected


def test_parsers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.id_values(F.lit('["6", "7", "oops"]'))) == ["6", "7"] and one(tx.id_malformed(F.lit('["6", "7", "oops"]'))) == ["oops"]
    assert one(tx.id_values(F.lit("[6, 7]"))) == ["6", "7"] and one(tx.id_values(F.lit("nan"))) == []
    assert one(tx.parse_parent(F.lit("6,7"))) is None and one(tx.parse_parent(F.lit("6"))) == "6"
    assert one(tx.normalized_reply(F.lit("  Hi @BrandOne  see https://example.test/help  "))) == "hi <mention> see <url>"
    assert one(tx.parse_timestamp(F.lit("Tue Oct 31 22:10:47 +0000 2017"))) is not None
    assert one(tx.parse_timestamp(F.lit("invalid-date"))) is None
    assert one(tx.duration_seconds(F.lit("1m2.5s"))) == 62.5 and one(tx.duration_seconds(F.lit("300ms"))) == pytest.approx(0.3)
    assert one(tx.char_ngrams(F.lit("abcdef"))) == ["abcde", "bcdef"] and one(tx.char_ngrams(F.lit("ab"))) == ["ab"] and one(tx.char_ngrams(F.lit(" "))) == []
    assert one(tx.sanitize_reply(F.lit("@a Try &amp; wait , see www.x.y /KT"))) == "Try & wait, see"
    assert one(tx.sanitize_reply(F.lit("Hey Maria! The lamp &lt;b&gt; is 12345678 fine."))) == "Hey! The lamp <b> is fine."
    assert one(tx.retry_seconds(F.lit("limit hit, try again in 2m3s"))) == 123 and one(tx.retry_seconds(F.lit("no"))) is None
    assert one(tx.wait_seconds(F.lit(3), F.lit(20.0))) == 20.5 and one(tx.wait_seconds(F.lit(30))) == 600
    assert one(tx.provider_message(F.lit("bad key: sk-12 at https://a.b/c"))) == "bad key <hidden> at <url>"


def test_missing_columns_are_named():
    with pytest.raises(exports.SchemaError, match="author_id"):
        exports.resolve(["tweet_id", "inbound", "text", "parent_id"])
    assert exports.resolve(["Text", "id", "message_id", "AUTHOR", "inbound", "parent_id"])["tweet_id"] == "message_id"


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a"), ("b", "a")], "gold string, pred string")
    cells = metrics.confusion(rows, ["a", "b"])
    o = metrics.overall(metrics.class_metrics(cells), cells).first()
    assert o.accuracy == 0.5 and o.macro_f1 == pytest.approx(1 / 3, abs=1e-6)
    a = metrics.action_metrics(spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "g boolean, p boolean"), F.col("g"), F.col("p")).first()
    assert (a.precision, a.recall, a.false_escalation, a.coverage) == (0.5, 0.5, 0.5, 0.5)
    ranked = spark.createDataFrame([(1, "a", 1), (2, "c", 1)], "query int, item string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "query int, item string")
    assert metrics.recall_mrr(ranked, relevant, 1).first().recall == 0.75
    c = metrics.calibration(spark.createDataFrame([(1, 0.8), (0, 0.3)], "y int, c double"), F.col("y"), F.col("c"), 2).first()
    assert c.brier == pytest.approx(0.065)


def test_agreement(spark):
    frame = lambda pairs: spark.createDataFrame(pairs, "x int, y int")
    r = metrics.agreement(frame([(1, 1), (2, 3), (3, 1), (5, 5)]), "x", "y").first()
    assert (r.exact, r.within_one) == (0.5, 0.75)
    assert metrics.agreement(frame([(1, 1), (2, 2), (3, 3)]), "x", "y").first().kappa == 1
    back = metrics.agreement(frame([(1, 3), (2, 2), (3, 1)]), "x", "y").first()
    assert back.kappa == -1 and back.spearman == -1
    assert metrics.agreement(frame([(2, 2), (2, 2)]), "x", "y").first().kappa == 1


def test_splits(spark):
    rows = spark.createDataFrame([(k, 100 - k) for k in range(20)], "id bigint, t bigint")
    found = {r.id: r.split for r in splits.temporal_split(rows, "t", "id").collect()}
    assert [sum(s == x for s in found.values()) for x in splits.SPLITS] == [14, 3, 3] and found[19] == "TRAIN" and found[0] == "GOLD"
    with pytest.raises(ValueError):
        splits.check_ratios((0.5, 0.4))
    keyed = spark.createDataFrame([("k1", "t", "TRAIN"), ("k1", "d", "DEVELOPMENT"), ("k2", "d", "DEVELOPMENT"), ("k2", "g", "GOLD"), ("k3", "h", "GOLD"), ("k3", "e", "DEVELOPMENT")], "key string, id string, split string")
    assert {r.id for r in splits.decontaminate_exact(keyed).where("dropped").collect()} == {"d", "h"}


def test_store_and_contracts(spark, tmp_path):
    store = stores.KeyedStore(spark, str(tmp_path / "store"), "k string, v int", "k")
    rows = lambda *v: spark.createDataFrame(v, "k string, v int")
    store.save(rows(("a", 1), ("b", 2)))
    store.save(rows(("a", 9), ("c", 3)))
    store.replace(rows(("b", 5), ("z", 0)))
    assert sorted(map(tuple, store.load().collect())) == [("a", 1), ("b", 5), ("c", 3)]
    assert store.progress(rows(("a", 0), ("q", 0))) == (1, 2)
    found = contracts.violations(rows(("a", 1), ("a", 2), ("b", None)), "k", {"SMALL": F.col("v") < 2})
    assert sorted(map(tuple, found.collect())) == [("a", "DUPLICATE_KEY"), ("a", "SMALL"), ("b", "SMALL")]
    assert stores.overlay({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}, "b": 1}


MARKERS = {"policy_claim": ["our policy"]}


def test_replies_cover_what_was_asked_and_are_verified(spark):
    cases = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(t).alias("reply")) for i, t in (("a", "Hi Bob! Which device do you have at home? Please restart the lamp and the switch."), ("b", "Try another wall socket for the lamp. Our policy says no refunds. And also wait a bit longer."))))
    build = lambda said: spark.range(1).select(gates.compose_covering(cases, F.lit(said), ["our policy"], ["restart", "try"]).alias("x")).first().x
    got = build("my android lamp is dark")
    assert got.reply == "Please restart the lamp and the switch." and got.evidence_ids == ["a"]
    got = build("dark lamp")
    assert got.reply == "Please restart the lamp and the switch. Which device do you have at home?" and got.evidence_ids == ["a"]
    check = lambda reply, ids, **k: spark.range(1).select(gates.verify(F.lit(reply), cases, F.array(*map(F.lit, ids)), F.lit("dark lamp"), MARKERS, **k).alias("x")).first().x
    assert check("restart the lamp", ["a"]) == ([], 1.0)
    assert check("our policy is https://a.b", ["z"]).codes == ["PII_LEAK", "UNSUPPORTED_POLICY_RISK", "INVALID_EVIDENCE_REFERENCE", "GROUNDING_FAILURE"]
    assert check("another wall socket", ["a"], referenced_only=True).codes == ["GROUNDING_FAILURE"]
    assert check("", []).codes == ["MISSING_EVIDENCE", "GROUNDING_FAILURE"]
    assert check("What is your device?", ["a"], check_answer=True).codes == ["GROUNDING_FAILURE"]


def test_vectors_and_terms_find_the_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5)).round(3)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc int, v array<double>").repartition(4)
    asked = frame.where("doc % 7 = 0").select(F.col("doc").alias("query"), F.col("v").alias("q"))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    expected = {(i, j, k + 1) for i in range(0, 60, 7) for k, j in enumerate([j for j in np.argsort(-(unit @ unit[i]), kind="stable") if j != i][:4])}
    assert {(r.query, r.doc, r["rank"]) for r in retrieval.vector_top_k(asked, frame, 4, block=3).collect()} == expected


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_store_refuses_a_version_that_another_writer_has(spark, tmp_path):
    store = stores.KeyedStore(spark, str(tmp_path / "s"), "k string, v int", "k")
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    store.save(rows)
    stale = stores.KeyedStore(spark, str(tmp_path / "s"), "k string, v int", "k")
    stale.version = lambda: 0  # what a writer sees that began earlier
    with pytest.raises(RuntimeError, match="written meanwhile"):
        stale._put(rows)
    assert store.load().count() == 1


def test_near_pairs_without_a_limit_stand_for_all_copies(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(k, text if k < 9 else text + " eleven" if k == 9 else "something else entirely here", ["TRAIN", "GOLD"][k % 2]) for k in range(11)]
    docs = spark.createDataFrame(rows, "id bigint, text string, split string")
    assert {r.rep for r in splits.copies(docs).collect()} == {0, 1, 9, 10}
    found = {(r.a, r.b) for r in splits.near_pairs(docs, threshold=0.8, most=None, token_threshold=0.9).collect()}
    assert found == {(0, 1), (0, 9)}
    assert {(r.a, r.b) for r in splits.near_pairs(docs, threshold=0.8, most=3).collect()} == set()


def test_guards_name_what_is_wrong(spark):
    rows = spark.createDataFrame([("a", [0.5, 0.5]), ("b", [0.9, 0.2])], "k string, p array<double>")
    assert [r.k for r in contracts.probability_sums(rows, "k", "p").collect()] == ["b"]
    assert contracts.keyed_once(rows, "k") is rows
    with pytest.raises(ValueError, match="'a' occurs 2"):
        contracts.keyed_once(rows.union(rows.where("k = 'a'")), "k")
    with pytest.raises(ValueError, match="protected k 'b'"):
        contracts.assert_disjoint(rows, rows.where("k = 'b'").select("k"), "k", "the sample")
    schema = contracts.result_schema({"score": "int", "codes": "array<string>"}, {"codes": ["A"]}, {"score": (1, 5)})
    assert schema["properties"] == {"score": {"type": "integer", "minimum": 1, "maximum": 5}, "codes": {"type": "array", "items": {"type": "string", "enum": ["A"]}, "uniqueItems": True}}
    with pytest.raises(ValueError, match="TRAIN"):
        taxonomy.from_document({"source_split": "GOLD", "default_intent": "a", "intents": [{"id": "a"}]})
    assert taxonomy.from_document({"source_split": "TRAIN", "default_intent": "a", "intents": [{"id": "a", "common_signals": ["x"]}]}).intents[0].signals == ("x",)
    with pytest.raises(ValueError, match="must be in the sample"):
        cohorts.development_sample(rows, F.lit(True), [F.col("k")], "k", "s", 1)
    with pytest.raises(ValueError, match="2 to 10 runs"):
        metrics.repeatability(spark.createDataFrame([("a", 1, 2)], "c string, r int, s int"), "c", "r", "s")
    one = spark.range(1).select(splits.later_split(F.lit("GOLD"), F.lit("TRAIN")).alias("x"), tx.split_context(F.lit("ab cd"), F.lit("ab")).alias("y")).first()
    assert (one.x, one.y) == ("GOLD", "cd")


def test_queries_with_few_neighbours_are_filled_up(spark):
    top = spark.createDataFrame([(1, 7, 0.5, 1), (2, 5, 0.4, 1), (2, 6, 0.3, 2), (2, 7, 0.2, 3)], "query int, doc int, similarity double, rank bigint")
    asks, docs = spark.createDataFrame([(1,), (2,), (3,)], "query int"), spark.createDataFrame([(5,), (6,), (7,), (8,)], "doc int")
    found = sorted(tuple(r) for r in retrieval.filled(top, asks, docs, 3).collect())
    assert [x for x in found if x[0] != 2] == [(1, 5, 0.0, 2), (1, 6, 0.0, 3), (1, 7, 0.5, 1), (3, 5, 0.0, 1), (3, 6, 0.0, 2), (3, 7, 0.0, 3)]
    assert one_gram(spark, "ab") == [" ab", "ab ", " ab "] and one_gram(spark, "a") == [" a "]


def one_gram(spark, text):
    return spark.range(1).select(retrieval.char_terms(F.lit(text))).first()[0]


def test_predictions_name_their_evidence(spark):
    rows = spark.createDataFrame([("a", "AUTO_HANDLE", "r", [("x", "1"), ("y", "2")], []), ("b", "ESCALATE", "r", [("x", "1")], []), ("c", "AUTO_HANDLE", "r", [("x", "1")], ["z"])], "case_id string, action string, reply string, cases array<struct<id:string,reply:string>>, evidence_ids array<string>")
    assert [(r.retrieved_ids, r.evidence_ids) for r in gates.prediction(rows).orderBy("case_id").collect()] == [(["x", "y"], ["x"]), (["x"], []), (["x"], ["z"])]


def test_streams_drop_repeats_and_count_by_window(spark, tmp_path):
    schema = "message_id string, brand string, created_at timestamp"
    spark.createDataFrame([("1", "a", "2020-01-01 00:01:00"), ("1", "a", "2020-01-01 00:01:00"), ("2", "a", "2020-01-01 00:15:00")], "message_id string, brand string, t string").selectExpr("message_id", "brand", "timestamp(t) AS created_at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = lambda df, name, mode: df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    run(ingest.deduplicated(stream), "seen", "append")
    assert sorted(r.message_id for r in spark.table("seen").collect()) == ["1", "2"]
    run(ingest.volume(stream), "volume", "update")
    assert sorted(r.messages for r in spark.table("volume").collect()) == [1, 2]


def test_paired_stores_and_configurations(spark, tmp_path):
    own = lambda name, kind: stores.KeyedStore(spark, str(tmp_path / name), f"k string, {kind}", "k")
    pair = stores.PairedStore(own("ratings", "v int"), own("notes", "n string"))
    rows = lambda v, s: spark.createDataFrame(v, s)
    pair.save(rows([("a", 1)], "k string, v int"), rows([("a", "fine")], "k string, n string"))
    with pytest.raises(ValueError, match="same keys"):
        pair.save(rows([("b", 1)], "k string, v int"), rows([("c", "x")], "k string, n string"))
    assert [tuple(r) for r in pair.load().collect()] == [("a", 1, "fine")]
    assert stores.profiling_config({"actionable_terms": ["try"], "generic_terms": ["dm us"]})["top_template_count"] == 5
    with pytest.raises(ValueError, match="generic_terms.*|.*positive"):
        stores.profiling_config({"actionable_terms": ["try"], "generic_terms": ["DM"], "top_template_count": 0})
    (tmp_path / "m.txt").write_text("x")
    made = stores.system_manifest(spark, {"b": 1.0, "a": 0.5}, str(tmp_path / "m.txt"))
    assert list(made["thresholds"]) == ["a", "b"] and made["files"] == {"m.txt": "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"}


def test_character_grams_of_a_long_text_take_one_walk(spark):
    words = " ".join(f"w{n}é" for n in range(25_000))
    rows = spark.createDataFrame([(words,), ("a😀b\ncd e",), ("abcd",), ("",)], "t string")
    began = time.time()
    found = [set(r["g"]) for r in rows.select(tx.char_ngrams(F.col("t")).alias("g")).collect()]
    assert time.time() - began < 30  # by places it took minutes
    flat = [words, "a😀b cd e", "abcd", ""]
    assert found == [{t[i : i + 5] for i in range(max(len(t) - 4, 1))} - {""} for t in flat]


def test_counts_by_groups_bound_the_similarity_of_sets(spark):
    draw = random.Random(1)
    sets = [(n, [f"g{draw.randrange(60)}" for _ in range(draw.randrange(80))]) for n in range(40)] + [(40, ["x"] * 2), (41, ["x"])]
    rows = spark.createDataFrame(sets, "id int, g array<string>").select("id", F.array_distinct("g").alias("g"))
    rows = rows.select("id", "g", F.size("g").alias("n"), splits._counts("g").alias("gc"))
    side = lambda s: rows.select(*(F.col(c).alias(f"{s}_{c}") for c in rows.columns))
    got = side("a").join(side("b"), F.col("a_id") <= F.col("b_id")).select("a_id", "b_id", splits._at_most("n", "gc").alias("most"), tx.jaccard(F.col("a_g"), F.col("b_g")).alias("true")).collect()
    assert len(got) == 42 * 43 // 2 and all(r["most"] >= r["true"] - 1e-12 for r in got)
    assert any(r["most"] < 0.5 for r in got)


def test_terms_are_counted_within_rows_that_are_dealt_out(spark):
    from threadloom.functions.durable import spread
    from threadloom.operators.vocabulary import select_terms

    draw = random.Random(2)
    said = [[draw.choice("abcdefgh") for _ in range(draw.randrange(12))] for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(said)), "id int, w array<string>").coalesce(1)
    assert spread(rows, "id").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    got = {r["term"]: r["df"] for r in select_terms(rows, "id", F.col("w"), 5, 2).collect()}
    tf = {w: sum(s.count(w) for s in said) for w in "abcdefgh"}
    assert got == {w: sum(w in s for s in said) for w in sorted(tf, key=lambda w: (-tf[w], w))[:5]}
