"""The pipeline on a small data directory, against the stages' brute-force meaning."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from threadloom.llm import queries


def test_pipeline_keeps_clean_documents_and_drops_planted_ones(spark, tmp_path):
    say = lambda k, n=60: " ".join(f"the{(k * 31 + j * 7) % 997} of and thing{(j * k) % 89}" for j in range(n // 4))
    rows = [(k, say(k), "en", "s", 1) for k in range(1, 41)]
    bench = say(99)
    near = rows[4][1].replace("thing0", "thing1", 1)
    rows += [(50, rows[2][1], "en", "s", 1), (51, near, "en", "s", 1), (52, "12 34", "en", "s", 1), (53, None, "en", "s", 1), (54, "the start " + " ".join(bench.split()[:14]), "en", "s", 1), (55, say(77) + " bob@x.example.com", "en", "s", 1), (None, say(88), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == {*range(1, 41), 55, None}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=queries.ranks(), special_tokens={})
    text = say(77) + " <email>"
    ids = library.encode_ordinary(text)
    assert found[55].n_tokens == len(ids) and found[55].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert found[55].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_idle_workers_let_go_of_what_they_hold():
    """An idle worker's automaton or states would stay in memory beside stages that need no Python."""
    import time

    from threadloom.llm import common

    made = []
    thing = lambda: common.held("thing", lambda: made.append(1) or object())
    first = thing()
    common.drop_held_later(0.05)
    assert thing() is first  # a task that follows at once finds it
    time.sleep(0.2)
    assert thing() is first and len(made) == 1  # and keeps it, however long it takes
    common.drop_held_later(0.05)
    time.sleep(0.3)
    assert not common._held and thing() is not first
