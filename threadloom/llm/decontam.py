"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

Every item gives windows of ``window`` consecutive words (one shorter window if the item is shorter). The windows are
the automaton's patterns; each document is normalised and scanned once, and matches are mapped back through word
numbers to code-point offsets of the original text.

The automaton is sent to the executors in blocks of about ``block_windows`` pairs of a window and an item that has it, so
that what is broadcast has a fixed bound whatever the benchmark's size, and however many items share a window. One block is
the usual case and needs no shuffle at all. With several, the documents are written once with row numbers, each block reads
their texts, and only rows that it hits are gathered by row number.

Cases: null texts and texts without words have no words and are never hit; null item ids hit words but are not listed;
repeated rows are scanned row by row; ids may have any type; texts of any length are scanned whole; empty tables give empty
results; columns beside the named ones are ignored, and those of ``keep`` may have any name but those of the result.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import held, map_rows, slim, written

#: Bytes of a word after lower-casing: digits, a-z and everything beyond ASCII. Other bytes separate words.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_FOUND = "n_words bigint, hits array<struct<n:bigint,start:bigint,end:bigint>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _pattern(words: list[bytes]) -> str:
    # One char a byte keeps the automaton's alphabet small; spaces at both ends keep matches on word boundaries.
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(pattern, item) for every window of every item."""

    def cut(batch: pa.RecordBatch) -> dict[str, object]:
        patterns, owners = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            for k in range(max(1, len(words) - window + 1) if words else 0):
                patterns.append(_pattern(words[k : k + window]))
                owners.append(item)
        return {"pattern": patterns, "item": owners}

    return map_rows(items, "pattern string, item string", cut)


def _automaton(pairs: list[tuple[str, str | None]]):
    import ahocorasick

    owners: dict[str, list[str]] = {}
    for pattern, item in pairs:
        owners.setdefault(pattern, []).extend(() if item is None else (item,))
    automaton = ahocorasick.Automaton()
    for pattern, own in owners.items():
        automaton.add_word(pattern, (pattern.count(" ") - 1, own))
    automaton.make_automaton()
    return automaton


def _scan(docs: DataFrame, pairs: list[tuple[str, str | None]], with_text: bool = False) -> DataFrame:
    """All columns, without ``text``, the first, if so asked, with n_words, hits (number and place of every hit word) and items."""
    shared, key, exist = docs.sparkSession.sparkContext.broadcast(pairs), f"automaton {uuid.uuid4().hex}", bool(pairs)
    first = 0 if with_text else 1
    names = docs.columns[first:]

    def scan(batch: pa.RecordBatch) -> dict[str, object]:
        automaton = held(key, lambda: _automaton(shared.value))
        out: dict[str, list] = {name: [] for name in ("n_words", "hits", "items")}
        for value in batch.column(0):
            text = value.as_py()
            words, hit, owners = words_of(text), set(), set()
            if words and exist:
                scanned, at, number = _pattern(words), 0, 0
                for end, (length, own) in automaton.iter(scanned):
                    number += scanned.count(" ", at, end + 1)
                    at = end + 1
                    hit.update(range(number - 1 - length, number - 1))
                    owners.update(own)
            places = [m.span() for m in _WORD.finditer(text)] if hit else []
            out["n_words"].append(len(words))
            out["hits"].append([{"n": n, "start": places[n][0], "end": places[n][1]} for n in sorted(hit)])
            out["items"].append(sorted(owners))
        return {name: batch.column(first + k) for k, name in enumerate(names)} | out

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema[first:])
    return map_rows(docs, kinds + _FOUND, scan)


def _merged(hits):
    """Places of runs of neighbouring hit words, from hits in order."""
    begins = F.filter(hits, lambda h, i: (i == 0) | (F.get(hits, i - 1)["n"] < h["n"] - 1))
    ends = F.filter(hits, lambda h, i: (i == F.size(hits) - 1) | (F.get(hits, i + 1)["n"] > h["n"] + 1))
    return F.transform(F.arrays_zip(begins["start"].alias("start"), ends["end"].alias("end")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_windows: int = 200_000,
    keep: list[str] | None = None,
) -> DataFrame:
    """For each document row: doc_id, n_words, n_hit, items (sorted ids), spans (start and end of each hit run, code points);
    with ``keep``, text and those columns as well."""
    names = keep or []
    windows = item_windows(slim(items, item=item_id, text=item_text).withColumn("item", F.col("item").cast("string")), window)
    pairs = written(windows.distinct())
    blocks = max(1, -(-pairs.count() // block_windows))
    frame = slim(docs, text=text, _id=doc_id, **{f"_{k}": n for k, n in enumerate(names)})
    if blocks == 1:
        found = _scan(frame, [(r.pattern, r.item) for r in pairs.collect()], keep is not None)
    else:
        frame = written(frame.withColumn("_row", F.monotonically_increasing_id()))
        block = F.pmod(F.xxhash64("pattern", "item"), F.lit(blocks))
        scanned = [_scan(frame.select("text", "_row"), [(r.pattern, r.item) for r in pairs.where(block == k).collect()]) for k in range(blocks)]
        hit = reduce(DataFrame.unionAll, [s.where("size(hits) > 0") for s in scanned]).groupBy("_row")
        hit = hit.agg(F.array_distinct(F.sort_array(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = _scan(frame, [], keep is not None).drop("hits", "items").join(hit, "_row", "left")
        found = found.withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<n:bigint,start:bigint,end:bigint>>"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    passed = [] if keep is None else ["text", *(F.col(f"_{k}").alias(n) for k, n in enumerate(names))]
    return found.select(F.col("_id").alias("doc_id"), *passed, "n_words", F.size("hits").cast("bigint").alias("n_hit"), "items", _merged(F.col("hits")).alias("spans"))
