"""Exact vocabularies of terms, and documents as sparse vectors over them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.durable import spread, written

#: Letters with marks and what they are without, by the canonical decomposition, up to the end of the extended Latin and Greek blocks.
_MARKED = {chr(c): d for c in range(0xC0, 0x2000) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)}


def without_accents(text: Column) -> Column:
    """Letters without their marks, whether these are part of a character or follow it."""
    return F.regexp_replace(F.translate(text, "".join(_MARKED), "".join(_MARKED.values())), r"\p{Mn}", "")


def _spans(lists: pa.Array) -> np.ndarray:
    """Of each value of the lists of a batch its row in the batch."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())


def _met(lists: pa.Array, sizes: tuple[int, ...] = ()) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a batch of lists, each once; and of each row and each term in it the row, the term's number and how often it occurs there. With ``sizes`` the
    lists hold words, and terms are their character n-grams of these sizes, each word between spaces: made once for each word of the batch."""
    units = lists.flatten().dictionary_encode()
    codes, most = pc.fill_null(units.indices, -1).to_numpy().astype(np.int64), max(len(units.dictionary), 1)
    each, tf = np.unique(_spans(lists)[codes >= 0] * most + codes[codes >= 0], return_counts=True)
    of, at = np.divmod(each, most)
    if not sizes:
        return units.dictionary, of, at, tf
    padded = [f" {w} " for w in units.dictionary.to_pylist()]
    grams = [[w[i : i + n] for n in sizes for i in range(len(w) - n + 1)] for w in padded]
    flat = pa.array([g for own in grams for g in own], pa.string()).dictionary_encode()
    numbers, lengths, most = flat.indices.to_numpy().astype(np.int64), np.array([len(own) for own in grams], np.int64), max(len(flat.dictionary), 1)
    times = lengths[at]
    place = np.repeat((np.cumsum(lengths) - lengths)[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    each, inverse = np.unique(np.repeat(of, times) * most + numbers[place], return_inverse=True)
    return flat.dictionary, *np.divmod(each, most), np.bincount(inverse, np.repeat(tf, times), len(each)).astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _counted(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...] = ()) -> Iterator[pa.RecordBatch]:
    """Of each term of a batch of lists how often it occurs and in how many lists, so that what is shuffled is a row for each term of a batch."""
    for batch in _cut(batches, 500 if sizes else 10_000):  # n-grams take more memory than words
        terms, _, at, tf = _met(batch.column(0), sizes)
        counts = np.bincount(at, tf, len(terms)).astype(np.int64), np.bincount(at, minlength=len(terms))
        yield pa.RecordBatch.from_arrays([terms, *map(pa.array, counts)], ["term", "tf", "df"])


def select_terms(docs: DataFrame, key: str, terms: Column, most_terms: int, least_docs: int = 1, most_share: float = 1.0, stop_words: list[str] | None = None, sizes: tuple[int, ...] = ()) -> DataFrame:
    """term, place (from 0, by term), df, idf: of documents with unique keys the terms in at least ``least_docs`` documents and at most a share ``most_share`` of them, of these the
    ``most_terms`` that occur most often in all, ties by term. The chosen terms, a bounded number, are the only rows that are ordered together. With ``sizes``, ``terms`` are words, and their character n-grams are counted."""
    each = spread(docs, key).select(terms.alias("terms")).mapInArrow(lambda batches: _counted(batches, sizes), "term string, tf bigint, df bigint")
    if stop_words:
        each = each.where(~F.col("term").isin(stop_words))
    counts = each.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    n = docs.agg(F.count("*").alias("docs"))
    fit = counts.join(F.broadcast(n)).where((F.col("df") >= least_docs) & (F.col("df") <= most_share * F.col("docs")))  # one row
    kept = fit.orderBy(F.desc("tf"), "term").limit(most_terms)
    idf = F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1
    return written(kept.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("place"), "df", idf.alias("idf")))


@dataclass(frozen=True)
class Kind:
    """One kind of terms: their column, the chosen ones, the length of a document's part of this kind, the place of its first term, and, if the column holds words
    and the terms are their character n-grams, the sizes of these."""

    terms: Column
    chosen: DataFrame
    weight: float = 1.0
    offset: int = 0
    sizes: tuple[int, ...] = ()


def packed(docs: DataFrame, key: str, kinds: list[Kind], keep: tuple[str, ...] = ()) -> DataFrame:
    """key, places (rising), ws, and the columns ``keep``, of every document: weights (1 + ln tf) idf of the chosen terms, each kind of unit length and then times its weight,
    at place + ``offset``; both are empty if it has none. A document's terms are met, counted and weighed in its own row: no term is shuffled."""
    known = [k.chosen.orderBy("place").select("term", "idf").toArrow() for k in kinds]  # as many rows as a vocabulary has
    shared = docs.sparkSession.sparkContext.broadcast([(t.column(0).combine_chunks(), t.column(1).to_numpy(), k.weight, k.offset, k.sizes) for t, k in zip(known, kinds)])

    many = len(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, 500):
            n, found = batch.num_rows, []
            for lists, (terms, idf, weight, offset, sizes) in zip(batch.columns[1:], shared.value):
                own, of, at, tf = _met(lists, sizes)
                at = pc.fill_null(pc.index_in(own, value_set=terms), -1).to_numpy()[at]
                of, tf, at = of[at >= 0], tf[at >= 0], at[at >= 0]
                raw = (1 + np.log(tf)) * idf[at]
                found.append((of, at + offset, raw / np.sqrt(np.bincount(of, raw * raw, minlength=n))[of] * weight))
            of, at, ws = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((at, of))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]), pa.int32())
            places, ws = (pa.ListArray.from_arrays(ends, pa.array(x[order], kind)) for x, kind in ((at, pa.int32()), (ws, pa.float64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), places, ws, *batch.columns[1 + many :]], ["key", "places", "ws", *keep])

    rows = spread(docs, key).select(F.col(key).alias("key"), *(k.terms.alias(f"terms{i}") for i, k in enumerate(kinds)), *keep)
    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, places array<int>, ws array<double>{kept}")


def as_vectors(rows: DataFrame, size: int, out: str = "features") -> DataFrame:
    """``rows`` (places, ws) with a sparse vector, for fitted models, which read them more than once: a table. It holds vectors as the type does, so none passes through Python."""
    vector = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("places").alias("indices"), F.col("ws").alias("values"))
    return written(rows.withColumn(out, vector), {out: VectorUDT()})
