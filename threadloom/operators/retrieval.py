"""Relational TF-IDF, top-k retrieval with deterministic ties, hybrid ranking, and calibrated thresholds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from threadloom.functions import text as tx
from threadloom.functions.durable import spread, written
from threadloom.operators import vocabulary


#: So many terms, the most frequent ones, are sent to where documents are weighed; about 40 bytes each.
_SENT = 500_000


def counted(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """key, ts, tfs: each document's terms, each once, and how often it has them. They are counted in its own row, and written once."""
    rows = spread(docs, key).select(F.col(key).alias("key"), terms.alias("terms"))
    if not docs.groupBy(key).count().where("count > 1").isEmpty():  # rows of a key are one document
        rows = rows.groupBy("key").agg(F.flatten(F.collect_list(F.coalesce("terms", F.array().cast("array<string>")))).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vocabulary._cut(batches, 500):
            own, of, at, tf = vocabulary._met(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_lists(of, batch.num_rows, own.take(pa.array(at)), pa.array(tf.astype(np.int32)))], ["key", "ts", "tfs"])

    return written(rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ts array<string>, tfs array<int>"))


def _lists(of: np.ndarray, n: int, *values: pa.Array) -> list[pa.Array]:
    """Values as lists of n rows; ``of`` is each one's row, rising."""
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]), pa.int32())
    return [pa.ListArray.from_arrays(ends, v) for v in values]


def inverse_frequency(bags: DataFrame, docs: DataFrame, least_docs: int = 1) -> DataFrame:
    """term, idf of the terms that enough documents have."""
    df = bags.select(F.explode("ts").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_docs)
    n = docs.agg(F.count("*").alias("n"))
    return written(df.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))


def weighted(bags: DataFrame, idf: DataFrame, sublinear: bool = True, only: DataFrame | None = None, most: int = _SENT) -> DataFrame:
    """(key, term, w) with unit length per document, over the terms of ``idf``. With ``only`` (term) no others are returned; lengths still have all.

    The ``most`` frequent terms, nearly all that documents have, are sent out and weighed in a document's own row. Only what is left is joined by term,
    and comes back as a sum and the terms asked for.
    """
    idf = idf.withColumn("asked", F.lit(True)) if only is None else written(idf.join(only.select("term").distinct().withColumn("asked", F.lit(True)), "term", "left").withColumn("asked", F.coalesce("asked", F.lit(False))))
    sizes = idf.groupBy("idf").count().orderBy("idf").collect()  # a row for each number of documents that terms have
    sums = np.cumsum([r["count"] for r in sizes], dtype=np.int64)
    least = int(np.searchsorted(sums, most, "right"))  # terms as frequent as each other are sent, or not, together
    frequent = idf.where(F.col("idf") <= sizes[least - 1]["idf"] if least else F.lit(False)).toArrow()  # bounded by most
    shared = bags.sparkSession.sparkContext.broadcast((frequent["term"].combine_chunks(), frequent["idf"].to_numpy(), frequent["asked"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values, asked = shared.value
        for batch in vocabulary._cut(batches, 2000):
            n, ts, tf = batch.num_rows, batch.column(1).flatten(), batch.column(2).flatten().to_numpy()
            of, own = np.repeat(np.arange(n), batch.column(1).value_lengths().to_numpy()), ts.dictionary_encode()
            at = pc.fill_null(pc.index_in(own.dictionary, value_set=known), -1).to_numpy()[own.indices.to_numpy()]
            met = at >= 0
            raw = np.zeros(len(at))
            raw[met] = (1 + np.log(tf[met]) if sublinear else tf[met]) * values[at[met]]
            kept = met.copy()
            kept[met] = asked[at[met]]
            near = _lists(of[kept], n, ts.filter(pa.array(kept)), pa.array(raw[kept]))
            far = _lists(of[~met], n, ts.filter(pa.array(~met)), pa.array(tf[~met]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.bincount(of, raw * raw, minlength=n).astype(float)), *near, *far], ["key", "squares", "term", "raw", "ts", "tf"])

    rows = bags.mapInArrow(run, f"key {bags.schema['key'].dataType.simpleString()}, squares double, term array<string>, raw array<double>, ts array<string>, tf array<int>")
    v = F.arrays_zip("term", "raw")
    if least < len(sizes):
        rows = written(rows)
        rest = rows.select("key", F.inline(F.arrays_zip(F.col("ts").alias("term"), "tf"))).join(idf.hint("merge"), "term")  # a vocabulary has no bound
        rest = rest.withColumn("raw", (1 + F.log("tf") if sublinear else F.col("tf")) * F.col("idf"))
        far = rest.groupBy(F.col("key").alias("of")).agg(F.sum(F.col("raw") * F.col("raw")).alias("more"), F.collect_list(F.when(F.col("asked"), F.struct("term", "raw"))).alias("others"))
        rows = rows.join(far, F.col("key").eqNullSafe(F.col("of")), "left").withColumn("squares", F.col("squares") + F.coalesce("more", F.lit(0.0)))
        v = F.when(F.col("others").isNull(), v).otherwise(F.concat(v, "others"))
    return rows.select("key", F.sqrt("squares").alias("norm"), F.inline(v)).select("key", "term", (F.col("raw") / F.col("norm")).alias("w"))


def term_weights(docs: DataFrame, key: str, terms: Column, idf: DataFrame | None = None, least_docs: int = 1, sublinear: bool = True) -> tuple[DataFrame, DataFrame]:
    """(key, term, w) with unit length per document, and (term, idf). With ``idf`` given, terms outside it are dropped."""
    bags = counted(docs, key, terms)
    idf = inverse_frequency(bags, docs, least_docs) if idf is None else idf
    return weighted(bags, idf, sublinear), idf


def _best(scores: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best by falling score, then document."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= limit)  # with all ties at the limit
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((docs[kept], -scores[kept]))[:k]]


def _blocks(rows: DataFrame, key: str, size: int) -> list[DataFrame]:
    """``rows`` in parts of about ``size``, by a hash of the key, so that a part has a bound whatever the table's size."""
    rows = written(rows)
    parts = max(1, -(-rows.count() // size))
    return [rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p) for p in range(parts)]


def top_similar(queries: DataFrame, query: str, query_terms: Column, docs: DataFrame, doc: str, doc_terms: Column, k: int, least_docs: int = 1) -> DataFrame:
    """query, doc, similarity, rank: for each query the k documents with the highest cosine of unit term weights above 0."""
    bags = counted(docs, doc, doc_terms)
    idf = inverse_frequency(bags, docs, least_docs)
    asked = written(term_weights(queries, query, query_terms, idf)[0])
    return top_by_weights(asked, weighted(bags, idf, only=asked), k)


def top_by_weights(asked: DataFrame, weights: DataFrame, k: int, entries: int = 2_000_000, rows: int = 64, scored: Accumulator | None = None) -> DataFrame:
    """``top_similar`` for term weights (key, term, w) of queries and documents: the largest sums of products, if weights are
    positive.

    A blocked inverted index. Documents are dealt out, and sorted by their largest weight, so that blocks of ``rows`` documents are
    alike (the first are smaller, so that a task soon knows a k-th best); a block lists for each term its documents, and the largest weight. A query skips a block if its weights and the block's largest
    ones cannot reach the k-th best that the task has found so far. Else the terms that cannot reach it by themselves are left
    aside, postings of the others are added up, and only what the left-out terms could still lift is looked at further, until
    nothing is left or all terms are in. ``scored`` counts these pairs.

    Queries are sent out as sparse rows in parts of about ``entries`` weights, 24 bytes each: 48 MB. A task keeps k documents a query,
    and what is shuffled is k rows a query and task.
    """
    types = asked.schema["key"].dataType.simpleString(), weights.schema["key"].dataType.simpleString()
    asked = written(asked.select(F.col("key").alias("query"), "term", "w"))
    numbers = written(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    packed = spread(weights.join(numbers, "term"), "key").groupBy("key").agg(F.collect_list(F.struct("t", "w")).alias("v")).select("key", F.col("v.t").alias("ts"), F.col("v.w").alias("ws"))
    packed = written(packed.sortWithinPartitions(F.desc(F.array_max("ws"))))
    parts = _blocks(asked.join(numbers, "term").select("query", "t", "w"), "query", entries)
    return top_k(reduce(DataFrame.unionAll, [_searched(packed, part, k, rows, scored, *types) for part in parts]), k)


class _Part:
    """Some queries as sparse rows: names, sorted terms, and for each query a run of places among these and of weights."""

    def __init__(self, local: pa.Table) -> None:
        names, terms = local["query"].to_pylist(), local["t"].to_numpy()
        self.names = sorted(set(names))
        place = {q: i for i, q in enumerate(self.names)}
        self.terms, at = np.unique(terms, return_inverse=True)
        owner = np.array([place[q] for q in names], np.int64)
        order = np.argsort(owner, kind="stable")
        self.at, self.w = at[order].astype(np.int32), local["w"].to_numpy()[order]
        self.starts = np.searchsorted(owner[order], np.arange(len(self.names) + 1))


class _Block:
    """Postings of some documents by term, with the largest weight of each term."""

    def __init__(self, part: _Part, ts: np.ndarray, ws: np.ndarray, sizes: np.ndarray) -> None:
        at = np.searchsorted(part.terms, ts)
        known = at < len(part.terms)
        known[known] = part.terms[at[known]] == ts[known]
        docs, at, ws = np.repeat(np.arange(len(sizes)), sizes)[known], at[known], ws[known]
        order = np.argsort(at, kind="stable")
        self.n, self.docs, self.ws, at = len(sizes), docs[order], ws[order], at[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        self.begin, self.length, self.most = (np.zeros(len(part.terms), kind) for kind in (np.int64, np.int64, np.float64))
        if len(first):
            self.begin[at[first]], self.length[at[first]] = first, np.diff(first, append=len(at))
            self.most[at[first]] = np.maximum.reduceat(self.ws, first)

    def added(self, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the terms add to each document."""
        lengths = self.length[terms]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[terms] - (ends - lengths), lengths)
        return np.bincount(self.docs[places], np.repeat(w, lengths) * self.ws[places], self.n)


def _reached(block: _Block, terms: np.ndarray, w: np.ndarray, bounds: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a block whose sum may reach the limit, and all sums (exact for these)."""
    order = np.argsort(bounds)
    terms, w, rest = terms[order], w[order], np.cumsum(bounds[order])
    cut = int(np.searchsorted(rest, limit))  # the terms before cannot reach the limit by themselves
    sums = block.added(terms[cut:], w[cut:])
    while True:
        alive = np.flatnonzero(sums + (rest[cut - 1] if cut else 0.0) >= limit)
        if not cut or not len(alive):
            return alive, sums
        further = cut * 2 // 3 if cut > 4 else 0
        sums += block.added(terms[further:cut], w[further:cut])
        cut = further


def _searched(packed: DataFrame, part: DataFrame, k: int, rows: int, scored: Accumulator | None, query_type: str, doc_type: str) -> DataFrame:
    schema = pa.schema([("query", from_type(query_type)), ("doc", from_type(doc_type)), ("similarity", pa.float64())])
    shared = packed.sparkSession.sparkContext.broadcast(_Part(part.toArrow()))  # bounded: see top_by_weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: _Part = shared.value
        names, starts = queries.names, queries.starts
        found: list = [(np.zeros(0), None)] * len(names)
        limits = np.full(len(names), 1e-12)
        size = min(8, rows)
        for batch in batches:
            low = 0 if names else batch.num_rows
            while low < batch.num_rows:
                own = batch.slice(low, size)
                low, size = low + size, min(2 * size, rows)
                docs, sizes = np.asarray(own.column(0).to_pylist()), own.column(1).value_lengths().to_numpy()
                block = _Block(queries, own.column(1).flatten().to_numpy(), own.column(2).flatten().to_numpy(), sizes)
                bounds = queries.w * block.most[queries.at]
                most = np.add.reduceat(bounds, starts[:-1])
                for j in np.flatnonzero(most >= limits):
                    run_of = slice(starts[j], starts[j + 1])
                    met = np.flatnonzero(bounds[run_of])
                    alive, sums = _reached(block, queries.at[run_of][met], queries.w[run_of][met], bounds[run_of][met], limits[j])
                    if scored is not None:
                        scored.add(len(alive))
                    alive = alive[sums[alive] > 0]
                    if len(alive):
                        old, its = found[j]
                        values = np.concatenate([old, sums[alive]])
                        ids = docs[alive] if its is None else np.concatenate([its, docs[alive]])
                        kept = _best(np.round(values, 6), ids, k)
                        found[j] = values[kept], ids[kept]
                        if len(kept) == k:
                            limits[j] = max(round(float(values[kept[-1]]), 6) - 1e-6, 1e-12)  # ties are settled after rounding
        lengths = [len(values) for values, _ in found]
        ids = [d for _, own in found if own is not None for d in own.tolist()]
        columns = [[q for q, n in zip(names, lengths) for _ in range(n)], ids, np.concatenate([v for v, _ in found] or [np.zeros(0)])]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    found = packed.select("key", "ts", "ws").mapInArrow(run, f"query {query_type}, doc {doc_type}, similarity double")
    return found.withColumn("similarity", F.round("similarity", 6))


#: Terms that so many of a part's queries have are columns of a matrix; the others are met one by one. So many numbers the matrix has at most: 64 MB.
_COMMON, _NUMBERS = 0.1, 8_000_000


def top_by_products(asked: DataFrame, weights: DataFrame, k: int, kinds: tuple[str, ...] = ("",), entries: int = 2_000_000, rows: int = 128) -> DataFrame:
    """``top_by_weights`` for long rows that have much in common, where no bound leaves much out; and a column for each of ``kinds``, the share in the
    similarity of the terms that begin with it (the last one has all others; a kind without a name gets no column).

    All sums are made: a task multiplies the matrices of ``rows`` documents and of a part's queries over the terms that many of these queries have, and adds up
    products of the rest, a million at a time. Queries go out as sparse rows in parts of about ``entries`` weights. Documents are dealt out to as few
    tasks as keep all busy, as each passes on k documents a query.
    """
    types = asked.schema["key"].dataType.simpleString(), weights.schema["key"].dataType.simpleString()
    asked = written(asked.select(F.col("key").alias("query"), "term", "w"))
    kind = F.lit(len(kinds) - 1)
    for place, name in reversed(list(enumerate(kinds[:-1]))):
        kind = F.when(F.startswith("term", F.lit(name)), place).otherwise(kind)
    numbers = written(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id() * len(kinds) + kind))
    parts = _blocks(asked.join(numbers, "term").select("query", "t", "w"), "query", entries)
    slices = -(-4 * weights.sparkSession.sparkContext.defaultParallelism // len(parts))
    packed = weights.join(numbers, "term").repartition(slices, "key").groupBy("key").agg(F.collect_list(F.struct("t", "w")).alias("v")).select("key", F.col("v.t").alias("ts"), F.col("v.w").alias("ws"))
    packed = written(packed.sortWithinPartitions("key"))  # a slice is a file, and equal sums go by place
    found = reduce(DataFrame.unionAll, [_multiplied(packed, part, k, kinds, rows, *types) for part in parts])
    return top_k(found.withColumn("similarity", F.round("similarity", 6)), k)


class _Matrix:
    """Some queries: names, and their weights by term, either columns of a matrix (by kind) or postings."""

    def __init__(self, local: pa.Table, kinds: int) -> None:
        names = local["query"].combine_chunks().dictionary_encode()
        self.names, owner = names.dictionary, pc.fill_null(names.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = max(len(self.names), 1)
        self.terms, at, df = np.unique(local["t"].to_numpy(), return_inverse=True, return_counts=True)
        common = np.flatnonzero(df >= _COMMON * n)
        common = common[np.argsort(-df[common], kind="stable")][: _NUMBERS // n]
        common = common[np.argsort(self.terms[common] % kinds, kind="stable")]
        self.column = np.full(len(self.terms), -1)
        self.column[common] = np.arange(len(common))
        self.ends = np.searchsorted(self.terms[common] % kinds, np.arange(kinds + 1))
        w, in_matrix = local["w"].to_numpy(), self.column[at] >= 0
        self.places, self.values = owner[in_matrix] * len(common) + self.column[at[in_matrix]], w[in_matrix]
        order = np.argsort(at[~in_matrix], kind="stable")
        self.owner, self.w = owner[~in_matrix][order], w[~in_matrix][order]
        self.length = np.where(self.column < 0, df, 0)
        self.begin = np.cumsum(self.length) - self.length

    def dense(self) -> np.ndarray:
        out = np.zeros(len(self.names) * int(self.ends[-1]))
        out[self.places] = self.values
        return out.reshape(len(self.names), -1)

    def sums(self, dense: np.ndarray, of: np.ndarray, ts: np.ndarray, ws: np.ndarray, docs: int) -> np.ndarray:
        """By kind, query and document the sums of products; ``of`` is the document of each of these terms."""
        n, kinds = len(self.names), len(self.ends) - 1
        at = np.minimum(np.searchsorted(self.terms, ts), len(self.terms) - 1)
        known = self.terms[at] == ts
        of, at, ws = of[known], at[known], ws[known]
        column = self.column[at]
        x = np.zeros((docs, dense.shape[1]))
        x[of[column >= 0], column[column >= 0]] = ws[column >= 0]
        out = np.empty((kinds, n, docs))
        for j, (a, b) in enumerate(zip(self.ends[:-1], self.ends[1:])):
            np.matmul(dense[:, a:b], x[:, a:b].T, out=out[j])
        of, at, ws = of[column < 0], at[column < 0], ws[column < 0]
        many, first = self.length[at], (self.terms[at] % kinds * n) * docs + of
        done = np.cumsum(many)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(done, np.arange(1_000_000, done[-1] if len(done) else 0, 1_000_000)), [len(at)]]))
        flat = out.reshape(-1)
        for a, b in zip(cuts[:-1], cuts[1:]):
            times = many[a:b]
            places = np.arange(times.sum()) + np.repeat(self.begin[at[a:b]] - (np.cumsum(times) - times), times)
            flat += np.bincount(np.repeat(first[a:b], times) + self.owner[places] * docs, np.repeat(ws[a:b], times) * self.w[places], len(flat))
        return out


def _multiplied(packed: DataFrame, part: DataFrame, k: int, kinds: tuple[str, ...], rows: int, query_type: str, doc_type: str) -> DataFrame:
    named = [j for j, name in enumerate(kinds) if name]
    columns = ", ".join(f"`{kinds[j]}` double" for j in named)
    doc_arrow = from_type(doc_type)
    shared = packed.sparkSession.sparkContext.broadcast(_Matrix(part.toArrow(), len(kinds)))  # bounded: see top_by_products

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: _Matrix = shared.value
        n, low = len(queries.names), 0
        if not n:
            return
        dense = queries.dense()
        best, parts, ids = np.zeros((n, k), np.int64), np.zeros((len(kinds), n, k)), []
        for own in vocabulary._cut(batches, rows):
            sums = queries.sums(dense, vocabulary._spans(own.column(1)), own.column(1).flatten().to_numpy(), own.column(2).flatten().to_numpy(), own.num_rows)
            ids.append(own.column(0))
            total = sums.sum(0)
            ticks = np.rint(total * 1e6).astype(np.int64)
            if ticks.max() >= 2**34 or low + own.num_rows >= 2**28:
                raise ValueError("similarities of 17,179 and more, or 268,435,456 documents of one task, are too many")
            keys = np.where(total > 0, (ticks + 1 << 28) - 1 - (low + np.arange(own.num_rows)), 0)  # equal ones by document
            low += own.num_rows
            j = np.flatnonzero(keys.max(1) > best.min(1))
            if len(j):
                keys = np.concatenate([best[j], keys[j]], 1)
                at = np.argpartition(keys, keys.shape[1] - k, 1)[:, -k:]
                best[j] = np.take_along_axis(keys, at, 1)
                for p, s in zip(parts, sums):
                    p[j] = np.take_along_axis(np.concatenate([p[j], s[j]], 1), at, 1)
        if ids:
            of, at = np.nonzero(best)
            docs = pa.concat_arrays(ids).take(pa.array((1 << 28) - 1 - (best[of, at] & (1 << 28) - 1)))
            values = [parts[p, of, at] for p in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([queries.names.take(pa.array(of)), docs.cast(doc_arrow), pa.array(sum(values)), *(pa.array(values[p]) for p in named)], ["query", "doc", "similarity", *(kinds[p] for p in named)])

    return packed.select("key", "ts", "ws").mapInArrow(run, f"query {query_type}, doc {doc_type}, similarity double{', ' if named else ''}{columns}")


def from_type(name: str) -> pa.DataType:
    return to_arrow_type(_parse_datatype_string(name))


def word_runs(words: Column, n: int) -> Column:
    """Hashes (128 bits) of all runs of n words, each once."""
    runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.md5(F.array_join(F.slice(w, i, n), " ")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.array(words), runs)[0])


def top_k(scored: DataFrame, k: int, group: str = "query", score: str = "similarity", tie: str = "doc") -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def capped_templates(docs: DataFrame, template: str, key: str, cap: int) -> DataFrame:
    """At most ``cap`` rows of each template, by key; with template_frequency. Keys are unique.

    Counts are added up where the rows are, and only a part's first rows of a template are ordered with those of other parts: one very frequent
    template is no group of one task.
    """
    first = lambda rows, *by: rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("_rn") <= cap).drop("_rn")
    slim = docs.select(key, template).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    kept = first(first(slim, template, "_salt"), template).select(key, F.col(template).alias("_template"))
    counts = docs.groupBy(F.col(template).alias("_template")).agg(F.count("*").alias("template_frequency"))
    chosen = written(kept.join(counts, kept["_template"].eqNullSafe(counts["_template"])).select(key, "template_frequency"))
    return docs.join(chosen, key)


def hybrid(pool: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Ranks a pool (query, doc, and the components named in weights) by their weighted sum; template_penalty is subtracted."""
    total = sum((F.col(c) * w for c, w in weights.items() if c != "template_penalty"), F.lit(0.0)) - F.col("template_penalty") * weights.get("template_penalty", 0.0)
    scored = pool.withColumn("score", F.round(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)), 6))
    return top_k(scored, k, score="score")


def bounded_quantile(values: DataFrame, column: str, quantile: float, low: float, high: float) -> DataFrame:
    return values.agg(F.round(F.greatest(F.least(F.percentile(column, quantile), F.lit(high)), F.lit(low)), 6).alias("threshold"))


class _Kept:
    """The k best documents of each query so far, by score, then document; a score of -inf is none, and one of inf no number."""

    def __init__(self, n: int, k: int) -> None:
        self.best, self.ids = np.full((n, k), -np.inf), np.full((n, k), None, object)

    def meet(self, scores: np.ndarray, docs: list) -> None:
        """Scores of queries by documents."""
        k = self.best.shape[1]
        for j in np.flatnonzero((most := scores.max(1)) >= self.best[:, -1]):  # equal ones may come first by document
            if most[j] > -np.inf:
                new = np.flatnonzero((scores[j] >= self.best[j, -1]) & (scores[j] > -np.inf))
                found = sorted([*((-s, d) for s, d in zip(self.best[j].tolist(), self.ids[j]) if s > -np.inf), *((-scores[j, i], docs[i]) for i in new)])[:k]
                self.best[j, : len(found)], self.ids[j, : len(found)] = [-s for s, _ in found], [d for _, d in found]

    def rows(self, names: list, schema: pa.Schema) -> pa.RecordBatch:
        of, at = np.nonzero(self.best > -np.inf)
        values = np.where(np.isinf(self.best[of, at]), np.nan, self.best[of, at])
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip([[names[j] for j in of], self.ids[of, at].tolist(), values], schema)], schema=schema)


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096, rows: int = 256) -> DataFrame:
    """query, doc, similarity, rank: cosine top-k of query vectors (query, q) against all others (doc, v).

    Queries go out in blocks of about ``block`` vectors. Tasks multiply matrices of ``rows`` vectors and a block, 8 MB, and keep k documents a query,
    which are all that they pass on.
    """
    types = queries.schema["query"].dataType.simpleString(), vectors.schema["doc"].dataType.simpleString()
    schema = pa.schema([("query", from_type(types[0])), ("doc", from_type(types[1])), ("similarity", pa.float64())])

    def against(part: DataFrame) -> DataFrame:
        local = part.toArrow()
        names = local["query"].to_pylist()
        shared = vectors.sparkSession.sparkContext.broadcast((names, _units(_dense(local["q"].combine_chunks())) if names else np.zeros((0, 0))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            places: dict = {}
            for j, name in enumerate(names):
                places.setdefault(name, []).append(j)
            kept = _Kept(len(names), k)
            for batch in batches if names else ():
                for own in vocabulary._cut([batch], rows):
                    docs = own.column(0).to_pylist()
                    scores = np.round(q @ _units(_dense(own.column(1))).T, 6)
                    scores[np.isnan(scores)] = np.inf  # as they are ordered
                    for i, doc in enumerate(docs):
                        scores[places.get(doc, []), i] = -np.inf  # a query is not its own answer
                    kept.meet(scores, docs)
            yield kept.rows(names, schema)

        return vectors.select("doc", "v").mapInArrow(run, f"query {types[0]}, doc {types[1]}, similarity double")

    found = reduce(DataFrame.unionAll, [against(p) for p in _blocks(queries.select("query", "q"), "query", block)])
    return top_k(found.withColumn("similarity", F.round("similarity", 6)), k)


def set_top_k(queries: DataFrame, docs: DataFrame, k: int, entries: int = 2_000_000) -> DataFrame:
    """query, doc, similarity (of 8 digits), rank: for each set of terms (query, ts) the k sets (doc, ts) with the highest Jaccard similarity above 0.

    Queries go out as postings in parts of about ``entries`` terms. A task counts what some documents and a part's queries have in common, 16 MB at
    a time, and keeps k documents a query, so that no pair is shuffled or grouped.
    """
    types = queries.schema["query"].dataType.simpleString(), docs.schema["doc"].dataType.simpleString()
    schema = pa.schema([("query", from_type(types[0])), ("doc", from_type(types[1])), ("similarity", pa.float64())])
    docs = written(docs.select("doc", "ts"))

    def against(part: DataFrame) -> DataFrame:
        local = part.toArrow().combine_chunks()
        names, terms = (local[c].combine_chunks().dictionary_encode() if local.num_rows else None for c in ("query", "term"))
        order = np.argsort(terms.indices.to_numpy(), kind="stable") if names else np.zeros(0, int)
        postings = (names.dictionary.to_pylist(), terms.dictionary, names.indices.to_numpy()[order], np.bincount(terms.indices.to_numpy())) if names else ([], None, None, None)
        shared = docs.sparkSession.sparkContext.broadcast(postings)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, terms, owners, lengths = shared.value
            kept, n = _Kept(len(names), k), len(names)
            for own in vocabulary._cut(batches, max(1, min(256, 2_000_000 // n))) if n else ():
                ends, sizes, size = np.cumsum(lengths), np.bincount(owners, minlength=n), own.num_rows
                at = pc.fill_null(pc.index_in(own.column(1).flatten(), value_set=terms), -1).to_numpy()
                of, at = vocabulary._spans(own.column(1))[at >= 0], at[at >= 0]
                many = lengths[at]
                places = np.arange(many.sum()) + np.repeat(ends[at] - np.cumsum(many), many)
                same = np.bincount(owners[places] * size + np.repeat(of, many), minlength=n * size).reshape(n, size)
                all_of = pc.fill_null(pc.list_value_length(own.column(1)), 0).to_numpy()[None] + sizes[:, None] - same
                ticks = np.floor(same / np.maximum(all_of, 1) * 1e8 + 0.5 + 1e-6)  # half up, as Spark and SQL round; of sets below 500,000 no other is that near a half
                kept.meet(np.where(same > 0, ticks / 1e8, -np.inf), own.column(0).to_pylist())
            yield kept.rows(names, schema)

        return docs.mapInArrow(run, f"query {types[0]}, doc {types[1]}, similarity double")

    found = reduce(DataFrame.unionAll, [against(p) for p in _blocks(queries.select("query", F.explode("ts").alias("term")), "query", entries)])
    return top_k(found, k)


def _dense(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix, without an object for each number."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def char_terms(text: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams within words, each word between spaces."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.concat(*(F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in sizes))

    return F.flatten(F.transform(words, of))


def union_weights(parts: dict[str, tuple[DataFrame, float]], normalised: bool = True) -> DataFrame:
    """One vector (key, term, w) of several kinds of terms, each weighted, and of unit length if so asked."""
    both = reduce(DataFrame.unionAll, (w.select("key", F.concat(F.lit(f"{name}:"), "term").alias("term"), (F.col("w") * by).alias("w")) for name, (w, by) in parts.items()))
    if not normalised:
        return both
    both = written(both)
    norm = both.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return both.join(norm, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("w"))


def filled(top: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``top`` (query, doc, similarity, rank), where queries with fewer than k documents get further ones with 0, in order.

    ``queries`` has query, ``docs`` doc. The first 2 k documents are enough to fill any query, and are all that is sent around.
    """
    have = queries.join(top.groupBy("query").agg(F.count("*").alias("n")), "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    first = docs.orderBy("doc").limit(2 * k)
    extra = have.join(F.broadcast(first)).join(top.select("query", "doc"), ["query", "doc"], "left_anti")
    order = Window.partitionBy("query").orderBy("doc")
    extra = extra.withColumn("rank", (F.col("n") + F.row_number().over(order)).cast("bigint")).where(F.col("rank") <= k)
    return top.select("query", "doc", "similarity", "rank").unionByName(extra.select("query", "doc", F.lit(0.0).alias("similarity"), "rank"))


def reply_quality(text: Column, words: Column) -> Column:
    noise = F.when(text.rlike("<(?:url|email|mention|number)>"), 0.25).otherwise(0.0)
    return F.greatest(F.least(F.least(words / 24.0, F.lit(1.0)) - noise, F.lit(1.0)), F.lit(0.0))


def corpus(threads: DataFrame, least_words: int, private: list[str], cap: int) -> DataFrame:
    """Documents to retrieve from threads (key, customer_text, reply, intent, messages): those with a usable public reply, at most
    ``cap`` of each normalised reply, with reply_quality, context and template_frequency."""
    norm = tx.normalized_reply(tx.sanitize_public(F.col("reply")))
    usable = (tx.word_count(tx.normalized_reply(F.col("reply"))) >= least_words) & ~tx.any_contains(tx.normalized_reply(F.col("reply")), private)
    rows = threads.where(usable).withColumn("clean", tx.sanitize_public(F.col("reply"))).withColumn("template", F.sha2(norm, 256))
    kept = capped_templates(rows, "template", "key", cap)
    return kept.select("key", tx.clean_exploration(F.col("customer_text")).alias("text"), F.col("clean").alias("reply"), "intent", reply_quality(F.col("clean"), tx.word_count(F.col("clean"))).alias("reply_quality"), F.least(F.col("messages") / 4.0, F.lit(1.0)).alias("context"), "template_frequency")


def reply_terms(text: Column) -> Column:
    """Words of one and two."""
    words = F.regexp_extract_all(tx.clean_exploration(text), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.transform(F.array(words), with_pairs)[0]


def with_pairs(w: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)
