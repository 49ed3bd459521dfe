"""Near-duplicate documents: one-permutation MinHash, optimal densification, banded buckets, star-shaped candidates.

A document's set holds its distinct word shingles. Equal sets are one class from the start, found by a fingerprint, and one
member stands for it. A single pass of hashing fills ``bins`` bins with their smallest shingle; an empty bin copies the bin
that its own pseudo-random order reaches first. ``bins / rows`` bands of bins give the bucket keys.

Candidates of a bucket are a star: its centre with every other member. The centre is the member whose buckets are fullest,
so that of a text and its edited copies the text itself is taken. Links are confirmed on full sets, and components are found
by alternating stars.

What the stars leave open is settled exactly. Take a star with centre c and two members x and y of different components, x
not alike with c. Let D be the difference between a member's set and c's. Then x and y can only be alike if their differences
share more than (share * extra(y) + missing(y)) / (1 + share) elements: sharing none, y could not be closer to x than c is.
A prefix of each difference, extra shingles first, therefore meets that of every partner, and the number of elements behind
the meeting place bounds the overlap. Independent edits make differences that share next to nothing, so a group of edited
copies costs a star and not its square, while no link between documents that share a bucket is lost.

Two documents at the threshold share no bucket with a probability of (1 - similarity ** rows) ** (bins / rows): 6e-9 for a
similarity of 0.85, 5e-6 for 0.8.

Cases: null and empty texts have empty sets and are linked with nothing; rows with a null id are linked with nothing and
kept; rows that share an id are one node; ties between centres go to the smallest id; texts of any length are read whole;
an empty table gives an empty result; columns beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import map_rows, slim, written
from threadloom.llm.components import components
from threadloom.llm.shingles import mixed, shingle_set


def _orders(bins: int) -> np.ndarray:
    """For every bin its pseudo-random order of all bins."""
    n = np.arange(bins, dtype=np.uint64)
    return np.argsort(mixed(mixed(n)[:, None] + n[None, :] * np.uint64(0x9E3779B97F4A7C15)), axis=1)


def signature(shingles: np.ndarray, bins: int, orders: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a non-empty sorted set."""
    edges = np.array([(k << 64) // bins for k in range(bins)], np.uint64)
    first = np.searchsorted(shingles, edges)
    filled = first < np.append(first[1:], len(shingles))
    source = np.arange(bins)
    empty = ~filled
    if empty.any():
        own = orders[empty]
        source[empty] = own[np.arange(len(own)), filled[own].argmax(1)]
    return shingles[first[source]]


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One key for every band of ``rows`` bins."""
    parts = values.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64)
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, shingle: int, bins: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, print (fingerprint of the set, null if empty) and bands of every row."""
    orders = _orders(bins)

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        sizes, prints, bands = [], [], []
        for text in batch.column(1).to_pylist():
            own = shingle_set(text, shingle)
            sizes.append(len(own))
            prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            bands.append(band_keys(signature(own, bins, orders), rows) if len(own) else [])
        return {"doc_id": batch.column(0), "n_shingles": sizes, "print": prints, "bands": bands}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, f"doc_id {kind}, n_shingles bigint, print binary, bands array<bigint>", run)


def stars(member: DataFrame) -> DataFrame:
    """(rep, node) from rows (node, key): the centre of each bucket with every other member, each pair once."""
    sizes = written(member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    shared = written(member.join(sizes, "key"))  # only what shares a bucket goes on
    ranks = written(shared.groupBy("node").agg(F.sum("size").alias("rank")))
    ranked = shared.join(ranks, "node")
    best = written(ranked.groupBy("key").agg(F.min(F.struct((-F.col("rank")).alias("rank"), "node")).alias("best")).select("key", F.col("best.node").alias("rep")))
    return shared.join(best, "key").where("node <> rep").select("rep", "node").distinct()


def _with_texts(pairs: DataFrame, texts: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with left_text and right_text. Rows of one ``left`` stand together, so that its text is cut up once."""
    first = pairs.join(texts.select(F.col("doc_id").alias(right), F.col("text").alias("right_text")), right)
    return first.join(texts.select(F.col("doc_id").alias(left), F.col("text").alias("left_text")), left)


class _Sets:
    """Shingle sets of the left texts, of which the last is kept."""

    def __init__(self, size: int) -> None:
        self.size, self.text, self.own = size, None, np.zeros(0, np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        if text != self.text:
            self.text, self.own = text, shingle_set(text, self.size)
        return self.own


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, share: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= share * union."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        keep, sets = [], _Sets(shingle)
        for left, right in zip(batch.column(2), batch.column(3)):
            x, y = sets.of(left.as_py()), shingle_set(right.as_py(), shingle)
            same = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(bool(len(x)) and 100 * same >= share * (len(x) + len(y) - same))
        mask = pa.array(keep)
        return {"a": batch.column(0).filter(mask), "b": batch.column(1).filter(mask)}

    return map_rows(_with_texts(pairs, texts, "a", "b").select("a", "b", "left_text", "right_text"), f"a {kind}, b {kind}", run)


def differences(members: DataFrame, texts: DataFrame, shingle: int, share: int) -> DataFrame:
    """For rows (rep, node, own, far): rep, node, own, size of the difference, need, lack, and its prefixes.

    ``grams`` is the longer of two prefixes. The first ``first`` elements meet a partner as a member that is not alike with
    the centre (``far``), the first ``second`` as any other. A pair must share (need of the one + lack of the other) / (100 +
    share) elements, where lack is by how much a far member fails to be alike with the centre.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {n: [] for n in ("size", "need", "lack", "first", "second", "grams")}
        sets = _Sets(shingle)
        for far, left, right in zip(batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
            c, x = sets.of(left.as_py()), shingle_set(right.as_py(), shingle)
            extra, missing = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
            size = len(extra) + len(missing)
            need = share * len(extra) + 100 * len(missing)
            lack = need - (100 - share) * len(c)  # above 0 if far
            first = max(0, size - -(-lack // 100) + 1) if far else 0
            second = max(0, size - need // (100 + share))
            out["size"].append(size)
            out["need"].append(need)
            out["lack"].append(lack)
            out["first"].append(first)
            out["second"].append(second)
            out["grams"].append(np.concatenate([extra, missing])[: max(first, second)].view(np.int64))
        return {name: batch.column(k) for k, name in enumerate(("rep", "node", "own"))} | out

    joined = _with_texts(members, texts, "rep", "node").select("rep", "node", "own", "far", "left_text", "right_text")
    return map_rows(joined, f"rep {kind}, node {kind}, own {kind}, size bigint, need bigint, lack bigint, first int, second int, grams array<bigint>", run)


def across(found: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) of different components that could be alike, from ``differences``: none that is alike is left out."""
    spread = lambda prefix, *more: found.where(f"{prefix} > 0").select("rep", "node", "own", *more, "size", F.posexplode(F.slice("grams", 1, F.col(prefix))).alias("at", "gram"))
    x = spread("first", "lack").select("rep", "gram", "node", "own", "lack", (F.col("size") - F.col("at")).alias("left"))
    y = spread("second", "need").select("rep", "gram", F.col("node").alias("other"), F.col("own").alias("other_own"), "need", (F.col("size") - F.col("at")).alias("other_left"))
    bound = f"own <> other_own AND {100 + share} * least(left, other_left) >= need + lack"
    return x.join(y, ["rep", "gram"]).where(bound).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    share: int = 80,
    bins: int = 240,
    rows: int = 6,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; ``share`` is the least similarity in hundredths."""
    frame = slim(docs, doc_id=doc_id, text=text)
    base = written(sketches(frame, shingle, bins, rows))
    usable = base.where(F.col("doc_id").isNotNull() & F.col("print").isNotNull())
    classes = written(usable.groupBy("print").agg(F.min("doc_id").alias("node")))
    nodes = usable.join(classes, "print").where("doc_id = node")
    # Written, so that the joins with a star's many members meet plain exchanges, which can be split.
    sizes = written(nodes.groupBy("node").agg(F.min("n_shingles").alias("least_n"), F.max("n_shingles").alias("most_n")))
    star = stars(nodes.select("node", F.explode("bands").alias("key")).distinct())
    star = written(star.join(sizes, "node").join(sizes.select(F.col("node").alias("rep"), F.col("least_n").alias("rep_least"), F.col("most_n").alias("rep_most")), "rep"))
    near = F.expr(f"100 * most_n >= {share} * rep_least AND 100 * rep_most >= {share} * least_n")
    tried = star.where(near).select(F.col("rep").alias("a"), F.col("node").alias("b"))
    used = written(star.select(F.col("rep").alias("doc_id")).union(star.select("node")).distinct())
    texts = written(frame.join(used, "doc_id"))
    links = written(confirmed(tried, texts, shingle, share))
    found = components(links)
    ours = found.select(F.col("node").alias("rep"), F.col("component").alias("rep_own"))
    placed = star.select("rep", "node").join(found, "node", "left").join(ours, "rep", "left")
    placed = placed.select("rep", "node", F.coalesce("component", "node").alias("own"), F.coalesce("rep_own", "rep").alias("rep_own"))
    placed = written(placed.withColumn("far", F.col("own") != F.col("rep_own")))
    unsettled = written(placed.where("far").select("rep").distinct())
    if not unsettled.isEmpty():
        open_members = placed.join(unsettled, "rep").select("rep", "node", "own", "far")
        fresh = written(across(written(differences(open_members, texts, shingle, share)), share))
        new = written(confirmed(fresh, texts, shingle, share))
        if not new.isEmpty():
            found = components(links.unionByName(new))
    result = base.select("doc_id", "n_shingles", "print").join(classes, "print", "left").join(found, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
