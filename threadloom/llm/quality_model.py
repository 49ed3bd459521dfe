"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round, every feature in turn gets one shallow tree over its bins, fitted to the present
residuals; the trees of a feature add up to one lookup table. The pairs of features that explain most of what is left then
get tables of their own in the same way. Scoring is the sum of bin lookups, for whole batches at once.

The model is fitted on at most ``sample_rows`` labelled rows, chosen by a hash of the id; each is read whole. Ids with
contradicting labels are not learned from. Every document is scored, whole.

Cases: null and empty texts get the score of a text without words; with no labels to learn from, all scores are 0.5; null
ids are scored and not learned from; repeated rows are scored alike; ids may have any type; texts of any length are read whole;
ties between cuts go to the first; empty tables give empty results; columns beside the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import map_rows, slim

FEATURES = ["log_words", "word_length", "upper", "symbols", "exclaim", "bars", "digits", "repeats", "distinct", "dup_lines", "line_words", "stops", "short", "far"]
_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B))
_DIGITS = b"0123456789"
_ASCII = bytes(range(128))


def features(text: str | None) -> list[float]:
    """The features of one whole text."""
    text = text or ""
    words, data = text.split(), text.encode("utf-8", "surrogatepass")
    n, size = len(words), len(data)
    without = lambda some: size - len(data.translate(None, some))
    letters = without(_LETTERS)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    per = max(n, 1)
    distinct = set(words)
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / per,
        without(_UPPER) / max(letters, 1),
        without(b"#*$%&<>@^~") / per,
        text.count("!") / per,
        text.count("|") / per,
        without(_DIGITS) / max(size, 1),
        sum(map(eq, words, words[1:])) / per,
        len(distinct) / per,
        (len(lines) - len(set(lines))) / max(len(lines), 1),
        float(np.log1p(n / max(len(lines), 1))),
        without(b".,;:?") / per,
        sum(len(w) < 3 for w in words) / per,
        (size - without(_ASCII)) / max(size, 1),
    ]


@dataclass
class AdditiveModel:
    """``edges[f]`` are a feature's inner bin edges, ``tables[f]`` its values by bin; ``pairs`` likewise for two features."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edge, x[:, f], side="right")]
        for a, b, edge_a, edge_b, table in self.pairs:
            out += table[np.searchsorted(edge_a, x[:, a], side="right"), np.searchsorted(edge_b, x[:, b], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(column) else np.zeros(0)


def _cut(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best place to cut an ordered row of bins in two, and its gain."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    if len(g) < 2:
        return 0.0, 0
    left = g[:-1] ** 2 / (h[:-1] + ridge)
    right = (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
    gain = left + right - g[-1] ** 2 / (h[-1] + ridge)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A shallow tree over the bins of one feature: its value for every bin."""
    gain, at = _cut(grad, hess, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(grad), grad.sum() / (hess.sum() + ridge))
    return np.concatenate([_tree(grad[:at], hess[:at], depth - 1, ridge), _tree(grad[at:], hess[at:], depth - 1, ridge)])


def _pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """One cut of the first feature, then one of the second on either side; gain and values."""
    whole = grad.sum() ** 2 / (hess.sum() + ridge)
    best, out = 0.0, np.full(grad.shape, grad.sum() / (hess.sum() + ridge))
    for at in range(1, grad.shape[0]):
        value, gain = np.empty(grad.shape), -whole
        for side in (slice(None, at), slice(at, None)):
            g, h = grad[side].sum(0), hess[side].sum(0)
            _, cut = _cut(g, h, ridge)
            for part in (slice(None, cut), slice(cut, None)):
                gain += g[part].sum() ** 2 / (h[part].sum() + ridge)
                value[side, part] = g[part].sum() / (h[part].sum() + ridge)
        if gain > best:
            best, out = gain, value
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.15, bins: int = 32, pair_bins: int = 8, n_pairs: int = 6, ridge: float = 2.0) -> AdditiveModel:
    """Fits by cyclic boosting of the logistic loss."""
    if len(y) == 0:
        return AdditiveModel()
    mean = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(mean / (1 - mean))), [_edges(c, bins) for c in x.T])
    places = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    logit = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for place, table in zip(places, model.tables):
            grad, hess = slopes()
            step = rate * _tree(np.bincount(place, grad, len(table)), np.bincount(place, hess, len(table)), 2, ridge)
            table += step
            logit += step[place]
    coarse = [_edges(c, pair_bins) for c in x.T]
    spots = [np.searchsorted(e, c, side="right") for e, c in zip(coarse, x.T)]

    def binned(a: int, b: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int], np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        flat, (grad, hess) = spots[a] * shape[1] + spots[b], slopes()
        total = shape[0] * shape[1]
        return np.bincount(flat, grad, total).reshape(shape), np.bincount(flat, hess, total).reshape(shape), shape, flat

    gains = sorted(((_pair_tree(*binned(a, b)[:2], ridge)[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), key=lambda t: (-t[0], t[1:]))
    chosen = [(a, b) for _, a, b in gains[:n_pairs]]
    tables = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(rounds):
        for a, b in chosen:
            grad, hess, _, flat = binned(a, b)
            step = rate * _pair_tree(grad, hess, ridge)[1]
            tables[a, b] += step
            logit += step.ravel()[flat]
    model.pairs = [(a, b, coarse[a], coarse[b], tables[a, b]) for a, b in chosen]
    return model


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 8000) -> AdditiveModel:
    """Fits on at most ``sample_rows`` labelled ids that are not held out."""
    known = slim(labels, doc_id=doc_id, label=label).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    agreed = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    sample = agreed.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample_rows)
    joined = slim(docs, doc_id=doc_id, text=text).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        return {"doc_id": batch.column(0).cast(pa.string()), "label": batch.column(2).cast(pa.float64()), "x": [features(t) for t in batch.column(1).to_pylist()]}

    # One row an id, however often an id is repeated: what is collected stays bounded.
    found = map_rows(joined, "doc_id string, label double, x array<double>", run)
    rows = sorted(found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).collect())
    if not rows:
        return AdditiveModel()
    return fit(np.array([r.x for r in rows]), np.array([r.label for r in rows]))


def score(docs: DataFrame, model: AdditiveModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (how likely label 1 is) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        x = np.array([features(t) for t in batch.column(1).to_pylist()])
        return {"doc_id": batch.column(0), "score": shared.value.scores(x)}

    frame = slim(docs, doc_id=doc_id, text=text)
    return map_rows(frame, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, score double", run)
