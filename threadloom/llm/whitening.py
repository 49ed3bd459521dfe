"""Whitening of embeddings: principal components scaled to unit variance, with a check of the result.

Entries c become the whole numbers floor(scale * c). A constant added to them (a million, say, to make them positive) cancels in every
result, so none is added and nothing is lost to rounding. Each partition of the first pass gives the count, the mean (as count
and exact sums) and the centred scatter of its vectors; ``treeReduce`` merges these by Chan's formula, so that covariances are never
differences of large sums. Eigenvectors of the covariance (its size is the square of the dimension) are computed on the driver. The
second pass merges the scatter of the whitened vectors in the same way and compares their covariance with the identity. The last
pass gives rows. Nothing that grows with the number of vectors reaches the driver.

Cases: null vectors and vectors with a null or non-finite entry are dropped; vectors of different dimensions are an error, and so are
entries that leave 53 bits; null and repeated ids stay, row by row; an empty table gives an empty result. A component whose
eigenvalue is zero but for rounding has no scale: its ``whitened`` is null, and it is left out of the check. A deviation that leaves
64 bits is null. Equal eigenvalues leave the choice of axes open. Columns beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import slim

_LONG = 1 << 63


@dataclass
class Moments:
    """Count, sums (exact for whole numbers) and centred scatter of some vectors."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        sums = x.sum(axis=0)
        centred = x - sums / len(x)
        return Moments(len(x), sums, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        """Chan's pairwise formula."""
        if not self.n or not other.n:
            return self if self.n else other
        if len(self.sums) != len(other.sums):
            raise ValueError(f"vectors of {len(self.sums)} and of {len(other.sums)} entries")
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


NOTHING = Moments(0, np.zeros(0), np.zeros((0, 0)))


def usable(frame: DataFrame) -> DataFrame:
    """Rows whose vector and whose entries are all finite numbers, as doubles."""
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return frame.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & finite)


def _matrix(batch: pa.RecordBatch, scale: float) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("vector"))
    sizes = column.value_lengths().to_numpy()
    if sizes.min() != sizes.max():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} entries")
    scaled = np.floor(column.flatten().to_numpy().reshape(len(sizes), -1) * scale)
    if scaled.size and np.abs(scaled).max() >= 2.0**52:
        raise ValueError("an entry leaves 53 bits")
    return scaled.astype(np.int64)


def moments(frame: DataFrame, matrix: Callable[[pa.RecordBatch], np.ndarray]) -> Moments:
    """The moments of what ``matrix`` makes of each batch: one row a partition, merged in a tree.

    Sums of whole numbers travel as such.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = NOTHING
        for batch in batches:
            if batch.num_rows:
                total = total.merged(Moments.of(matrix(batch)))
        if total.n:
            exact = total.sums.dtype.kind == "i"
            lists = {"whole": total.sums if exact else None, "real": None if exact else total.sums, "scatter": total.scatter.ravel()}
            kinds = {"whole": pa.int64(), "real": pa.float64(), "scatter": pa.float64()}
            yield pa.RecordBatch.from_pydict({"n": pa.array([total.n]), **{k: pa.array([v], pa.list_(kinds[k])) for k, v in lists.items()}})

    rows = frame.mapInArrow(run, "n bigint, whole array<bigint>, real array<double>, scatter array<double>").rdd
    own = rows.map(lambda r: Moments(r.n, np.array(r.real if r.whole is None else r.whole), np.array(r.scatter).reshape(len(r.real or r.whole), -1)))
    # A zero element, as an RDD may be empty.
    return own.union(frame.sparkSession.sparkContext.parallelize([NOTHING], 1)).treeReduce(lambda a, b: a.merged(b))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 32, scale: float = 64.0) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each usable vector and leading component."""
    frame = slim(vectors, vec_id=vec_id, vector=vector)
    kind = frame.schema["vec_id"].dataType.simpleString()
    frame = usable(frame)
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fitted = moments(frame, lambda batch: _matrix(batch, scale))
    n, d = fitted.n, len(fitted.sums)
    if not n or not d:
        return frame.sparkSession.createDataFrame([], schema)
    values, axes = np.linalg.eigh(fitted.scatter / n)
    order = np.argsort(-values, kind="stable")[:components]
    trace, top = float(np.trace(fitted.scatter)) / n, values[order]
    scaled = top > max(values.max(), 0.0) * d * np.finfo(float).eps * 8
    projection = axes[:, order] / np.sqrt(np.where(scaled, top, 1.0))
    sums, mean = fitted.sums, fitted.mean
    explained = np.maximum(top, 0.0) / trace if trace > 0 else np.zeros(len(top))

    def projected(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = _matrix(batch, scale)
        return x, (x - mean) @ projection

    check = moments(frame, lambda batch: projected(batch)[1])
    apart = np.abs(check.scatter / n - np.eye(len(order)))[np.ix_(scaled, scaled)]
    error = float(apart.max()) if apart.size else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, out = projected(part)
                k = len(order)
                ids = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(ids)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(ids), n)), _deviations(x, n, sums).take(pa.array(ids)),
                     pa.array(out.ravel(), mask=np.tile(~scaled, len(x))), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(ids), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return frame.mapInArrow(run, schema)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The exact sum of (n x - S)^2 over the entries of each vector; null where it leaves 64 bits."""
    widest = int(np.abs(x).max()) * n + int(np.abs(sums).max())
    if widest < _LONG:
        apart = n * x - sums
        if int(np.abs(apart).max()) ** 2 * x.shape[1] < _LONG:
            return pa.array((apart * apart).sum(axis=1))
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([e if e < _LONG else None for e in exact], pa.int64())
