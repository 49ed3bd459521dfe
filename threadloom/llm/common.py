"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.durable import written

__all__ = ["held", "map_rows", "read", "slim", "written"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], dict[str, object]], rows: int = 2000) -> DataFrame:
    """``mapInArrow`` for a function from one record batch to a dict of columns; it gets at most ``rows`` rows at a time, so that
    no more results than theirs are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_held()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    out = function(batch.slice(at, rows))
                    if out is not None:
                        yield pa.RecordBatch.from_pydict(out, schema=arrow)
        finally:
            drop_held_later()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


_held: dict[str, object] = {}
_lock = threading.RLock()
_timer: threading.Timer | None = None


def held(key: str, make: Callable[[], object]) -> object:
    """What this Python worker has made under ``key``. It holds one thing at a time, as workers outlive a query's stages."""
    with _lock:
        keep_held()
        if key not in _held:
            _drop()
            _held[key] = make()
        return _held[key]


def keep_held() -> None:
    """A task begins, or goes on: what is held stays."""
    global _timer
    with _lock:
        if _timer:
            _timer.cancel()
        _timer = None


def drop_held_later(seconds: float = 2.0) -> None:
    """A task has ended. If none follows in this worker soon, what it holds goes: idle workers would hold it beside later stages."""
    global _timer
    with _lock:
        keep_held()
        _timer = threading.Timer(seconds, lambda: _drop(own))
        own, _timer.daemon = _timer, True
        _timer.start()


def _drop(timer: threading.Timer | None = None) -> None:
    """Lets go of what is held, and gives the freed pages back where the C library can. A timer that is no longer the present one does nothing."""
    with _lock:
        if _held and timer in (None, _timer):
            _held.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)


def slim(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names, so that columns beside them cannot clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))
