"""Removal of word windows that also start in a document with a smaller id, found by difference-cover anchors.

Cover positions are those whose remainder modulo ``period`` lies in a difference cover. For any two windows with the same
words some shift below the period puts both on cover positions, so hashing ``window - period + 1`` words at cover positions
alone finds every repeated window. An anchor is shared if two different texts have it. A window can only repeat if one of
the cover positions in its first ``period`` places holds a shared anchor; these windows are extended to their full length,
hashed (95 bits), and removed if the smallest document with the same hash is smaller. Whole-text copies are settled by a 128-bit
hash of the text first, and take no part in the rest.

Every grouping is an aggregate with partial sums; joins on windows and anchors meet plain exchanges, so that they are split
when skewed; texts are dealt out by id.

Cases: null texts have no words; rows with a null id are kept whole and remove nothing; rows that share an id do not affect
each other; repeated rows are handled alike; of equal windows that with the smallest id stays; texts of any length are read
whole; an empty table gives an empty result; columns beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import map_rows, slim, written
from threadloom.llm.shingles import hashes, split, windows

#: Perfect difference sets, by period.
COVERS = {1: (0,), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors two fifths of a window."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= max(3, 2 * window // 5))
    return period, COVERS[period]


def _places(n: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """The cover positions below ``n``."""
    places = (np.arange(-(-n // period))[:, None] * period + np.array(cover)[None, :]).ravel()
    return places[places < n]


def _print(words: list[bytes]) -> tuple[int, int]:
    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _hashed(frame: DataFrame, kind: str, window: int, anchors: bool) -> DataFrame:
    """doc_id, p and q (hash of the words), and with ``anchors`` the anchors' hashes, of texts with a whole window."""
    period, cover = cover_for(window)
    size = window - period + 1

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {"doc_id": [], "p": [], "q": [], "anchors": []}
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = split(text)
            if len(words) < window or number is None:
                continue
            p, q = _print(words)
            out["doc_id"].append(number)
            out["p"].append(p)
            out["q"].append(q)
            own = windows(hashes().of(words), size) if anchors else np.zeros(0, np.uint64)
            out["anchors"].append(own[_places(len(own), period, cover)].view(np.int64))
        return out

    return map_rows(frame, f"doc_id {kind}, p bigint, q bigint, anchors array<bigint>", run)


def _repeats(joined: DataFrame, kind: str, window: int) -> DataFrame:
    """doc_id, p, start, h, g: the windows that may repeat, from doc_id, text, p, ks (numbers of shared anchors)."""
    period, cover = cover_for(window)
    size = window - period + 1

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {"doc_id": [], "p": [], "starts": [], "h": [], "g": []}
        for number, text, p, ks in zip(*(batch.column(k).to_pylist() for k in range(4))):
            words = split(text)
            if _print(words)[0] != p:  # another row with this id
                continue
            n = len(words)
            places = _places(n - size + 1, period, cover)
            flags = np.zeros(len(places) + 1, np.int64)
            flags[np.array(ks) + 1] = 1
            found, rank = np.cumsum(flags), np.searchsorted(places, np.arange(n - window + period + 1))
            starts = np.flatnonzero(found[rank[period:]] > found[rank[:-period]])
            if not len(starts):
                continue
            own = hashes().of(words)
            out["doc_id"].append(number)
            out["p"].append(p)
            out["starts"].append(starts.astype(np.int32))
            out["h"].append(windows(own, window)[starts].view(np.int64))
            out["g"].append((windows(own, window, 0xC2B2AE3D27D4EB4F)[starts] >> np.uint64(33)).astype(np.int32))
        return out

    found = map_rows(joined, f"doc_id {kind}, p bigint, starts array<int>, h array<bigint>, g array<int>", run)
    return found.select("doc_id", "p", F.inline(F.arrays_zip("starts", "h", "g"))).withColumnRenamed("starts", "start")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the other words, joined by one space) and removed (runs of word numbers) of every row."""
    frame = slim(docs, doc_id=doc_id, text=text)
    kind = frame.schema["doc_id"].dataType.simpleString()
    base = written(_hashed(frame, kind, window, False).select("doc_id", "p", "q"))
    owners = base.groupBy("p", "q").agg(F.min("doc_id").alias("owner"))
    copies = base.join(owners, ["p", "q"]).where("doc_id > owner").select("doc_id", "p")

    anchors = _hashed(frame, kind, window, True).select("p", F.posexplode("anchors").alias("k", "anchor"))
    shared = written(anchors.groupBy("anchor").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).where("lo < hi").select("anchor"))
    hits = anchors.join(shared, "anchor").groupBy("p", "k").agg(F.lit(1).alias("one")).groupBy("p").agg(F.collect_list("k").alias("ks"))
    marked = written(hits.join(owners.select("p", F.col("owner").alias("doc_id")), "p").select("doc_id", "p", "ks"))

    repeats = _repeats(frame.join(marked, "doc_id").select("doc_id", "text", "p", "ks"), kind, window)
    # Written, so that the join meets two plain exchanges, of which a hot window's can be split.
    first = written(repeats.groupBy("h", "g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "g", "lo"))
    later = repeats.join(first, ["h", "g"]).where("doc_id > lo").groupBy("doc_id", "p").agg(F.collect_set("start").alias("starts"))
    removal = later.unionByName(copies.distinct().withColumn("starts", F.lit(None).cast("array<int>")))
    removal = removal.groupBy("doc_id").agg(F.collect_list(F.struct("p", "starts")).alias("removal"))
    return _kept(frame.join(removal, "doc_id", "left").select("doc_id", "text", "removal"), kind, window)


def _kept(joined: DataFrame, kind: str, window: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": [], "removed": []}
        for text, removal in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = split(text)
            n = len(words)
            gone = np.zeros(n + 1, np.int64)
            for own in removal or ():
                if own["p"] == _print(words)[0]:
                    if own["starts"] is None:
                        gone[0] += 1
                    else:
                        starts = np.array(own["starts"], np.int64)
                        np.add.at(gone, starts, 1)
                        np.add.at(gone, starts + window, -1)
            covered = np.cumsum(gone)[:n] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
            kept = [w for w, c in zip(words, covered.tolist()) if not c] if len(edges) else words
            out["n_words"].append(n)
            out["n_removed"].append(n - len(kept))
            out["kept"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            out["removed"].append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
        return {"doc_id": batch.column(0), **out}

    return map_rows(joined, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, removed array<struct<start:bigint,end:bigint>>", run)
