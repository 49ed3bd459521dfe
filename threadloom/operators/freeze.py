"""The frozen evaluation set: topic quotas, and a greedy choice for new flags, new time bins and distance, settled lazily.

What makes a candidate attractive only falls as others are chosen: flags get covered, time bins too, and the nearest chosen text
comes closer. So the best few candidates of a topic, with their present ranks, come to the driver as a heap of bounds; the best one is ranked
anew and is chosen if it stays the best, also against the last of the heap, which bounds all that stayed behind. One pass over the candidates
settles many picks. The driver holds the chosen cases and ``heap`` candidates; candidates are written once, and a pass writes nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from threadloom.functions import text as tx
from threadloom.functions.durable import written
from threadloom.operators.vocabulary import _spans


def topic_quotas(available: dict[str, int], topics: list[str], target: int) -> dict[str, int]:
    """Seats of each topic that has candidates: one, and shares of the rest in proportion to what is left, by largest remainder.

    Ties go to the earlier topic; no topic gets more than it has, and what that leaves goes to the first with room.
    """
    active = [t for t in topics if available.get(t)]
    room = {t: available[t] - 1 for t in active}
    left, total = target - len(active), sum(room.values())
    if left < 0 or left > total:
        raise ValueError(f"{target} cases cannot be shared by {len(active)} topics with {total + len(active)} candidates")
    shares = {t: left * room[t] / total if total else 0.0 for t in active}
    seats = {t: min(room[t], int(shares[t])) for t in active}
    for t in sorted(active, key=lambda t: seats[t] - shares[t]):
        if sum(seats.values()) < left and seats[t] < room[t]:
            seats[t] += 1
    for t in active:
        seats[t] += min(room[t] - seats[t], left - sum(seats.values()))
    return {t: 1 + seats[t] for t in active}


def _alike(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


class _Case:
    """A candidate on the driver, with what is known of its distance to the chosen ones."""

    def __init__(self, row: Row) -> None:
        self.id, self.bin, self.flags, self.hash, self.far = row["id"], row["bin"], set(row["flags"]), row["hash"], row["far"]
        self.flats, self.tokens, self.grams, self.odd = row["flats"], [set(t) for t in row["tokens"]], [set(g) for g in row["grams"]], row["sets"]["odd"]
        self.met = 0

    def meets(self, chosen: list[_Case], tokens_alike: float, chars_alike: float) -> bool:
        """Takes in what has been chosen since; False if one of these is its duplicate."""
        for other in chosen[self.met :]:
            for k, flat in enumerate(self.flats):
                if (flat and flat == other.flats[k]) or _alike(self.tokens[k], other.tokens[k]) >= tokens_alike or _alike(self.grams[k], other.grams[k]) >= chars_alike:
                    return False
            self.far = min(self.far, 1 - _alike(self.tokens[-1], other.tokens[-1]))
        self.met = len(chosen)
        return True

    def key(self, flags: set, bins: set) -> tuple:
        return -len(self.flags - flags), self.bin in bins, -round(self.far, 8), self.hash, self.id


#: Groups of hashes by which character n-grams are told apart.
_BITS = 1024


@F.arrow_udf(StructType([StructField("n", ArrayType(IntegerType())), StructField("odd", ArrayType(ArrayType(LongType())))]))
def _sets(groups: pa.Array) -> pa.Array:
    """Of each text's set, given as its items' groups, the size, and of which groups it has an odd number of items."""
    inner = groups.flatten()
    sizes = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    odd = [np.zeros(0, np.int64)]
    for at in range(0, len(inner), 256):  # a bounded number of sets at a time
        own = inner.slice(at, 256)
        places = np.repeat(np.arange(len(own)) * _BITS, sizes[at : at + 256]) + own.flatten().to_numpy(zero_copy_only=False)
        odd.append(np.packbits((np.bincount(places, minlength=_BITS * len(own)) & 1).astype(np.uint8)).view(np.int64))
    each = pa.ListArray.from_arrays(np.arange(len(inner) + 1, dtype=np.int32) * (_BITS // 64), np.concatenate(odd))
    ends = pa.array(np.concatenate([[0], np.cumsum(groups.value_lengths().to_numpy())]), pa.int32())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(sizes, pa.int32())), pa.ListArray.from_arrays(ends, each)], ["n", "odd"])


def _prepared(candidates: DataFrame) -> DataFrame:
    """The candidates with normalised texts, their tokens as hashes, and of the sets of their n-grams, which are several times a text, only sizes and parities."""
    flats = F.transform("texts", lambda x: F.coalesce(tx.normalize_for_leakage(x), F.lit("")))
    base = candidates.select("id", "bucket", "topic", "bin", "flags", flats.alias("flats"))
    groups = F.transform("flats", lambda x: F.transform(tx.char_ngrams(x), lambda g: F.pmod(F.xxhash64(g), F.lit(_BITS)).cast("smallint")))
    return base.select("*", F.transform("flats", lambda x: F.transform(tx.token_set(x), lambda t: F.xxhash64(t))).alias("tokens"), _sets(groups).alias("sets"))


def _place(lists: pa.Array, k: int, width: int) -> pa.Array:
    """The k-th of each row's lists, of which there are ``width``."""
    return lists.flatten().take(pa.array(np.arange(len(lists)) * width + k))


def _against(chosen: list[_Case], tokens_alike: float, chars_alike: float) -> Callable[..., Column]:
    """Of tokens, and sizes and parities of n-grams: far, whether tokens are alike, and which of the chosen cases' texts may be alike in characters (case x width + place)."""
    n, width = len(chosen), len(chosen[0].flats)
    postings = []
    for k in range(width):
        sizes = np.array([len(c.tokens[k]) for c in chosen])
        terms, at = np.unique(np.array([t for c in chosen for t in c.tokens[k]], np.int64), return_inverse=True)
        owners = np.repeat(np.arange(n), sizes)[np.argsort(at, kind="stable")]
        postings.append((pa.array(terms), owners, np.bincount(at, minlength=len(terms)), sizes, np.array([len(c.grams[k]) for c in chosen]), np.array([c.odd[k] for c in chosen], np.int64)))

    def met(tokens: pa.Array, sets: pa.Array) -> pa.Array:
        if any((part.value_lengths().to_numpy() != width).any() for part in (tokens, sets.field("n"))):
            raise ValueError(f"candidates have different numbers of texts, {width} and another")
        far, same, near = np.ones(len(tokens)), np.zeros(len(tokens), bool), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, 1_000_000 // n)
        for low in range(0, len(tokens), step):  # a bounded number of pairs at a time
            own, its = tokens.slice(low, step), sets.slice(low, step)
            for k, (terms, owners, lengths, sizes, grams, odd) in enumerate(postings):
                lists = _place(own, k, width)
                at = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
                of, at = _spans(lists)[at >= 0], at[at >= 0]
                many = lengths[at]
                places = np.arange(many.sum()) + np.repeat((np.cumsum(lengths) - lengths)[at] - (np.cumsum(many) - many), many)
                both = np.bincount(np.repeat(of, many) * n + owners[places], minlength=len(own) * n).reshape(-1, n)
                alike = both / np.maximum(lists.value_lengths().to_numpy()[:, None] + sizes - both, 1)
                same[low : low + step] |= (alike >= tokens_alike).any(1)
                if k == width - 1:
                    far[low : low + step] = (1 - alike).min(1)
                m = its.field("n").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[:, k, None]
                rows, cases = np.nonzero((m > 0) & (np.minimum(m, grams) >= chars_alike * np.maximum(m, grams) - 1e-9))
                parity = _place(its.field("odd"), k, width).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                for part in range(0, len(rows), 65536):
                    r, c = rows[part : part + 65536], cases[part : part + 65536]
                    apart = np.bitwise_count(parity[r] ^ odd[c]).sum(1, dtype=np.int64)  # no fewer items differ
                    kept = apart <= (1 - chars_alike) / (1 + chars_alike) * (m[r, 0] + grams[c]) + 1e-6
                    near.append((r[kept] + low, c[kept] * width + k))
        rows, cases = (np.concatenate(x) for x in zip(*near))
        order = np.argsort(rows, kind="stable")
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(tokens)))]), pa.int32())
        return pa.StructArray.from_arrays([pa.array(far), pa.array(same), pa.ListArray.from_arrays(ends, pa.array(cases[order], pa.int32()))], ["far", "same", "near"])

    met.__annotations__ = {"tokens": pa.Array, "sets": pa.Array, "return": pa.Array}  # as types, for the udf reads them
    return F.arrow_udf("struct<far:double,same:boolean,near:array<int>>")(met).asNondeterministic()  # else a filter runs it again


def _meeting(state: DataFrame, chosen: list[_Case], tokens_alike: float, chars_alike: float) -> DataFrame:
    """``state`` without the chosen cases' duplicates, and with far, the distance to the nearest of them. They are one small row that is sent around.

    Nothing of it is written: a pass reads the candidates as they are, and meets all chosen cases.
    """
    if not chosen:
        return state.withColumn("far", F.lit(1.0))
    rows = [(c.flats, [sorted(g) for g in c.grams]) for c in chosen]
    one = F.broadcast(state.sparkSession.createDataFrame([(rows,)], "chosen array<struct<flats:array<string>,grams:array<array<string>>>>"))
    width = len(chosen[0].flats)

    def same(i: Column) -> Column:
        place, other = (i % width).cast("int"), F.get("chosen", F.floor(i / width).cast("int"))
        mine = F.get("flats", place)
        return (mine == F.get(other["flats"], place)) | (tx.jaccard(tx.char_ngrams(mine), F.get(other["grams"], place)) >= chars_alike)

    met = state.withColumn("met", _against(chosen, tokens_alike, chars_alike)("tokens", "sets")).where(~F.col("met.same"))
    met = met.join(one).where((F.size("met.near") == 0) | ~F.exists("met.near", same))  # the chosen are among their own duplicates, or go by id below
    return met.withColumn("far", F.col("met.far")).drop("chosen", "met")


def freeze(candidates: DataFrame, topics: list[str], targets: dict[str, int], seed: str, tokens_alike: float = 0.9, chars_alike: float = 0.92, heap: int = 256) -> DataFrame:
    """id, bucket, topic, position: for each bucket in order its number of cases, by topic quotas, chosen one by one: most new flags,
    then a time bin new to the topic, then the greatest distance to all chosen so far, then hash. Duplicates of chosen cases never are.

    ``candidates`` has id, bucket, topic, bin, flags (array) and texts (array of at least one; the last one's tokens give the distance; equal ones,
    or alike in tokens or in characters, place by place, make duplicates). An error if duplicates exhaust a quota. Their work is heavy by row: they should be ``spread``.
    """
    spark = candidates.sparkSession
    everything = written(_prepared(candidates))
    chosen: list[_Case] = []
    out: list[tuple[Any, str, str, int]] = []
    for bucket, target in targets.items():
        state = everything.where(F.col("bucket") == bucket)
        quotas = topic_quotas({r["topic"]: r["n"] for r in state.groupBy("topic").agg(F.count("*").alias("n")).collect()}, topics, target)  # a row a topic
        flags: set = set()
        for topic in [t for t in topics if t in quotas]:
            bins: set = set()
            need = quotas[topic]
            while need:
                fresh = -F.size(F.array_except("flags", F.array(*map(F.lit, sorted(flags))).cast("array<string>")))
                old = F.coalesce(F.col("bin").isin(*bins), F.lit(False)) if bins else F.lit(False)
                order = [fresh.alias("fresh"), old.alias("old"), (-F.round("far", 8)).alias("distance"), "hash", "id"]
                own = state.where((F.col("topic") == topic) & ~F.col("id").isin([c.id for c in chosen]))
                ranked = _meeting(own, chosen, tokens_alike, chars_alike).withColumn("hash", tx.hash_rank(f"{seed}:{bucket}:{topic}", F.col("id")))
                rows = ranked.orderBy(*order).limit(heap).withColumn("grams", F.transform("flats", lambda x: tx.char_ngrams(x))).collect()
                cases = [_Case(r) for r in rows]
                for c in cases:
                    c.met = len(chosen)
                entries = [(c.key(flags, bins), n) for n, c in enumerate(cases)]
                bound = entries[-1][0] if len(entries) == heap else None
                heapq.heapify(entries)
                before = need
                while need and entries:
                    key, n = entries[0]
                    case = cases[n]
                    if not case.meets(chosen, tokens_alike, chars_alike):
                        heapq.heappop(entries)
                    elif (now := case.key(flags, bins)) != key:
                        heapq.heapreplace(entries, (now, n))
                    elif bound is not None and key > bound:
                        break
                    else:
                        heapq.heappop(entries)
                        chosen.append(case)
                        out.append((case.id, bucket, topic, len(out) + 1))
                        flags |= case.flags
                        bins.add(case.bin)
                        need -= 1
                if need == before and bound is None:
                    raise ValueError(f"duplicates exhaust the quota of {topic!r}: {need} of {quotas[topic]} are missing")
    kind = candidates.schema["id"].dataType.simpleString()
    return spark.createDataFrame(out, f"id {kind}, bucket string, topic string, position bigint")
