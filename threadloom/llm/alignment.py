"""Alignment of two tokenizers' tokens, and how good the corpus holds each link to be.

Both tokenizers read one space and the text: a byte-level BPE (A) and a piece model that adds the space itself (B). Where tokens
of both end at the same byte, a group ends, and its last two tokens are linked. The count of an id pair is the number of its
links in the corpus; a link is best if no pair of its B id has a higher count.

Postings. Documents are encoded in batches of bounded bytes. A batch leaves a row a document, and a row for each id pair with the
documents that hold it and how often: a pair's row is at most a batch long, so that a frequent word weighs no more rows than a
batch each. Rows of pairs are dealt by B id, in parts where an id has more than ``per_task`` rows, and sorted (Spark's sort
spills). The corpus totals of the id's pairs come first in the stream; so a task reads a B id's counts and its maximum, and then
turns postings into contributions of documents while they pass: the pair's count, whether it is best, and the postings. It
holds one id's counts, at most A's vocabulary. Contributions are dealt by batch and sorted likewise, and summed by document in
arrays of a batch's length.

Encoding. Texts are cut where one space stands between two other characters. No piece of B continues over such a place and
A's pattern always cuts there, which is checked when the tokenizers are loaded; otherwise whole texts are encoded. New parts are
encoded many together, with such places between them. Parts met twice in a batch are remembered, within a bound.

Cases: null and empty texts, and texts whose joined token bytes differ from space and text for either tokenizer, have no tokens
and give zeros and no groups; repeated rows and ids are documents of their own; null ids stay; ids may have any type; texts of any
length are encoded whole; pairs with equal counts are all best; empty tables give empty results; columns beside the named ones are
ignored, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import held, slim, written

_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Encodes texts by both tokenizers and aligns the tokens. ``tokenizer`` is the JSON of A, ``pieces`` the model file of B."""

    def __init__(self, tokenizer: str, pieces: bytes, most: int = 200_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(tokenizer)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pieces)
        byte_of = _byte_of()
        vocabulary = self.a.get_vocab(False)
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(byte_of.get, entry))
        named = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(named)]
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.comma, self.bar, self.end = (np.array([f"{i}{mark}" for i in ids], object) for mark in ",|;")
        self.a_sizes, self.b_sizes = (np.array(list(map(len, own)), np.int64) for own in (self.a_bytes, self.b_bytes))
        self.most = most
        self.known: dict[str, tuple | None] = {}
        self.cuts = self._may_cut(json.loads(tokenizer), named)

    def _may_cut(self, described: dict, named: list[str]) -> bool:
        first = described.get("pre_tokenizer") or {}
        probe = "a  b\tc  dﬁ é Ａ"
        return (
            first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space") and not described.get("normalizer")
            and not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in named) and self.b.normalize(probe) == (_SPACE + probe).replace(" ", _SPACE)
        )

    def parts(self, text: str) -> list[str]:
        """The parts of a text; each is encoded with a space before it."""
        return _CUT.split(text) if self.cuts else [text]

    def _aligned(self, parts: list[str], a: list[int], b: list[int]) -> list[tuple] | None:
        """For parts encoded together, each one's numbers of tokens of A and B, its groups as written (with a last semicolon), and its
        linked pairs (B id above A id). None if bytes are lost, or if some part's end is no common end."""
        a_bytes, b_bytes, whole = self.a_bytes, self.b_bytes, " ".join(["", *parts]).encode()
        if b"".join([a_bytes[i] for i in a]) != whole or b"".join([b_bytes[i] for i in b]) != whole:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        at = np.searchsorted(b_ends, a_ends)
        cut = b_ends[at] == a_ends
        a_cuts, b_cuts = np.flatnonzero(cut), at[cut]
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        last = np.searchsorted(a_ends[a_cuts], ends)
        if (a_ends[a_cuts][last] != ends).any():
            return None
        # A group's tokens of A are written before its tokens of B.
        final = np.zeros(len(b), bool)
        final[b_cuts] = True
        written_ids = np.empty(len(a) + len(b), object)
        written_ids[np.arange(len(a)) + np.r_[0, b_cuts + 1][np.cumsum(cut) - cut]] = np.where(cut, self.bar[a], self.comma[a])
        written_ids[np.arange(len(b)) + a_cuts[np.cumsum(final) - final] + 1] = np.where(final, self.end[b], self.comma[b])
        ids, pairs = written_ids.tolist(), (b[b_cuts] << 32 | a[a_cuts]).tolist()
        a_stops, b_stops, stops = (a_cuts[last] + 1).tolist(), (b_cuts[last] + 1).tolist(), (last + 1).tolist()
        out, i, j, k = [], 0, 0, 0
        for a_stop, b_stop, stop in zip(a_stops, b_stops, stops):
            out.append((a_stop - i, b_stop - j, "".join(ids[i + j : a_stop + b_stop]), tuple(pairs[k:stop])))
            i, j, k = a_stop, b_stop, stop
        return out

    def _learned(self, new: list[str], together: int = 256) -> dict[str, tuple | None]:
        """The entries of parts; None for a part whose bytes are lost."""
        plain = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()] if self.cuts else []
        blocks = [plain[k : k + together] for k in range(0, len(plain), together)]
        known = set(plain) if len(plain) < len(new) else plain
        blocks += [[p] for p in new if p not in known] if len(plain) < len(new) else []
        out: dict[str, tuple | None] = {}
        while blocks:
            again = []
            texts = [" ".join(block) for block in blocks]
            encoded = zip(blocks, self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self.b.encode(texts, num_threads=1))
            for block, a, b in encoded:
                found = self._aligned(block, a.ids, b)
                if found is not None:
                    out.update(zip(block, found))
                elif len(block) > 1:
                    again += [[p] for p in block]
                else:
                    out[block[0]] = None
            blocks = again
        return out

    def entries(self, texts: list[str]) -> Iterator[tuple[tuple, ...] | None]:
        """For each text the token numbers of A and B, the groups and the pairs of its parts, in order; None if it is empty or its
        bytes are lost."""
        gc.disable()  # nothing here refers to itself, and the collector would walk all entries again and again
        cut = [self.parts(text) if text else [] for text in texts]
        met = Counter(chain.from_iterable(cut))
        new = [part for part in met if part not in self.known]
        own = self._learned(new)
        entry = (self.known | own).__getitem__
        for parts in cut:
            found = list(map(entry, parts))
            yield None if not found or None in found else tuple(zip(*found))
        if len(self.known) + len(own) > self.most:
            self.known = {}
        self.known |= {part: e for part, e in own.items() if met[part] > 1 and len(part) < 100}
        gc.enable()


def _aligner(tokenizer: str, pieces: bytes, key: str) -> Aligner:
    return held(key, lambda: Aligner(tokenizer, pieces))


def _portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most 65,536 rows and about ``size`` bytes of text, but at least one row."""
    for batch in batches:
        bytes_of = np.diff(np.asarray(batch.column(1).cast(pa.large_string()).buffers()[1]).view(np.int64)[batch.column(1).offset :][: batch.num_rows + 1]) if batch.num_rows else []
        begin = total = 0
        for k, own in enumerate(bytes_of):
            if k > begin and (total + own > size or k - begin >= 65_536):
                yield batch.slice(begin, k - begin)
                begin, total = k, 0
            total += own
        if batch.num_rows > begin:
            yield batch.slice(begin)


def groups(docs: DataFrame, tokenizer: str, pieces: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b and groups of every row, groups as ``a1,a2|b1;a3|b2,b3`` in order (no tokens: an empty string)."""
    frame = slim(docs, doc_id=doc_id, text=text)
    kind, key = frame.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex
    shared = frame.sparkSession.sparkContext.broadcast((tokenizer, pieces))  # two vocabulary files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value, key)
        for batch in _portions(batches, 4 << 20):
            found = [e or ((), (), (), ()) for e in aligner.entries(batch.column(1).to_pylist())]
            count = lambda k: pa.array([sum(e[k]) for e in found], pa.int64())  # noqa: E731,B023
            yield pa.RecordBatch.from_arrays([batch.column(0), count(0), count(1), pa.array(["".join(e[2])[:-1] for e in found], pa.string())], ["doc_id", "n_a", "n_b", "groups"])

    return frame.mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, groups string")


def _postings(frame: DataFrame, tokenizer: str, pieces: bytes, size: int) -> DataFrame:
    """A row a document (b is null) and a row for each pair of each batch: doc numbers within the batch, and multiplicities."""
    kind, key = frame.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex
    shared = frame.sparkSession.sparkContext.broadcast((tokenizer, pieces))  # two vocabulary files
    schema = f"doc_id {kind}, batch bigint, doc int, n_a bigint, n_b bigint, n_links bigint, groups_sha256 string, b int, a int, total bigint, docs array<int>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = _aligner(*shared.value, key), TaskContext.get().partitionId()
        for number, batch in enumerate(_portions(batches, size)):
            n = batch.num_rows
            n_a, n_b, links, prints, pairs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
            for k, entries in enumerate(aligner.entries(batch.column(1).to_pylist())):
                if entries is None:
                    prints.append("")
                    continue
                n_a[k], n_b[k] = sum(entries[0]), sum(entries[1])
                prints.append(hashlib.sha256("".join(entries[2])[:-1].encode()).hexdigest())
                own = np.fromiter(chain.from_iterable(entries[3]), np.int64)
                links[k] = len(own)
                pairs.append(own)
            both = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
            ids, code = np.unique(both, return_inverse=True)
            key_of, counts = np.unique(code * n + np.repeat(np.arange(n), links), return_counts=True)
            pair_at = np.searchsorted(key_of // max(n, 1), np.arange(len(ids) + 1)).astype(np.int32)
            totals = np.add.reduceat(counts, pair_at[:-1]) if len(ids) else np.zeros(0, np.int64)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(pair_at), pa.array(values.astype(np.int32)))  # noqa: E731,B023
            none, more = (lambda k, t: pa.nulls(k, t)), len(ids)
            docs = [batch.column(0), *map(pa.array, (np.full(n, task << 32 | number), np.arange(n, dtype=np.int32), n_a, n_b, links)), pa.array(prints, pa.string()), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.list_(pa.int32())), none(n, pa.list_(pa.int32()))]
            rows = [none(more, batch.column(0).type), pa.array(np.full(more, task << 32 | number)), none(more, pa.int32()), *[none(more, pa.int64())] * 3, none(more, pa.string()), pa.array((ids >> 32).astype(np.int32)), pa.array((ids & 0xFFFFFFFF).astype(np.int32)), pa.array(totals.astype(np.int64)), lists(key_of % max(n, 1)), lists(counts)]
            names = ["doc_id", "batch", "doc", "n_a", "n_b", "n_links", "groups_sha256", "b", "a", "total", "docs", "counts"]
            yield pa.RecordBatch.from_arrays(docs, names)
            for at in range(0, more, 10_000):
                yield pa.RecordBatch.from_arrays([c.slice(at, 10_000) for c in rows], names)

    return frame.mapInArrow(run, schema)


def pair_counts(postings: DataFrame) -> DataFrame:
    """b, a, total (links of the pair) and n (rows of postings)."""
    return postings.where("b IS NOT NULL").groupBy("b", "a").agg(F.sum("total").alias("total"), F.count("*").alias("n"))


def _contributions(postings: DataFrame, totals: DataFrame, per_task: int) -> DataFrame:
    """batch, count, best, docs, counts: what each row of postings gives to its documents."""
    # A row for each B id at most: bounded by B's vocabulary.
    loads = totals.groupBy("b").agg(F.ceil(F.sum("n") / per_task).cast("int").alias("parts")).where("parts > 1")
    dealt = lambda frame: frame.join(F.broadcast(loads), "b", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    heads = dealt(totals.select("b", "a", "total")).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "a", "total", none("bigint", "batch"), none("array<int>", "docs"), none("array<int>", "counts"))
    rows = dealt(postings.where("b IS NOT NULL").select("b", "a", "batch", "docs", "counts")).select("b", F.pmod(F.xxhash64("batch"), F.col("parts")).cast("int").alias("part"), "a", none("bigint", "total"), "batch", "docs", "counts")
    stream = heads.unionByName(rows).repartition("b", "part").sortWithinPartitions("b", "part", F.col("batch").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, totals = None, [], []
        for batch in batches:
            b, part, a = (batch.column(k).to_numpy() for k in range(3))
            head = np.asarray(batch.column(4).is_null())
            total = batch.column(3).fill_null(0).to_numpy()
            count, best = np.zeros(len(b), np.int64), np.zeros(len(b), bool)
            edges = np.flatnonzero((np.diff(b) != 0) | (np.diff(part) != 0) | np.diff(head)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(b)]) if len(b) else ():
                if head[lo]:
                    if now != (b[lo], part[lo]):
                        now, ids, totals = (b[lo], part[lo]), [], []
                    ids.append(a[lo:hi])
                    totals.append(total[lo:hi])
                    continue
                if isinstance(ids, list):
                    order = np.argsort(merged := np.concatenate(ids))
                    ids, totals = merged[order], np.concatenate(totals)[order]
                count[lo:hi] = totals[np.searchsorted(ids, a[lo:hi])]
                best[lo:hi] = count[lo:hi] == totals.max()
            rows = pa.array(np.flatnonzero(~head))
            columns = [batch.column(4), pa.array(count), pa.array(best), batch.column(5), batch.column(6)]
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in columns], ["batch", "count", "best", "docs", "counts"])

    return stream.mapInArrow(run, "batch bigint, count bigint, best boolean, docs array<int>, counts array<int>")


def _sums(contributions: DataFrame) -> DataFrame:
    """batch, doc, n_best, count_sum."""
    stream = contributions.repartition("batch").sortWithinPartitions("batch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, 0), np.int64)

        def whole() -> pa.RecordBatch:
            docs = np.arange(sums.shape[1], dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), now or 0)), pa.array(docs), pa.array(sums[0]), pa.array(sums[1])], ["batch", "doc", "n_best", "count_sum"])

        for batch in batches:
            own = batch.column(0).to_numpy()
            count, best = batch.column(1).to_numpy(), np.asarray(batch.column(2)).astype(np.int64)
            edges = np.flatnonzero(np.diff(own)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(own)]) if len(own) else ():
                if now != own[lo]:
                    yield whole()
                    now, sums = own[lo], np.zeros((2, 0), np.int64)
                lists, times = batch.column(3).slice(lo, hi - lo), batch.column(4).slice(lo, hi - lo).flatten().to_numpy()
                docs, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
                more = int(docs.max()) + 1 - sums.shape[1]
                if more > 0:
                    sums = np.pad(sums, ((0, 0), (0, more)))
                for k, value in enumerate((best, count)):
                    np.add.at(sums[k], docs, np.repeat(value[lo:hi], lengths) * times)
        yield whole()

    return stream.mapInArrow(run, "batch bigint, doc int, n_best bigint, count_sum bigint")


def align(docs: DataFrame, tokenizer: str, pieces: bytes, doc_id: str = "doc_id", text: str = "text", batch_bytes: int = 4 << 20, per_task: int = 1_000_000) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    postings = written(_postings(slim(docs, doc_id=doc_id, text=text), tokenizer, pieces, batch_bytes))
    totals = written(pair_counts(postings))
    given = _sums(_contributions(postings, totals, per_task))
    zero = F.lit(0).cast("bigint")
    return postings.where("b IS NULL").join(given, ["batch", "doc"], "left").select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
