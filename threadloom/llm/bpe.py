"""Byte-level BPE: encoding by a lazily determinised finite-state transducer, decoding by a UTF-8 state machine.

Encoding. The merges are compiled into pair compatibility: tokens ``a`` and ``b`` may stand side by side exactly if
merging their joined bytes gives ``[a, b]`` again. For every prefix of a piece exactly one chain of pairwise compatible
tokens ends at its last byte, and that chain is what the merges give. The transducer reads bytes; a state holds the last
token whose end is settled and the bytes since then. Tokens leave as soon as every chain that a longer token can still
continue passes through them, so the lookahead is bounded by the longest token. States and arcs are made when first
met and kept up to a bound; beyond it they serve one piece only.

Pieces are cut by the tokenizer's pattern. Runs between single spaces are encoded once and remembered, within a bound.

Decoding reads one id at a time. Each id moves a UTF-8 state machine whose states are the bytes of an unfinished
character; (state, id) pairs are remembered. Ids unknown to the vocabulary and broken byte sequences give U+FFFD.

Cases: null texts encode as empty texts; texts of any length are read whole; ids may have any type; every row is handled on its
own, so repeated rows, ties and empty tables need no rule; columns beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import codecs
import re
import uuid
from itertools import chain
from operator import itemgetter
from struct import Struct

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from threadloom.llm.common import held, map_rows, slim

#: White space in Unicode's sense; the default ``\s`` of Python also has four control characters.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNEVEN = re.compile(f"[{_SPACE}](?:[{_SPACE}]|$)|^[{_SPACE}]|[\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: The public pattern under which runs between single spaces are independent; any other pattern is applied to whole texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Marks that, after letters, make one piece under PATTERN.
_MARKS = ".,;:!?%&*$#|+=()<>[]{}/"


def load_ranks(path: str, most: int = 1_000_000) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file. ``most`` bounds what is later broadcast."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    if len(ranks) > most:
        raise ValueError(f"{len(ranks)} tokens; a vocabulary may have {most}")
    return ranks


_BYTES = [bytes((b,)) for b in range(256)]


class Transducer:
    """Encodes bytes by the merges that ``ranks`` stands for."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 400_000, most_pairs: int = 400_000) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:k] for token in ranks for k in range(1, len(token))}
        self.most_states, self.most_pairs = most_states, most_pairs
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, bool] = {}
        # State 0: at a piece's start. A state is (last settled token or -1, bytes since then, the first place in these from
        # which a token may still go on); it knows for each place the last token of the chain that ends there (None: no
        # chain). Arcs have the key state * 256 + byte.
        self.states: list[tuple[int, bytes, int]] = [(-1, b"", 0)]
        self.numbers = {(-1, b""): 0}
        self.lasts: list[tuple[int | None, ...]] = [(-1,)]
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """What applying the merges in order of rank gives: the definition that arcs are compiled from."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                rank = self.ranks.get(parts[k] + parts[k + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: start a piece)."""
        if left < 0:
            if (known := self.made.get(right)) is None:
                known = self.made[right] = self.merged(self.bytes_of[right]) == [right]
            return known
        if (known := self.pairs.get(key := left << 32 | right)) is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _chain(self, lasts: tuple[int | None, ...], end: int) -> tuple[int, ...]:
        out = []
        while end:
            out.append(lasts[end])
            end -= len(self.bytes_of[lasts[end]])
        return tuple(reversed(out))

    def _arc(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        settled, pending, first = self.states[number]  # no token that began before ``first`` is open any more
        pending += _BYTES[byte]
        end, lasts, own_bytes, prefixes, ranks = len(pending), self.lasts[number], self.bytes_of, self.prefixes, self.ranks.get
        last = None
        for start in range(first, end):
            before = lasts[start]
            if before is not None and (token := ranks(pending[start:])) is not None and self._fits(before, token):
                last = token
                break
        lasts = (*lasts, last)
        while first < end and pending[first:] not in prefixes:
            first += 1
        # The last place that the chains of all places from ``first`` on pass through is settled.
        ways, cut = {k for k in range(first, end + 1) if lasts[k] is not None}, 0
        while ways:
            if len(ways) == 1:
                (cut,) = ways
                break
            far = max(ways)
            ways.remove(far)
            ways.add(far - len(own_bytes[lasts[far]]) if far else 0)
        out: tuple[int, ...] = ()
        if cut > 0:
            out = self._chain(lasts, cut)
            settled, pending = out[-1], pending[cut:]
            if first >= cut:
                first -= cut
            else:
                first, rest = 0, len(pending)
                while first < rest and pending[first:] not in prefixes:
                    first += 1
            own: list[int | None] = [settled]
            for k in range(cut + 1, end + 1):
                token = lasts[k]
                own.append(token if token is not None and (back := k - len(own_bytes[token])) >= cut and own[back - cut] is not None else None)
            lasts = tuple(own)
        state = (settled, pending)
        if (to := self.numbers.get(state)) is None:
            to = len(self.states)
            self.states.append((settled, pending, first))
            self.lasts.append(lasts)
            if to >= self.most_states:  # full: this state serves the present piece only
                return (to, out)
            self.numbers[state] = to
        if number < self.most_states:
            self.arcs[number << 8 | byte] = (to, out)
        return (to, out)

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        most = self.most_states
        if len(self.states) > most:
            del self.states[most:], self.lasts[most:]
        state, out, get = 0, [], self.arcs.get
        for at in range(0, len(data), 50_000):
            for byte in data[at : at + 50_000] if at or len(data) > 50_000 else data:
                state, ids = get(state << 8 | byte) or self._arc(state, byte)
                if ids:
                    out += ids
            if state > most:  # a very long piece: of its own states keep the last
                self.states[most:], self.lasts[most:] = [self.states[state]], [self.lasts[state]]
                state = most
        if (end := self.ends.get(state)) is None:
            end = self._chain(self.lasts[state], len(self.states[state][1]))
            if state < most:
                self.ends[state] = end
        out += end
        return tuple(out)


class Encoder:
    """Texts to ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, most_runs: int = 300_000, most_recent: int = 40_000, most_states: int = 400_000) -> None:
        self.transducer = Transducer(ranks, most_states)
        self.cut = regex.compile(pattern.replace("[^\\s", f"[^{_SPACE}").replace("\\s", f"[{_SPACE}]").replace("\\S", f"[^{_SPACE}]")).findall
        self.by_runs = pattern == PATTERN
        self.runs: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.most_runs, self.most_recent = most_runs, most_recent
        self.by_size: dict[int, Struct] = {}

    def _packed(self, run: str, pieces: list[str]) -> bytes:
        encode = self.transducer.encode
        ids = encode(pieces[0].encode("utf-8", "surrogatepass")) if len(pieces) == 1 else tuple(chain.from_iterable(encode(p.encode("utf-8", "surrogatepass")) for p in pieces))
        n = len(ids)
        if (packer := self.by_size.get(n)) is None:
            packer = Struct(f"<{n}I")
            if n < 100:
                self.by_size[n] = packer
        packed = packer.pack(*ids)
        if len(run) < 100:
            if len(self.runs) < self.most_runs:
                self.runs[run] = packed
            else:
                if len(self.recent) >= self.most_recent:
                    self.recent.clear()
                self.recent[run] = packed
        return packed

    def _piece(self, piece: str) -> bytes:
        return self.recent.get(piece) or self._packed(piece, [piece])

    def _run(self, run: str) -> bytes:
        if known := self.recent.get(run):
            return known
        stem = run.rstrip(_MARKS)
        if stem.isalpha() or stem[:1] == " " and stem[1:].isalpha():
            if len(stem) == len(run):
                return self._packed(run, [run])
            tail, get = run[len(stem) :], self.runs.get
            return (get(stem) or self._piece(stem)) + (get(tail) or self._piece(tail))
        return self._packed(run, self.cut(run))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not text:
            return b""
        get = self.runs.get
        if not self.by_runs or _UNEVEN.search(text):  # runs of white space, say: the pattern alone decides
            return b"".join([get(p) or self._piece(p) for p in self.cut(text)])
        # Every white space is one space or line feed between two other characters. A space belongs to the piece that
        # follows and a line feed is a piece of its own, so the text falls into runs that do not affect each other.
        run, feed, out = self._run, None, []
        for line in text.split("\n"):
            if feed is not None:
                out.append(feed)
            else:
                feed = get("\n") or self._piece("\n")
            head, *rest = line.split(" ")
            out.append(get(head) or run(head))
            out += [get(w) or run(w) for w in [" " + w for w in rest]]
        return b"".join(out)


class Decoder:
    """Ids to text, one id at a time, by a UTF-8 state machine."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.moves: dict[bytes, dict[int, tuple[bytes, str]]] = {b"": {}}
        self.whole: dict[int, str] = {}
        for rank, token in self.bytes_of.items():
            rest, text = self._move(b"", rank)
            if not rest:
                self.whole[rank] = text

    def _move(self, state: bytes, number: int) -> tuple[bytes, str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        machine.setstate((state, 0))
        text = machine.decode(self.bytes_of[number]) if number in self.bytes_of else machine.decode(b"", True) + "�"
        return machine.getstate()[0], text

    def step(self, state: bytes, number: int) -> tuple[bytes, str]:
        """The next state and the characters that this id completes."""
        arcs = self.moves.setdefault(state, {})
        if (move := arcs.get(number)) is None:
            move = arcs[number] = self._move(state, number)
        return move

    def decode(self, packed: bytes) -> str:
        ids = memoryview(packed).cast("I") if _LITTLE else Struct(f"<{len(packed) // 4}I").unpack(packed)
        try:  # every id a run of whole characters
            return "".join(itemgetter(*ids)(self.whole)) if len(ids) > 1 else self.whole[ids[0]] if len(ids) else ""
        except KeyError:
            pass
        state, out = b"", []
        for number in ids:
            text = self.whole.get(number) if not state else None
            if text is None:
                state, text = self.step(state, number)
            out.append(text)
        return "".join(out) + ("�" if state else "")


_LITTLE = Struct("=I").pack(1) == Struct("<I").pack(1)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of every row."""
    shared, key = docs.sparkSession.sparkContext.broadcast(ranks), f"encode {uuid.uuid4().hex}"

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        encoder = held(key, lambda: Encoder(shared.value, pattern))
        return {"doc_id": batch.column(0), "ids": [encoder.encode(t) for t in batch.column(1).to_pylist()]}

    frame = slim(docs, doc_id=doc_id, text=text)
    return map_rows(frame, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids binary", run)


def decode(encoded: DataFrame, ranks: dict[bytes, int], doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, ids and the decoded text of every row; null ids decode as none."""
    shared, key = encoded.sparkSession.sparkContext.broadcast(ranks), f"decode {uuid.uuid4().hex}"

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        decoder = held(key, lambda: Decoder(shared.value))
        return {"doc_id": batch.column(0), "ids": batch.column(1), "text": [decoder.decode(x or b"") for x in batch.column(1).to_pylist()]}

    frame = slim(encoded, doc_id=doc_id, ids=ids)
    return map_rows(frame, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids binary, text string", run)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, doc_id: str = "doc_id", text: str = "text", most_states: int = 400_000, most_runs: int = 300_000) -> DataFrame:
    """What ``decode(encode(docs))`` gives, in one pass, so that a core holds one Python worker instead of two.

    A worker keeps at most ``most_states`` states of the transducer, about a kilobyte each with their arcs, and the ids of
    ``most_runs`` runs, about 200 bytes each; fewer give the same ids, later.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(ranks), f"both {uuid.uuid4().hex}"

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        encoder, decoder = held(key, lambda: (Encoder(shared.value, pattern, most_runs, most_states=most_states), Decoder(shared.value)))
        ids = [encoder.encode(t.as_py()) for t in batch.column(1)]
        return {"doc_id": batch.column(0), "ids": ids, "text": [decoder.decode(x) for x in ids]}

    frame = slim(docs, doc_id=doc_id, text=text)
    return map_rows(frame, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, ids binary, text string", run)
