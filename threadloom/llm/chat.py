"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A state is a role together with whether the line begins a turn. A line shows its speaker marker (which role's word stands
before a colon or angle bracket, if any), its length class, how it ends, and how it begins. Start, transition and emission
tables are counted on labelled conversations as they are written, with markers that may be absent or wrong, so the model
learns how far to trust a marker. Viterbi gives each line its state; lines of a turn are joined and rendered with canonical
marks.

A conversation is handled in parts of at most ``part_turns`` turns, cut by position. Where it has several, each part gives the
best score for every pair of states before it and at its end, a six by six matrix; chaining these few numbers, in order, fixes
the state at the end of each part, and parts are decoded between these states. So the whole conversation is one Viterbi path,
although no task ever holds more than a part, or a matrix for each part of one conversation (a byte for three turns or so).

The model is fitted on about ``sample_parts`` parts, chosen by a hash; what is collected are counts of a fixed set of keys.

Cases: null and empty texts are transcripts without turns; a transcript without markers gets its most likely roles; ties go
to the state listed first; a row without conversation or turn cannot be placed and is a transcript of its own; turns with
equal numbers go by role, then text; repeated rows are repeated turns; null or unknown roles are written without a marker and
not learned from; empty tables give empty results; columns beside the named ones are ignored, and pass through ``parse``,
where a column named like one of its results is replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import map_rows, slim, written

ROLES = ("user", "assistant", "system")
#: Words that mark a speaker.
MARKERS = {
    "user": "user customer human client question q me", "assistant": "assistant agent bot ai support answer a", "system": "system instruction instructions",
}
_ROLE_OF = {word: role for role, words in MARKERS.items() for word in words.split()}
_MARKER = re.compile(r"^[ \t]*(?:\*\*|\[|<)?(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\*\*|\]|>)?[ \t]*[:>][ \t]*", re.I)
_STATES = [(role, begins) for role in ROLES for begins in (True, False)]
_N = len(_STATES)
_LENGTHS = (0, 1, 4, 8, 16, 40)
#: Sizes of the emission tables: marker, length class, ending, beginning.
_SIZES = (1 + len(ROLES), len(_LENGTHS), 4, 3)


def observed(line: str) -> tuple[int, int, int, int]:
    """A line's symbols."""
    found = _MARKER.match(line)
    bare = (line[found.end() :] if found else line).strip()
    words = len(bare.split())
    end = {"?": 1, ".": 2, "!": 2}.get(bare[-1:], 3 if bare else 0)
    begin = 0 if not bare else 1 if bare[0].isupper() else 2
    return (1 + ROLES.index(_ROLE_OF[found[1].lower()]) if found else 0, sum(words >= k for k in _LENGTHS) - 1, end, begin)


def lines_of(text: str | None) -> list[str]:
    return text.split("\n") if text else []


class RoleModel:
    """Log tables of the hidden Markov model, from counts of (table, key...) tuples."""

    def __init__(self, counts: dict[tuple, float]) -> None:
        def table(name: str, *shape: int) -> np.ndarray:
            out = np.full(shape, 0.5)
            for key, n in counts.items():
                if key[0] == name:
                    out[key[1:]] += n
            return np.log(out / out.sum(-1, keepdims=True))

        self.start, self.move = table("start", _N), table("move", _N, _N)
        self.emit = [table(f"emit{k}", _N, size) for k, size in enumerate(_SIZES)]
        for s, (_, begins) in enumerate(_STATES):  # a turn's later lines belong to the role that began it, and need a beginning
            if not begins:
                self.start[s] = -1e9
                self.move[[k for k, x in enumerate(_STATES) if x[0] != _STATES[s][0]], s] = -1e9

    def scores(self, lines: list[str]) -> np.ndarray:
        """Log chance of every line in every state."""
        seen = np.array([observed(x) for x in lines])
        return sum(e[:, seen[:, k]] for k, e in enumerate(self.emit)).T

    def path(self, lines: list[str], before: int | None = None, last: int | None = None) -> list[int]:
        """The most likely states, given the state before the first line (none: a start) and that of the last line, if known."""
        if not lines:
            return []
        scores = self.scores(lines)
        value, back = (self.start if before is None else self.move[before]) + scores[0], np.zeros(scores.shape, np.int64)
        for t in range(1, len(lines)):
            options = value[:, None] + self.move
            back[t] = options.argmax(0)
            value = options[back[t], np.arange(_N)] + scores[t]
        state = int(value.argmax()) if last is None else last
        path = [state]
        for t in range(len(lines) - 1, 0, -1):
            state = int(back[t, state])
            path.append(state)
        return path[::-1]

    def transfer(self, lines: list[str], first: bool) -> np.ndarray:
        """The best score from each state before the lines (a start, if first) to each state of the last line."""
        scores = self.scores(lines)
        value = (np.repeat(self.start[None], _N, 0) if first else self.move) + scores[0]
        for row in scores[1:]:
            value = (value[:, :, None] + self.move[None]).max(1) + row
        return value

    def turns(self, text: str | None, path: list[int] | None = None) -> list[dict[str, str]]:
        """The turns of a transcript."""
        lines = lines_of(text)
        out: list[dict[str, str]] = []
        for line, state in zip(lines, self.path(lines) if path is None else path):
            role, begins = _STATES[state]
            found = _MARKER.match(line)
            own = line[found.end() :] if found and begins else line
            if begins or not out:
                out.append({"role": role, "text": own})
            else:
                out[-1]["text"] += "\n" + own
        return out


def chained(matrices: list[np.ndarray]) -> list[int]:
    """The state at the end of each part on the best path through all of them."""
    after = [np.zeros(_N)]
    for m in reversed(matrices[1:]):
        after.append((m + after[-1][None]).max(1))
    after.reverse()
    ends, row = [], matrices[0][0]
    for k, w in enumerate(after):
        ends.append(int((row + w).argmax()))
        if k + 1 < len(matrices):
            row = matrices[k + 1][ends[-1]]
    return ends


def rendered(turns: list[dict[str, str]]) -> str:
    """The canonical form of turns."""
    return "".join(f"<|{t['role']}|>\n{t['text'].strip()}<|end|>\n" for t in turns)


def held_out(conv_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(conv_id.cast("string")) % folds == fold, F.lit(False))


def _positions(rows: DataFrame) -> DataFrame:
    """Adds place, the position of a row in its conversation (from 0), by turn, role and text.

    Rows are dealt out by range, equal ones too, numbered within a range, and shifted by what the ranges before hold of the
    conversation, so that no conversation has to fit into a task.
    """
    order = ["turn", "role", "text"]
    ranged = written(rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order, "salt").withColumn("range", F.spark_partition_id()))
    local = ranged.withColumn("place", F.row_number().over(Window.partitionBy("range", "conv_id").orderBy(*order, "salt")) - 1)
    sizes = written(ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n")))  # for each conversation a row a range
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("range")) - F.col("n")).select("conv_id", "range", "before")
    return local.join(before, ["conv_id", "range"]).select("conv_id", *order, (F.col("place") + F.col("before")).alias("place"))


def transcripts(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = 1024, canonical: bool = False) -> DataFrame:
    """conv_id, part, turns (place, turn, role, text, in order) and transcript.

    Transcripts are written the way they are met: by a hash of conversation and place, three turns in ten have no marker, one
    has another role's, two have another word for the role. ``canonical`` marks every turn whose role is known.
    """
    frame = slim(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    placed = _positions(frame.where(known)).withColumn("part", F.floor(F.col("place") / part_turns).cast("bigint"))
    fields = F.struct("place", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = placed.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(fields)).alias("turns"))
    alone = frame.where(~known).withColumn("place", F.lit(0).cast("bigint")).select("conv_id", F.lit(0).cast("bigint").alias("part"), F.array(fields).alias("turns"))
    both = whole.unionByName(alone)

    def marker(t: Column) -> Column:
        index = F.array_position(F.array(*map(F.lit, ROLES)), t["role"])
        chance = F.lit(9) if canonical else F.pmod(F.xxhash64("conv_id", t["place"], F.lit(11)), F.lit(10))
        words = lambda pick: F.array(*(F.lit(MARKERS[r].split()[pick % len(MARKERS[r].split())].capitalize() + ": ") for r in ROLES))
        other = F.get(words(0), (index % len(ROLES)).cast("int"))
        own = F.when(chance < 6, F.get(words(1), (index - 1).cast("int"))).otherwise(F.get(words(0), (index - 1).cast("int")))
        return F.when(F.coalesce(index, F.lit(0)) == 0, "").when(chance < 3, "").when(chance == 3, other).otherwise(own)

    return both.withColumn("transcript", F.array_join(F.transform("turns", lambda t: F.concat(marker(t), t["text"])), "\n"))


def train(parts: DataFrame, sample_parts: int = 3000) -> RoleModel:
    """Counts the tables on a sample of ``transcripts``."""
    total, wide = parts.count(), 1 << 30
    share = int(wide * min(1.0, sample_parts / max(1, total))) + 1
    sample = parts.where(F.pmod(F.xxhash64("conv_id", "part", F.lit(7)), F.lit(wide)) < share).select("part", "turns", "transcript")

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        counts: Counter = Counter()
        for part, turns, transcript in zip(*(batch.column(k).to_pylist() for k in range(3))):
            lines, before = iter(transcript.split("\n")), None
            for turn in turns:
                for j, line in enumerate([next(lines) for _ in turn["text"].split("\n")]):
                    if turn["role"] not in ROLES:
                        before = None
                        continue
                    state = _STATES.index((turn["role"], j == 0))
                    if before is not None:
                        counts[("move", before, state)] += 1
                    elif part == 0:
                        counts[("start", state)] += 1
                    for f, symbol in enumerate(observed(line)):
                        counts[f"emit{f}", state, symbol] += 1
                    before = state
        return {"key": [[str(x) for x in key] for key in counts], "n": list(counts.values())}

    rows = map_rows(sample, "key array<string>, n bigint", run).groupBy("key").agg(F.sum("n").alias("n")).collect()
    return RoleModel({(r.key[0], *map(int, r.key[1:])): r.n for r in rows})


_PARSED = "parsed array<struct<role:string,text:string>>, line_roles array<string>, rendered string"


def parse(texts: DataFrame, model: RoleModel, text: str = "text", before: str | None = None, last: str | None = None) -> DataFrame:
    """All columns, with parsed (turns: role, text), line_roles and rendered, of every row of transcripts.

    ``before`` and ``last`` name columns of states that a part must follow and end in, where that is known.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    names = [n for n in texts.columns if n not in ("parsed", "line_roles", "rendered")]
    at = len(names)
    states = [F.col(f"`{c}`").cast("int") if c else F.lit(None).cast("int") for c in (before, last)]
    frame = texts.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text}`").alias("_text"), states[0].alias("_before"), states[1].alias("_last"))

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {"parsed": [], "line_roles": [], "rendered": []}
        for own, entry, end in zip(*(batch.column(at + k).to_pylist() for k in range(3))):
            lines = lines_of(own) or ([""] if end is not None else [])
            path = shared.value.path(lines, entry, end)
            turns = shared.value.turns(own, path)
            out["parsed"].append(turns)
            out["line_roles"].append([_STATES[s][0] for s in path])
            out["rendered"].append(rendered(turns))
        return {n: batch.column(k) for k, n in enumerate(names)} | out

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema[:at])
    return map_rows(frame, schema + _PARSED, run)


def parse_parts(parts: DataFrame, model: RoleModel) -> DataFrame:
    """``parse`` for ``transcripts``: conversations of several parts are one path."""
    many = written(parts.where("conv_id IS NOT NULL AND part > 0").select("conv_id").distinct())
    shared = parts.sparkSession.sparkContext.broadcast(model)
    kind = parts.schema["conv_id"].dataType.simpleString()

    def transfers(batch: pa.RecordBatch) -> dict[str, object]:
        found = [shared.value.transfer(lines_of(t) or [""], p == 0).ravel() for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        return {"conv_id": batch.column(0), "part": batch.column(1), "matrix": found}

    def ends(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {"conv_id": [], "part": [], "before": [], "last": []}
        for conversation, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            states = chained([np.array(x["matrix"]).reshape(_N, _N) for x in own])
            out["conv_id"] += [conversation] * len(own)
            out["part"] += [x["part"] for x in own]
            out["before"] += [None, *states[:-1]]
            out["last"] += states
        return out

    long = parts.where("conv_id IS NOT NULL AND turns[0].turn IS NOT NULL").join(many, "conv_id").select("conv_id", "part", "transcript")
    matrices = map_rows(long, f"conv_id {kind}, part bigint, matrix array<double>", transfers)
    chains = matrices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "matrix"))).alias("own"))
    known = written(map_rows(chains, f"conv_id {kind}, part bigint, before int, last int", ends))
    joined = parts.join(known, (parts["conv_id"] == known["conv_id"]) & (parts["part"] == known["part"]) & F.expr("turns[0].turn IS NOT NULL"), "left")
    return parse(joined.select(parts["conv_id"], parts["part"], "turns", "transcript", "before", "last"), model, "transcript", "before", "last").drop("before", "last")
