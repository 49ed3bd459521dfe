"""Language identification of whole, possibly mixed-language, texts.

Script ranges narrow the languages that a word may have; hashed character n-grams score it for each of them; Viterbi over
the words, with a penalty for every switch, labels spans. A document's language is the one with most letters.

The model is fitted on a bounded sample: each language has an equal share of ``sample_rows``, at least ``least_rows``, and
gives all its labelled rows up to that, or about that many, chosen by a hash of the id; no language is without a row. Each
text is counted whole, in portions of words. What is collected is a table of ``buckets`` counts per language.
Everything that is scored is scored whole.

Cases: null texts and texts without a letter are ``und`` with score 0; with nothing to learn from, all are; rows with a
null id are scored but not learned from; repeated rows are scored alike; ties go to the language that sorts first; letters of
a script that no language was learned with count for none, so that a text of such letters alone has score 0; texts of any
length are learned from and scored whole; more than ``most_languages`` languages are an error, as the model's size grows with
them; columns beside the named ones are ignored, and those of ``keep`` may have any name but predicted, score and spans.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import held, map_rows, slim

#: First code points of letter ranges by script (Unicode); what lies between named ranges is "other".
_SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
_STARTS = [s for s, _ in _SCRIPTS]
_NAMES = sorted({n for _, n in _SCRIPTS})
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS = re.compile(r"\S+")


@dataclass
class LanguageModel:
    """Log probabilities: ``grams[bucket, language]``; ``scripts[script, language]`` tells who uses a script."""

    languages: list[str]
    grams: np.ndarray
    scripts: np.ndarray
    penalty: float
    most_words: int = 250_000

    def __post_init__(self) -> None:
        self.words: dict[str, int] = {}
        self.table = np.zeros((0, len(self.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)
        self.certain = np.zeros(0, np.int64)  # the letters of words whose script some language uses

    def learn(self, words: list[str]) -> None:
        """Scores words not met before, all at once, and gives each a row in the table."""
        bare = [w if w.isalpha() else "".join(_LETTERS.findall(w)) for w in words]
        grams, owner, far = gram_buckets([w.lower() for w in bare], len(self.grams))
        scores = np.stack([np.bincount(owner, self.grams[grams, k], len(words)) for k in range(len(self.languages))], 1)
        used = self.scripts[scripts_of(far)]
        known = used.any(1) & np.fromiter(map(bool, bare), bool, len(bare))
        scores = np.where(used, scores, scores.min(1, keepdims=True) - 50)
        scores[~known] = 0
        sizes = np.fromiter(map(len, bare), np.int64, len(bare))
        at = len(self.words)
        self.words.update(zip(words, range(at, at + len(words))))
        self.table = np.concatenate([self.table, scores.astype(np.float32)])
        self.letters = np.concatenate([self.letters, sizes])
        self.certain = np.concatenate([self.certain, np.where(known, sizes, 0)])

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        """The table rows of each text's words."""
        split = [t.split() if t and self.languages else [] for t in texts]
        new = set().union(*split) - self.words.keys()
        for words in batched(sorted(new), 20_000):  # an n-gram takes some dozens of bytes while it is scored
            self.learn(list(words))
        find = self.words.__getitem__
        return [np.fromiter(map(find, words), np.int64, len(words)) for words in split]

    def spans(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, int]]]]:
        """Language, score and (first word, end, language number) spans of each text; all texts step through together."""
        if len(self.words) > self.most_words:
            self.__post_init__()
        rows = self.rows(texts)
        order = sorted(range(len(rows)), key=lambda k: -len(rows[k]))
        sizes = np.array([len(rows[k]) for k in order], np.int64)
        steps = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")  # texts with more than t words
        starts = np.concatenate([[0], np.cumsum(active)])
        flat = np.zeros(int(starts[-1]), np.int64)
        for place, k in enumerate(order):
            flat[starts[: len(rows[k])] + place] = rows[k]
        scores = self.table[flat]
        best = np.zeros(len(flat), np.int8)
        switched = np.zeros((len(flat), len(self.languages)), bool)
        value = np.zeros((len(order), len(self.languages)), np.float64)
        for t in range(steps):
            n, at = active[t], starts[t]
            v = value[:n]
            if t:
                top = v.argmax(1)
                limit = v[np.arange(n), top] - self.penalty
                best[at : at + n] = top
                switched[at : at + n] = v < limit[:, None]
                np.maximum(v, limit[:, None], out=v)
            v += scores[at : at + n]
        label = np.zeros(len(flat), np.int8)
        current = value.argmax(1) if len(order) and self.languages else np.zeros(len(order), np.int64)
        for t in range(steps - 1, -1, -1):
            n, at = active[t], starts[t]
            c = current[:n]
            label[at : at + n] = c
            if t:
                moved = switched[np.arange(at, at + n), c]
                np.copyto(c, best[at : at + n], where=moved)
        out: list = [("und", 0.0, [])] * len(texts)
        for place, k in enumerate(order):
            n = len(rows[k])
            if not n:
                continue
            at = starts[:n] + place
            own, letters = label[at], self.letters[flat[at]].sum()
            if not letters:
                continue
            by = np.bincount(own, self.certain[flat[at]], len(self.languages))
            top = int(by.argmax())
            edges = np.flatnonzero(np.diff(own)) + 1
            firsts, ends = [0, *edges.tolist()], [*edges.tolist(), n]
            out[k] = (self.languages[top], float(by[top] / letters), [(a, b, int(own[a])) for a, b in zip(firsts, ends)])
        return out


def gram_buckets(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case words: the bucket of every n-gram (two, three and four characters, word ends marked), the number of the
    word it belongs to, and each word's highest code point."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    chars = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    far = np.maximum.reduceat(chars, np.cumsum(sizes) - sizes).astype(np.int64)
    found, own = [], []
    for n in (2, 3, 4):
        count = len(chars) - n + 1
        if count <= 0:
            continue
        hashed = np.full(count, n, np.uint64)
        for k in range(n):
            hashed = (hashed ^ chars[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
        whole = owner[:count] == owner[n - 1 :]
        found.append((hashed[whole] % np.uint64(buckets)).astype(np.int64))
        own.append(owner[:count][whole])
    return np.concatenate(found), np.concatenate(own), far


def scripts_of(far: np.ndarray) -> np.ndarray:
    """The scripts of code points: a word has that of its highest one."""
    by_range = np.array([_NAMES.index(name) for _, name in _SCRIPTS])
    return by_range[np.searchsorted(_STARTS, far, side="right") - 1]


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def train(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = 4000,
    least_rows: int = 50,
    buckets: int = 1 << 16,
    penalty: float = 12.0,
    most_languages: int = 200,
) -> LanguageModel:
    """Fits the model on a sample of the labelled rows that are not held out."""
    frame = slim(docs, doc_id=doc_id, text=text, lang=lang)
    labelled = frame.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    parts = 1 << 30
    labelled = labelled.withColumn("place", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(4)), F.lit(parts)))
    known = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("first")).limit(most_languages + 1).collect()
    if len(known) > most_languages:
        raise ValueError(f"more than {most_languages} languages; the model may have {most_languages}")
    quota = max(least_rows, sample_rows // max(1, len(known)))
    # The first row of a language is always learned.
    limits = [F.when(F.col("lang") == r.lang, F.lit(max(r.first, int(parts * min(1.0, quota / r.n))))) for r in known]
    sample = labelled.where(F.col("place") <= F.coalesce(*limits, F.lit(-1))).drop("place")

    def count(batch: pa.RecordBatch) -> dict[str, object]:
        held("counts", dict)  # what another operator has left in this worker goes
        out: dict[str, list] = {"lang": [], "bucket": [], "n": []}
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            grams_seen, scripts_seen = np.zeros(buckets, np.int64), np.zeros(len(_NAMES), np.int64)
            for words in batched((m.group() for text in texts for m in _LETTERS.finditer(text.lower())), 20_000):
                grams, _, far = gram_buckets(list(words), buckets)
                grams_seen += np.bincount(grams, minlength=buckets)
                scripts_seen += np.bincount(scripts_of(far), minlength=len(_NAMES))
            for first, seen in ((0, grams_seen), (-1, scripts_seen)):
                keys = np.flatnonzero(seen)
                out["lang"] += [lang] * len(keys)
                out["bucket"] += (keys if first == 0 else -1 - keys).tolist()
                out["n"] += seen[keys].tolist()
        return out

    counted = map_rows(sample, "lang string, bucket bigint, n bigint", count).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # at most buckets + scripts rows a language, as packed columns
    langs, keys, n = rows["lang"].to_pylist(), rows["bucket"].to_numpy(), rows["n"].to_numpy()
    languages = sorted(set(langs))
    number = {lang: k for k, lang in enumerate(languages)}
    own = np.fromiter((number[x] for x in langs), np.int64, len(langs))
    grams = np.full((buckets, len(languages)), 0.2)
    scripts = np.zeros((len(_NAMES), len(languages)))
    is_gram = keys >= 0
    grams[keys[is_gram], own[is_gram]] += n[is_gram]
    scripts[-1 - keys[~is_gram], own[~is_gram]] += n[~is_gram]
    logs = np.log(grams / grams.sum(0, keepdims=True)) / 3  # the three lengths overlap
    shares = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
    return LanguageModel(languages, logs.astype(np.float32), shares >= 0.01, penalty)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, batch_chars: int = 3_000_000) -> DataFrame:
    """doc_id, predicted, score and spans (start, end in code points, lang) of every row; with ``keep``, those columns as well."""
    shared, key = docs.sparkSession.sparkContext.broadcast((model.languages, model.grams, model.scripts, model.penalty)), uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        own = held(key, lambda: LanguageModel(*shared.value))
        out: dict[str, list] = {"predicted": [], "score": [], "spans": []}
        for texts in _portions(batch.column(0).to_pylist(), batch_chars):
            for text, (lang, score, spans) in zip(texts, own.spans(texts)):
                out["predicted"].append(lang)
                out["score"].append(score)
                if len(spans) > 1:
                    places = [m.span() for m in _WORDS.finditer(text)]
                    ends = [(places[a][0], places[b - 1][1], k) for a, b, k in spans]
                else:
                    ends = [(0, len(text), k) for _, _, k in spans]
                out["spans"].append([{"start": a, "end": b, "lang": own.languages[k]} for a, b, k in ends])
        return {f"_{k}": batch.column(1 + k) for k in range(len(names))} | out

    names = keep or [doc_id]
    frame = slim(docs, _text=text, **{f"_{k}": n for k, n in enumerate(names)})
    kinds = ", ".join(f"_{k} {docs.schema[n].dataType.simpleString()}" for k, n in enumerate(names))
    found = map_rows(frame, f"{kinds}, predicted string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>", run, rows=10_000)
    return found.select(*(F.col(f"_{k}").alias(n) for k, n in enumerate(names)), "predicted", "score", "spans")


def _portions(texts: list[str | None], most: int):
    """Consecutive parts of a list of texts with at most about ``most`` characters each."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
