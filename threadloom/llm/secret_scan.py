"""Secret scans over a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is derived: every text that matches must satisfy it. The
inverted index holds, for the trigrams that the queries name, posting lists of document ids by block, where a block is a
hash of the id, so that no posting list grows with the corpus. Queries intersect and unite posting lists block by block;
only candidates are verified with the regular expression. Rules without a mandatory trigram scan every text. A bitmap of fixed
size tells which rows may be candidates, so that other texts are never shuffled.

Cases: null texts are empty; rows with a null id are not in the index and are verified by every rule; rows that share an
id share its candidates, and each is verified on its own text; ids may have any type; texts of any length are scanned whole;
ties between spans go by start, then rule; empty tables give empty results; columns beside the named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import spans
from threadloom.llm.common import slim, written

_MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if the given group has ``least`` characters or more; failing matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed values. The first three are the base; their matches are never dropped in favour of another rule's.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
)

#: A query is True (every text), ("t", trigram), ("and", ...) or ("or", ...).
Query = object


def _all(parts: list) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list) -> Query:
    parts = list(dict.fromkeys(parts))
    if True in parts or not parts:
        return True
    needs = {p: trigrams_of(p) for p in parts if p[0] == "t" or all(q[0] == "t" for q in p[1:])}
    parts = [p for p in parts if p not in needs or not any(own < needs[p] for own in needs.values())]  # A or (A and B) is A
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> Query:
    return _any([_all([("t", s[k : k + 3]) for k in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(item) -> set[str] | None:
    """All lower-case strings that a parsed item can match, if they are few."""
    kind, value = item
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        found: set[str] = set()
        for k, v in value:
            if k is op.LITERAL:
                found.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < _MOST_STRINGS:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if kind is op.SUBPATTERN:
        return _sequence_strings(value[3])
    if kind is op.BRANCH:
        options = [_sequence_strings(p) for p in value[1]]
        return None if any(o is None for o in options) else set().union(*options)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] <= 4:
        own = _sequence_strings(value[2])
        if own is not None:
            found = {"".join(x) for n in range(value[0], value[1] + 1) for x in product(own, repeat=n)}
            return found if len(found) <= _MOST_STRINGS else None
    return None


def _sequence_strings(items) -> set[str] | None:
    found = {""}
    for item in items:
        own = _strings(item)
        if own is None or len(found) * len(own) > _MOST_STRINGS:
            return None
        found = {a + b for a in found for b in own}
    return found


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match satisfies, over lower-case text."""

    def of(items) -> Query:
        parts, run = [], {""}
        for item in items:
            own = _strings(item)
            if own is not None and len(run) * len(own) <= _MOST_STRINGS:
                run = {a + b for a in run for b in own}
                continue
            parts.append(_of_strings(run))
            run = own or {""}
            if own is None:
                kind, value = item
                if kind is op.SUBPATTERN:
                    parts.append(of(value[3]))
                elif kind is op.BRANCH:
                    parts.append(_any([of(p) for p in value[1]]))
                elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
                    parts.append(of(value[2]))
        return _all([*parts, _of_strings(run)])

    return of(parser.parse(pattern))


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "t" else set().union(*(trigrams_of(q) for q in query[1:]))


def _ids(query: Query, postings: Column, of_type: str) -> Column:
    """The ids of a block that satisfy a query."""
    if query[0] == "t":
        return F.coalesce(F.try_element_at(postings, F.lit(query[1])), F.array().cast(of_type))
    parts = [_ids(q, postings, of_type) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
    return out


def build_index(docs: DataFrame, trigrams: set[str], block_docs: int = 4096) -> DataFrame:
    """block, postings (map from trigram to distinct ids). ``docs`` has doc_id and text."""
    blocks = max(1, -(-docs.count() // block_docs))
    named = F.array(*(F.lit(t) for t in sorted(trigrams)))
    lower = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    rows = lower.select("doc_id", F.explode(F.filter(named, lambda t: F.contains(F.col("low"), t))).alias("trigram"))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    lists = rows.groupBy(block, "trigram").agg(F.collect_set("doc_id").alias("ids"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("postings"))


def candidates(index: DataFrame, queries: dict[str, Query], id_type: str) -> DataFrame:
    """doc_id, kinds: the rules whose query an id satisfies."""
    def pairs_of(kind: str) -> Column:
        return F.transform(_ids(queries[kind], F.col("postings"), f"array<{id_type}>"), lambda i: F.struct(i.alias("doc_id"), F.lit(kind).alias("kind")))

    pairs = [pairs_of(kind) for kind in queries]
    return index.select(F.explode(F.concat(*pairs)).alias("c")).select("c.*").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _place(words: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(64 * words))


def bitmap(ids: DataFrame, words: int = 1 << 17) -> DataFrame:
    """One row with ``bits``: a bitmap of hashed ids, of a fixed size (a megabyte) however many there are.

    It may mark ids that are not there, the more the fuller it is, but never leaves one out.
    """
    at = _place(words)
    set_bits = ids.select(F.floor(at / 64).alias("id"), at.alias("at")).groupBy("id").agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits"))
    full = ids.sparkSession.range(words).join(set_bits, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bits"))


def in_bitmap(bits: Column, words: int = 1 << 17) -> Column:
    """Whether the bit of doc_id is set."""
    at = _place(words)
    return F.get(bits, F.floor(at / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))) != 0


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and spans (kind, order of the rule, start, end, base) of every row."""
    frame = slim(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    id_type = frame.schema["doc_id"].dataType.simpleString()
    found = frame
    if indexed:
        index = build_index(frame, set().union(*map(trigrams_of, indexed.values())))
        named = written(candidates(index, indexed, id_type))
        bits = bitmap(named)
        # Rows that cannot be candidates stay where they are; only the others' texts are shuffled, to meet their kinds.
        likely = F.coalesce(F.col("doc_id").isNotNull() & in_bitmap(bits.scalar()), F.lit(False))
        rest = frame.where(~likely).withColumn("kinds", F.lit(None).cast("array<string>"))
        found = frame.where(likely).join(named, "doc_id", "left").select("doc_id", "text", "kinds").unionByName(rest)
    parts = [_rule_spans(order, r, r.kind in indexed) for order, r in enumerate(rules)]
    return found.select("doc_id", F.concat(*parts).alias("spans"))


def _rule_spans(order: int, rule: Rule, by_index: bool) -> Column:
    own = spans.find(F.col("text"), rule.pattern, rule.group)
    if by_index:
        own = F.when(F.col("doc_id").isNull() | F.array_contains("kinds", rule.kind), own).otherwise(F.array().cast(spans.SPAN))
    if rule.least:
        own = F.filter(own, lambda s: F.length(s["text"]) >= rule.least)
    base = rule in BASE
    return F.transform(own, lambda s: F.struct(F.lit(rule.kind).alias("kind"), F.lit(order).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base")))
