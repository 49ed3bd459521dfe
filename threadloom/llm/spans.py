"""Spans of regular expressions in DataFrame functions alone, in time that grows with n log n for n matches of a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,text:string,before:string,after:string>>"
#: Each round widens what is joined by this factor; seven rounds do for any text, which has fewer than 2 ** 31 bytes.
_WIDER, _ROUNDS = 16, 7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For every place of an array the joined values up to there, by rounds of wider reach: a fold that appends would copy the
    array each time."""

    def widened(a: Column, step: int) -> Column:
        back = lambda i: F.sequence(F.lit(1), F.least(F.lit(_WIDER - 1), F.floor(i / step).cast("int")))
        return F.when(F.size(a) > step, F.transform(a, lambda x, i: F.when(i < step, x).otherwise(F.aggregate(back(i), x, lambda acc, j: join(F.get(a, i - j * step), acc))))).otherwise(a)

    def rounds(a: Column, k: int) -> Column:
        return a if k == _ROUNDS else let(widened(a, _WIDER**k), lambda b: rounds(b, k + 1))

    return let(values, lambda a: rounds(a, 0))


def find(text: Column, pattern: str, group: int = 0, context: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches nothing: start and end (code points), text of a group,
    and up to ``context`` characters before and after, no farther than the neighbouring matches.

    The text between matches and the matches themselves alternate, so running lengths give the places.
    """
    nothing = F.lit("")
    near = lambda gap, at: F.substring(gap, at, context) if context else nothing

    def of(gaps: Column, found: Column, named: Column) -> Column:
        ends = running(F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("bigint")), lambda a, b: a + b)
        return F.transform(
            F.arrays_zip(found.alias("match"), named.alias("text"), ends.alias("end")),
            lambda x, i: F.struct(
                (x["end"] - F.length(x["match"])).alias("start"),
                x["end"].alias("end"),
                x["text"].alias("text"),
                near(F.get(gaps, i), -context).alias("before"),
                near(F.get(gaps, i + 1), 1).alias("after"),
            ),
        )

    every = lambda n: F.regexp_extract_all(text, F.lit(pattern), F.lit(n))
    spans = let(F.split(text, pattern, -1), lambda gaps: let(every(0), lambda found: of(gaps, found, every(group) if group else found)))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def merged(spans: Column) -> Column:
    """Spans (start, end, kind) without overlaps: those that meet are one, of the kind that begins first (then of the lower order)."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def of(s: Column, far: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda y: (y["i"] == 0) | (y["x"]["start"] >= F.get(far, y["i"] - 1)))
        last = lambda b, k: F.coalesce(F.get(b, k + 1)["i"], F.size(s)) - 1
        return let(begins, lambda b: F.transform(b, lambda y, k: F.struct(y["x"]["start"].alias("start"), F.get(far, last(b, k)).alias("end"), y["x"]["kind"].alias("kind"))))

    return let(ordered, lambda s: let(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda far: of(s, far)))


def replaced(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap are replaced as one."""

    def of(m: Column, chars: Column) -> Column:
        piece = lambda a, b: F.array_join(F.slice(chars, a.cast("int") + 1, (b - a).cast("int")), "")
        before = F.transform(m, lambda x, k: F.concat(piece(F.coalesce(F.get(m, k - 1)["end"], F.lit(0)), x["start"]), F.lit("<"), x["kind"], F.lit(">")))
        return F.concat(F.array_join(before, ""), piece(F.get(m, F.size(m) - 1)["end"], F.size(chars)))

    return F.when(F.size(spans) > 0, let(merged(spans), lambda m: let(F.split(text, ""), lambda chars: of(m, chars)))).otherwise(text)


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined, by start, then kind number, then end. Spans have start, order, end, kind."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
