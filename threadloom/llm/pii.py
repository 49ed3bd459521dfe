"""Personal data by weak supervision, in DataFrame functions alone.

Candidate spans come from loose regular expressions. Three labelers vote on each candidate: the strict form of its kind, a
gazetteer of what real values begin or end with, and cue words around it. Votes are counted by pattern, and
expectation-maximisation on these counts estimates how reliable each labeler is and how likely each pattern is personal data.
A logistic span classifier is then trained on those estimates; besides votes it sees the span's shape and neighbours, so that
it can tell spans apart on which the labelers agree. A candidate counts if the classifier gives it one half or more.
Candidates of the four base kinds always count.

Every count is over all documents and whole texts. Nothing of the texts is shuffled: only counts are, by kind, votes and shape,
of which there are at most ``len(KINDS) * 27 * 16``.

Cases: null texts are empty; texts without candidates give empty lists; with no candidates at all nothing is trained;
candidates of other kinds that overlap a base span are left out; ties between spans go by start, then kind; repeated rows are
handled row by row; ids are only passed on, of any type; long texts take time in proportion but for a logarithm; columns
beside the named ones are ignored, and those of ``keep`` may have any name but doc_id, text and spans.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import spans
from threadloom.llm.common import slim
from threadloom.llm.spans import let, running

#: First names of the gazetteer, domain ends, calling codes and country codes.
FIRST_NAMES = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Sandra Paul Ashley Steven Emily Andrew Michelle Kenneth Amanda Pierre Camille Claude Sophie Hans Ursula Klaus Ingrid Carlos Carmen Miguel Pilar".split()
FAMILY_NAMES = "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Mueller Schmidt Schneider Fischer Weber Meyer Wagner Becker Dubois Moreau Laurent Lefebvre Leroy Roux Bernard Petit Durand".split()
DOMAIN_ENDS = "com org net edu gov mil int info biz io co us uk de fr es it nl eu ch at be se no dk fi pl pt ie ca au nz jp cn in br mx ru".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split()


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds candidates, ``need`` is a cheap test that a text may have one; the other fields are regexes.

    ``cues`` vote for what they stand before, ``against`` (before or after) against it.
    """

    name: str
    need: str
    pattern: str
    strict: str
    gazetteer: str
    cues: str
    base: bool = False
    against: str = "(?!)"


_DIGIT = "[0-9]"
#: The base patterns are written so that no position is tried twice: possessive runs, and starts only where a run starts.
KINDS = (
    Kind("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"^[A-Za-z0-9][^@]*@[A-Za-z0-9].*\.[A-Za-z]{2,24}$", r"(?i)\.(?:" + "|".join(DOMAIN_ENDS) + ")$", "mail|contact|write|reach", True),
    Kind("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"^(?!0)(?:(?:0|[1-9][0-9]*)\.){3}(?:0|[1-9][0-9]*)$", r"^(?!0\.|127\.|22[4-9]\.|2[3-5][0-9]\.)", r"\bip\b|address|host|server|from", True),
    Kind("card", "", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])", r"^[2-6]", r"^(?:4|5[1-5]|2[2-7]|3[47]|6[05])", "card|visa|credit|pay|account", True),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", r"^\+[1-9][0-9]{0,2}[ .(-]", r"^\+(?:" + "|".join(CALLING_CODES) + ")", "tel|phone|call|fax|mobile", True),
    Kind("national_id", "-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"^(?!0|9)", r"ssn|social|security"),
    Kind("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", r"^[A-Z]{2}(?!0[01])[0-9]{2}[A-Z]{0,4}[0-9]{8,}", "^(?:" + "|".join(COUNTRIES) + ")", "iban|bank|account|transfer"),
    Kind("name", "", r"(?<![\p{L}\p{N}])(?!(?:Dear|Mr|Mrs|Ms|Dr|Prof|Name|Signed|Regards|Sincerely|Contact|Attn|The|An?)\b)[A-Z][a-z]{1,20}\x20(?:[A-Z]\.\x20)?[A-Z][a-z]{1,20}(?![\p{L}\p{N}])", r"^[A-Z][a-z]*[aeiouy][a-z]* (?:[A-Z]\. )?[A-Z][a-z]*[aeiouy][a-z]*$", r"^(?:" + "|".join(FIRST_NAMES) + ") | (?:" + "|".join(FAMILY_NAMES) + ")$", r"\b(?:mr|mrs|ms|dr|prof|name|signed|regards|dear|sincerely|attn|contact|i am)\b[.:,]?\s*$", against=r"(?:the|a|an)\s$|^\s(?:street|road|avenue|inc|ltd|university|city|river|day)\b"),
)
LABELERS = ("strict", "gazetteer", "context")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits in a string have a Luhn sum divisible by ten."""
    reverse = F.reverse(_digits(value))
    digit = lambda i: F.substr(reverse, i, F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(reverse)), part), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """What the base asks of a match beyond its pattern; failing matches are dropped."""
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.substr(short(p), F.lit(1), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: int = -1) -> Column:
    return F.when(yes, 1).otherwise(no)


#: Questions about a span and its neighbours, each one bit of its shape.
SHAPES = (
    lambda s: (s["before"] == "") | s["before"].rlike(r"[\s(\[\"':,;=<]$"),
    lambda s: (s["after"] == "") | s["after"].rlike(r"^[\s)\]\"':,;.!?>]"),
    lambda s: s["end"] - s["start"] >= 14,
    lambda s: s["before"].rlike(r"(?:^|\n)\s*$"),
)


def _of_kind(order: int, kind: Kind, text: Column) -> Column:
    """The candidates of a kind, with votes and shape."""
    need = F.contains(text, F.lit(kind.need)) if kind.need else text.rlike(_DIGIT) if kind.name != "name" else F.lit(True)
    found = F.when(need, spans.find(text, kind.pattern, context=40)).otherwise(F.array().cast(spans.SPAN))
    valid = F.filter(found, lambda s: _valid(kind.name, s["text"]))

    def context(s: Column) -> Column:
        before, after = F.lower(s["before"]), F.lower(s["after"])
        return F.when(before.rlike(kind.against) | after.rlike(kind.against), -1).when(before.rlike(kind.cues), 1).otherwise(0)

    return F.transform(
        valid,
        lambda s: F.struct(
            F.lit(kind.name).alias("kind"),
            F.lit(order).alias("order"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(kind.base).alias("base"),
            F.array(_vote(s["text"].rlike(kind.strict)), _vote(s["text"].rlike(kind.gazetteer)), context(s)).alias("votes"),
            sum((F.when(ask(s), 1 << k).otherwise(0) for k, ask in enumerate(SHAPES)), F.lit(0)).alias("shape"),
        ),
    )


def _free(base: Column, more: Column) -> Column:
    """``more`` without what overlaps any of ``base``: one pass over both in order, with the farthest end of base spans so far
    and the nearest start of those to come."""
    key = lambda s: F.struct(s["start"].alias("start"), (~s["base"]).alias("late"), s.alias("span"))

    def of(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.when(x["span"]["base"], x["span"]["end"]).otherwise(F.lit(-1).cast("bigint"))), lambda a, b: F.greatest(a, b))
        starts = F.transform(F.reverse(both), lambda x: F.when(x["span"]["base"], x["start"]).otherwise(F.lit((1 << 62))))
        nearest = F.reverse(running(starts, lambda a, b: F.least(a, b)))
        numbered = F.transform(both, lambda x, i: F.struct(i.alias("i"), x["span"].alias("span")))
        keep = lambda e, n: F.filter(numbered, lambda y: ~y["span"]["base"] & (F.get(e, y["i"]) <= y["span"]["start"]) & (F.get(n, y["i"]) >= y["span"]["end"]))
        return F.transform(let(ends, lambda e: let(nearest, lambda n: keep(e, n))), lambda y: y["span"])

    return F.when((F.size(more) == 0) | (F.size(base) == 0), more).otherwise(let(F.sort_array(F.transform(F.concat(base, more), key)), of))


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """_id, _given (the text as it was), _text, candidates and the columns ``keep``, as _0, _1 and so on, of every row."""
    own = [f"_{k}" for k in range(len(keep))]
    frame = slim(docs, _id=doc_id, _given=text, **dict(zip(own, keep))).select("_id", "_given", *own, F.coalesce("_given", F.lit("")).alias("_text"))
    base = F.concat(*(_of_kind(n, k, F.col("_text")) for n, k in enumerate(KINDS) if k.base))
    more = F.concat(*(_of_kind(n, k, F.col("_text")) for n, k in enumerate(KINDS) if not k.base))
    frame = frame.select("_id", "_given", *own, base.alias("base"), more.alias("more"))
    return frame.select("_id", "_given", *own, F.concat("base", _free(F.col("base"), F.col("more"))).alias("candidates"))


def estimate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over vote patterns: how likely each (kind, votes) is personal data.

    Each labeler has, for either truth, a probability of every vote; each kind has its own share of true candidates.
    """
    kinds = sorted({k for k, _ in counts})
    base = {k.name for k in KINDS if k.base}
    prior = {kind: 7 if kind in base else 3 for kind in kinds}
    share = {kind: prior[kind] / 10 for kind in kinds}
    votes = (-1, 0, 1)
    chance = [{True: {-1: 0.15, 0: 0.25, 1: 0.6}, False: {-1: 0.6, 0: 0.25, 1: 0.15}} for _ in LABELERS]
    belief: dict = {}
    for _ in range(rounds):
        for key in counts:
            odds = log(share[key[0]] / (1 - share[key[0]])) + sum(log(c[True][v] / c[False][v]) for c, v in zip(chance, key[1]))
            belief[key] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        for kind in kinds:
            own = [(n, belief[k]) for k, n in counts.items() if k[0] == kind]
            share[kind] = (sum(n * b for n, b in own) + prior[kind]) / (sum(n for n, _ in own) + 10)
        for j, c in enumerate(chance):
            for truth in (True, False):
                weight = {v: 3.0 if (v == 1) == truth and v else 1.0 for v in votes}
                for key, n in counts.items():
                    weight[key[1][j]] += n * (belief[key] if truth else 1 - belief[key])
                total = sum(weight.values())
                c[truth] = {v: w / total for v, w in weight.items()}
    return belief


def features(kind: str, votes: tuple[int, ...], shape: int) -> list[str]:
    """The classifier's active features: kind, each labeler's vote, and each bit of the shape by kind."""
    return ["bias", kind, *(f"{x}{v}" for x, v in zip(LABELERS, votes)), *(f"{kind}/{k}" for k in range(len(SHAPES)) if shape >> k & 1)]


def classifier(counts: dict, belief: dict, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic span classifier: ``counts`` by (kind, votes, shape), taught by ``belief`` by (kind, votes)."""
    active, total = {key: features(*key) for key in counts}, sum(counts.values())
    weights = dict.fromkeys((n for own in active.values() for n in own), 0.0)
    for _ in range(rounds):
        slope = {n: -ridge * w for n, w in weights.items()}
        for key, n in counts.items():
            p = 1 / (1 + exp(-sum(weights[a] for a in active[key])))
            for a in active[key]:
                slope[a] += n / total * (belief[key[:2]] - p)
        for n in weights:
            weights[n] += rate * slope[n]
    return weights


def train(found: DataFrame) -> dict[str, float]:
    """The classifier's weights, from the votes and shapes of all candidates."""
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.shape").count().collect()
    counts = {(r.kind, tuple(r.votes), r.shape): r["count"] for r in rows}
    patterns: dict = {}
    for (kind, votes, _), n in counts.items():
        patterns[kind, votes] = patterns.get((kind, votes), 0) + n
    return classifier(counts, estimate(patterns)) if counts else {}


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """doc_id, text, spans (kind, order, start, end, base, score) and the columns ``keep`` of every row."""
    found = candidates(docs, doc_id, text, keep)
    weights = train(found)
    weight = lambda name: F.lit(weights.get(name, 0.0))

    def score(s: Column) -> Column:
        of_kind = F.lit(0.0)
        for k in KINDS:
            own = weight(k.name)
            for b in range(len(SHAPES)):
                own = own + F.when(s["shape"].bitwiseAND(1 << b) > 0, weight(f"{k.name}/{b}")).otherwise(0.0)
            of_kind = F.when(s["kind"] == k.name, own).otherwise(of_kind)
        logit = of_kind + weight("bias")
        for j, name in enumerate(LABELERS):
            vote = s["votes"][j]
            logit = logit + F.when(vote == 1, weight(f"{name}1")).when(vote == 0, weight(f"{name}0")).otherwise(weight(f"{name}-1"))
        return 1 / (1 + F.exp(-logit))

    scored = F.transform("candidates", lambda s: F.struct(s["kind"].alias("kind"), s["order"].alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), score(s).alias("score")))
    kept = F.filter(scored, lambda s: s["base"] | (s["score"] >= 0.5)).alias("spans")
    return found.select(F.col("_id").alias("doc_id"), F.col("_given").alias("text"), *(F.col(f"_{k}").alias(n) for k, n in enumerate(keep)), kept)


def redact(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap are replaced as one."""
    return spans.replaced(text, found)
