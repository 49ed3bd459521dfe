"""Intent rules over a small taxonomy, and provisional labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx


@dataclass(frozen=True)
class Intent:
    name: str
    signals: tuple[str, ...]


@dataclass(frozen=True)
class Taxonomy:
    intents: tuple[Intent, ...]
    default: str

    def __post_init__(self) -> None:
        names = [i.name for i in self.intents]
        if len(set(names)) != len(names) or self.default not in names:
            raise ValueError("intents need unique names, one of them the default")


def scores(text: Column, taxonomy: Taxonomy, bounded: bool = False) -> list[Column]:
    """For every intent, how many of its signals the text has."""
    low = F.lower(text)
    hit = (lambda s: tx.signal_present(text, s)) if bounded else (lambda s: F.contains(low, F.lit(s)))
    return [sum((hit(s).cast("int") for s in i.signals), F.lit(0)) for i in taxonomy.intents]


def provisional_intent(text: Column, taxonomy: Taxonomy) -> Column:
    """The intent with most signals; the first in the taxonomy of equals; the default without any."""
    best = F.array_max(F.array(*(F.struct(s.alias("score"), F.lit(-k).alias("place"), F.lit(i.name).alias("name")) for k, (s, i) in enumerate(zip(scores(text, taxonomy), taxonomy.intents)))))
    return F.when(best["score"] > 0, best["name"]).otherwise(taxonomy.default)


def label(text: Column, taxonomy: Taxonomy, sensitive: list[str], low: float = 0.6) -> Column:
    """A struct: suggested_intent (UNSURE without or with tied signals), intent_confidence, suggested_action and flags.

    Text and scores are bound once, so that each signal is looked for once however often its score is used.
    """
    once = lambda value, body: F.transform(F.array(value), body)[0]
    places = F.array(*(F.struct(F.lit(-k).alias("place"), F.lit(i.name).alias("name")) for k, i in enumerate(taxonomy.intents)))

    def counted(lowered: Column) -> Column:
        has = lambda s: F.contains(lowered, F.lit(s)) & tx.signal_present(lowered, s)
        own = [sum((has(s).cast("int") for s in i.signals), F.lit(0)) for i in taxonomy.intents]
        few = F.size(F.regexp_extract_all(lowered, F.lit("[a-z0-9']+"), F.lit(0))) <= 5
        return F.struct(F.array(*own).alias("own"), few.alias("few"), tx.any_contains(lowered, sensitive).alias("sensitive"))

    def ranked(x: Column) -> Column:
        best = F.array_max(F.zip_with(x["own"], places, lambda s, p: F.struct(s.alias("score"), p["place"].alias("place"), p["name"].alias("name"))))
        down = F.sort_array(x["own"], asc=False)
        return F.struct(F.get(down, F.lit(0)).alias("top"), F.get(down, F.lit(1)).alias("second"), F.size(F.filter(x["own"], lambda s: s > 0)).alias("active"), best["name"].alias("name"), x["few"].alias("few"), x["sensitive"].alias("sensitive"))

    def judged(r: Column) -> Column:
        top, second, active = r["top"], r["second"], r["active"]
        unsure, tie = (top == 0) | (top == second), (top > 0) & (top == second)
        confidence = F.when(top == 0, 0.20).when(top == second, 0.35).otherwise(F.round(F.least(F.lit(0.94), 0.54 + 0.12 * top + 0.06 * (top - second)), 2))
        flags = F.array(
            F.when(tie, "INTENT_TIE"),
            F.when(r["few"], "LOW_CONTEXT"),
            F.when(confidence < low, "LOW_INTENT_CONFIDENCE"),
            F.when(~unsure & (active > 1), "MULTI_INTENT_SIGNAL"),
            F.when(top == 0, "NO_TAXONOMY_SIGNAL"),
            F.when(tie | (~unsure & (active > 1) & (top - second <= 1)), "TAXONOMY_BOUNDARY"),
        )
        escalate = unsure | r["sensitive"] | (active >= 3) | (r["name"] == taxonomy.default)
        return F.struct(
            F.when(unsure, "UNSURE").otherwise(r["name"]).alias("suggested_intent"),
            confidence.alias("intent_confidence"),
            F.when(escalate, "ESCALATE").otherwise("AUTO_HANDLE").alias("suggested_action"),
            F.array_join(F.array_compact(flags), "|").alias("flags"),
        )

    return once(F.lower(text), lambda lowered: once(counted(lowered), lambda x: once(ranked(x), judged)))


def top_tokens(rows: DataFrame, group: str, text: str, n: int) -> DataFrame:
    """group, token, rn: the n most frequent tokens of each group; ties by token."""
    counts = rows.select(group, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))).alias("token")).groupBy(group, "token").agg(F.count("*").alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "token"))).where(F.col("rn") <= n).select(group, "token", "rn")


def evidence(rows: DataFrame, group: str, key: str, text: str, seed: str, n_tokens: int, n_examples: int) -> DataFrame:
    """group, support, top_tokens and examples (ids in hash order)."""
    tokens = top_tokens(rows, group, text, n_tokens).groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "token"))), lambda x: x["token"]), " ").alias("top_tokens"))
    order = Window.partitionBy(group).orderBy(tx.hash_rank(seed, F.col(key)), key)
    first = rows.select(group, key).withColumn("k", F.row_number().over(order)).where(F.col("k") <= n_examples)
    examples = first.groupBy(group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.col(key).cast("string").alias("id")))), lambda x: x["id"]), " ").alias("examples"))
    return rows.groupBy(group).agg(F.count("*").alias("support")).join(tokens, group).join(examples, group)


def overlap(tokens: DataFrame, group: str) -> DataFrame:
    """a, b, overlap: Jaccard of the top tokens of each pair of groups, of which there are few."""
    sets = tokens.groupBy(group).agg(F.collect_set("token").alias("t"))
    a, b = sets.select(F.col(group).alias("a"), F.col("t").alias("x")), sets.select(F.col(group).alias("b"), F.col("t").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(tx.jaccard(F.col("x"), F.col("y")), 8).alias("overlap"))


def from_document(document: dict, pattern: str = r"[a-z][a-z0-9_]*") -> Taxonomy:
    """A taxonomy from its JSON document: unique well-formed ids, and examples from training data alone."""
    import re

    intents = [Intent(i["id"], tuple(i.get("common_signals", ()))) for i in document["intents"]]
    bad = [i.name for i in intents if not re.fullmatch(pattern, i.name)]
    if bad or document.get("source_split") != "TRAIN":
        raise ValueError(f"malformed ids: {bad}" if bad else "a taxonomy must come from TRAIN")
    return Taxonomy(tuple(intents), document["default_intent"])


def label_audit(labels: DataFrame, low: float = 0.6, high_risk: tuple[str, ...] = ("SECURITY", "PAYMENT", "PII")) -> DataFrame:
    """Adds what makes a label doubtful: low confidence, unsure, automatic handling despite a risky tag, a taxonomy boundary.

    ``labels`` has suggested_intent, intent_confidence, suggested_action, flags (joined by bars) and tags (an array).
    """
    return labels.withColumns(
        {
            "low_confidence": F.col("intent_confidence") < low,
            "unsure": F.col("suggested_intent") == "UNSURE",
            "contradiction": (F.col("suggested_action") == "AUTO_HANDLE") & F.arrays_overlap("tags", F.array(*map(F.lit, high_risk))),
            "boundary": F.array_contains(F.split("flags", r"\|"), "TAXONOMY_BOUNDARY"),
        }
    )
