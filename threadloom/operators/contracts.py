"""Contracts as data: violations, id-set checks, merges of keyed stores, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule for every rule (true: broken) that a row breaks, and for keys that occur twice."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), name) for name, test in rules.items())))
    found = rows.select(F.col(key).alias("key"), F.explode(broken).alias("rule"))
    twice = rows.groupBy(F.col(key).alias("key")).count().where("count > 1").select("key", F.lit("DUPLICATE_KEY").alias("rule"))
    return found.unionByName(twice)


def id_digest(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Per group: SHA-256 of its sorted distinct ids, one a line. Ids are sorted as strings."""
    ids = F.array_join(F.sort_array(F.collect_set(F.col(key).cast("string"))), "\n")
    return rows.groupBy(group).agg(F.count_distinct(key).alias("ids"), F.sha2(ids, 256).alias("digest"))


def digest_tree(rows: DataFrame, key: str, group: str, fanout: int = 256) -> DataFrame:
    """group, ids, digest: a digest of each group's distinct ids, as strings, for groups of any size.

    A tree of hashes with a fixed shape: leaf k of a group holds the ids whose SHA-256 begins with the two bytes k, sorted, one a line;
    a parent is the hash of its children's, ``fanout`` of them by number, and lists which they are. So no row holds a group: a leaf
    has a 65,536th of it, and equal sets have equal digests whatever their order or partitioning.
    """
    levels, leaves = [], 1 << 16
    while leaves > 1:
        leaves = -(-leaves // fanout)
        levels.append(leaves)
    text = F.col(key).cast("string")
    ids = rows.select(group, text.alias("id")).where("id IS NOT NULL").distinct().withColumn("node", F.conv(F.substr(F.sha2("id", 256), F.lit(1), F.lit(4)), 16, 10).cast("int"))
    tree = ids.groupBy(group, "node").agg(F.count("id").alias("ids"), F.sha2(F.array_join(F.sort_array(F.collect_list("id")), "\n"), 256).alias("digest"))
    for _ in levels:
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        lines = F.array_join(F.transform(children, lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["digest"])), "\n")
        tree = tree.groupBy(group, F.floor(F.col("node") / fanout).cast("int").alias("node")).agg(F.sum("ids").alias("ids"), F.sha2(lines, 256).alias("digest"))
    return tree.select(group, "ids", "digest")


def insert_only(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with the new rows whose key it lacks."""
    return stored.unionByName(new.join(stored.select(key), key, "left_anti").select(stored.columns))


def replace_only(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The store with the rows replaced whose key it has."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new.join(stored.select(key), key, "left_semi").select(stored.columns))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def cache_key(rows: DataFrame, columns: list[str]) -> Column:
    """The content address of a row: SHA-256 over its named columns as JSON, by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def uncached(rows: DataFrame, cache: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("cache_key", cache_key(rows, columns)).join(cache.select("cache_key"), "cache_key", "left_anti")


def reconcile(labels: DataFrame, cases: DataFrame, key: str, least: int) -> DataFrame:
    """labels, enough (at least so many), unknown (labels of no case) and unlabelled (cases without a label), by distinct key."""
    own, all_keys = labels.select(key).distinct(), cases.select(key).distinct()
    unknown = own.join(all_keys, key, "left_anti").agg(F.count("*").alias("unknown"))
    missing = all_keys.join(own, key, "left_anti").agg(F.count("*").alias("unlabelled"))
    found = own.agg(F.count("*").alias("labels")).withColumn("enough", F.col("labels") >= least)
    return found.join(F.broadcast(unknown)).join(F.broadcast(missing))  # one row each


def keyed_once(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, if every key is there and there once; an error otherwise."""
    bad = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"{key} {bad[0][key]!r} occurs {bad[0].n} times")
    return rows


def assert_disjoint(rows: DataFrame, protected: DataFrame, key: str, what: str) -> None:
    """An error if any row has a protected key."""
    found = rows.join(protected.select(key), key, "left_semi").limit(1).collect()
    if found:
        raise ValueError(f"{what} has the protected {key} {found[0][key]!r}")


def probability_sums(rows: DataFrame, key: str, probabilities: str) -> DataFrame:
    """Keys whose class probabilities do not sum to 1."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, b: a + b)
    return rows.where(F.abs(total - 1) > 1e-6).select(key, total.alias("total"))


def result_schema(fields: dict[str, str], enums: dict[str, list[str]], bounds: dict[str, tuple[int, int]]) -> dict:
    """The JSON schema of a judge's answer: exactly these fields, with their values or bounds."""
    kinds = {"int": "integer", "string": "string", "boolean": "boolean", "array<string>": "array"}

    def one(name: str, kind: str) -> dict:
        own: dict = {"type": kinds[kind]}
        if name in bounds:
            own |= dict(zip(("minimum", "maximum"), bounds[name]))
        if name in enums:
            own |= {"items": {"type": "string", "enum": enums[name]}, "uniqueItems": True} if kind.startswith("array") else {"enum": enums[name]}
        return own

    return {"type": "object", "additionalProperties": False, "required": list(fields), "properties": {n: one(n, k) for n, k in fields.items()}}
