"""Reply threads: roots by pointer doubling, thread summaries, nested threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.durable import written


def first_rows(messages: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one that comes first."""
    return messages.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")


def roots(messages: DataFrame, node: str = "message_id", parent: str = "parent_id") -> DataFrame:
    """node, root, cyclic. Following parents, a root is a node without a parent that is present; all nodes that end in a
    cycle have its smallest id, compared as strings. Every step doubles how far each node sees.

    Tables of ids are small as files and large in memory, so their joins are told not to send one side around by the files' size.
    """
    links = messages.select(F.col(node).cast("string").alias("id"), F.col(parent).cast("string").alias("up")).dropDuplicates(["id"])
    present = links.select(F.col("id").alias("up"), F.lit(True).alias("has"))
    state = links.join(present.hint("merge"), "up", "left").select("id", F.when(F.col("has"), F.col("up")).otherwise(F.col("id")).alias("ptr"), F.col("id").alias("low"), F.coalesce("has", F.lit(False)).alias("has"))
    state, steps = written(state), 1
    ends = state.where(~F.col("has")).select(F.col("id").alias("ptr"))
    total = state.count()
    while (1 << steps) < 2 * total and not state.join(ends.hint("merge"), "ptr", "left_anti").isEmpty():
        other = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("far"))
        state = written(state.join(other.hint("merge"), "ptr").select("id", F.col("next").alias("ptr"), F.least("low", "far").alias("low"), "has"))
        steps += 1
    last = state.select(F.col("id").alias("ptr"), F.col("has").alias("cyclic"), F.col("low").alias("least"))
    return state.join(last.hint("merge"), "ptr").select(F.col("id").alias("node"), F.when(F.col("cyclic"), F.col("least")).otherwise(F.col("ptr")).alias("root"), "cyclic")


def summary(messages: DataFrame, thread: str = "conv_id", node: str = "message_id", parent: str = "parent_id", inbound: str = "inbound", author: str = "author") -> DataFrame:
    """One row of counters over all messages and threads."""
    m = messages
    counts = m.agg(
        F.count("*").alias("messages"),
        F.count_if(F.col(inbound)).alias("inbound_messages"),
        F.count_if(~F.col(inbound)).alias("outbound_messages"),
        F.count_if(F.col(inbound).isNull()).alias("unknown_direction"),
        F.count_distinct(author).alias("authors"),
        F.count_if(F.col(parent) == F.col(node)).alias("self_references"),
    )
    ids = m.select(F.col(node).alias("_p"))
    linked = m.join(ids, F.col(parent) == F.col("_p"), "left_semi").agg(F.count("*").alias("linked"))
    orphans = m.where(F.col(parent).isNotNull()).join(ids, F.col(parent) == F.col("_p"), "left_anti").agg(F.count("*").alias("orphans"))
    sizes = m.groupBy(thread).count().agg(
        F.count("*").alias("threads"),
        F.count_if(F.col("count") == 1).alias("single_message"),
        F.count_if(F.col("count") == 2).alias("two_message"),
        F.count_if(F.col("count") >= 3).alias("multi_turn"),
    )
    branching = m.where(F.col(parent).isNotNull()).groupBy(parent).agg(F.count("*").alias("n"), F.first(thread).alias("t")).where("n > 1").agg(F.count_distinct("t").alias("branching_threads"))
    for one in (linked, orphans, sizes, branching):  # each is one row
        counts = counts.join(F.broadcast(one))
    return counts


def linked_pairs(messages: DataFrame) -> DataFrame:
    """brand, customer_message: inbound messages next to a brand's message, in either direction, once."""
    out = messages.where(~F.col("inbound")).select("brand", F.col("message_id").alias("b"), F.col("parent_id").alias("b_parent"))
    inb = messages.where(F.col("inbound")).select(F.col("message_id").alias("c"), F.col("parent_id").alias("c_parent"))
    answers = out.join(inb, F.col("b_parent") == F.col("c")).select("brand", F.col("c").alias("customer_message"))
    asked = out.join(inb, F.col("c_parent") == F.col("b")).select("brand", F.col("c").alias("customer_message"))
    return answers.union(asked).distinct()


def nested(messages: DataFrame) -> DataFrame:
    """Per thread: its turns in order as an array of structs, and counts; threads need a brand's and a customer's message."""
    turn = F.struct("turn", "message_id", "inbound", "text", "parent_id")
    threads = messages.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"),
        F.count("*").alias("message_count"),
        F.count_if(F.col("inbound")).alias("customer_messages"),
        F.count_if(~F.col("inbound")).alias("brand_messages"),
    )
    return threads.where((F.col("customer_messages") > 0) & (F.col("brand_messages") > 0))


def role_text(turns: Column, inbound: bool) -> Column:
    """The texts of one side, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["inbound"] == F.lit(inbound)), lambda t: t["text"]), " ")


def inconsistent_children(messages: DataFrame, references: DataFrame) -> DataFrame:
    """References (source, child) whose child is present but names another parent, or none."""
    m = messages.select(F.col("message_id").alias("child"), "parent_id")
    return references.join(m, "child").where(~F.col("parent_id").eqNullSafe(F.col("source"))).select("source", "child")


def inversions(messages: DataFrame, time: str = "turn") -> DataFrame:
    """Messages that are older than their parent."""
    p = messages.select(F.col("message_id").alias("parent_id"), F.col(time).alias("_t"))
    return messages.join(p, "parent_id").where(F.col(time) < F.col("_t")).select("message_id", "parent_id")


def missing_children(messages: DataFrame, references: DataFrame) -> DataFrame:
    """References (source, child) whose child is not there."""
    return references.join(messages.select(F.col("message_id").alias("child")), "child", "left_anti").select("source", "child")


def quality(messages: DataFrame, references: DataFrame, found: DataFrame, time: str = "turn") -> DataFrame:
    """One row of counters over messages, child references (source, child) and roots (node, root, cyclic), anomalies included.

    Ids are compared as strings, as roots have them.
    """
    m = messages.withColumns({"message_id": F.col("message_id").cast("string"), "parent_id": F.col("parent_id").cast("string")})
    refs = references.select(F.col("source").cast("string").alias("source"), F.col("child").cast("string").alias("child")).distinct()
    base = summary(m.join(found.select(F.col("node").alias("message_id"), "root"), "message_id"), thread="root").drop("branching_threads")
    branches = m.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("node")).agg(F.count("*").alias("n")).where("n > 1")
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    for one in (
        count(m.where(F.col("parent_id").isNull()), "root_messages"),
        count(refs, "child_references"),
        count(missing_children(m, refs), "missing_children"),
        count(inconsistent_children(m, refs), "inconsistent_children"),
        count(inversions(m, time), "chronological_inconsistencies"),
        found.join(branches, "node").agg(F.count_distinct("root").alias("branching_threads")),
        found.where("cyclic").agg(F.count_distinct("root").alias("cyclic_components")),
    ):
        base = base.join(F.broadcast(one))  # each is one row
    return base


def with_roots(messages: DataFrame, found: DataFrame) -> DataFrame:
    """Messages with root, cyclic and the size of their thread."""
    m = messages.withColumn("node", F.col("message_id").cast("string")).join(found, "node")
    return m.join(found.groupBy("root").agg(F.count("*").alias("thread_size")), "root").drop("node")


def timed(threads: DataFrame, time: str = "turn") -> DataFrame:
    """Threads all of whose turns have a time."""
    return threads.where(F.forall("turns", lambda t: t[time].isNotNull()))
