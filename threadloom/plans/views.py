"""Views of the driver's tables as support conversations, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.sources.tables import table


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages that answer the turn before."""
    c = table(spark, sf_dir, "conversations")
    number = (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id")
    m = c.select("conv_id", "turn", number, F.when(F.col("role") == "user", True).when(F.col("role") == "assistant", False).alias("inbound"), F.concat(F.lit("brand_"), (F.col("conv_id") % 5).cast("string")).alias("brand"), "text")
    author = F.when(F.col("inbound"), F.concat(F.lit("c_"), F.col("conv_id").cast("string"))).when(~F.col("inbound"), F.col("brand"))
    return m.withColumn("parent_id", F.lag("message_id").over(Window.partitionBy("conv_id").orderBy("turn"))).withColumn("author", author)


MSGS = """m AS (SELECT conv_id, turn, conv_id * 1000 + turn AS message_id,
  CASE role WHEN 'user' THEN TRUE WHEN 'assistant' THEN FALSE END AS inbound, 'brand_' || (conv_id % 5) AS brand, text,
  lag(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_id,
  CASE role WHEN 'user' THEN 'c_' || conv_id WHEN 'assistant' THEN 'brand_' || (conv_id % 5) END AS author FROM conversations)"""


def with_faults(m: DataFrame) -> DataFrame:
    """Some first messages answer a missing one, themselves, or the last of their own thread, which makes a cycle; some fourth
    ones answer the second, which makes a branch."""
    last = F.max("message_id").over(Window.partitionBy("conv_id"))
    parent = F.when((F.col("turn") == 0) & (F.col("conv_id") % 7 == 0), last).when((F.col("turn") == 0) & (F.col("conv_id") % 11 == 0), F.lit(-1)).when((F.col("turn") == 0) & (F.col("conv_id") % 13 == 0), F.col("message_id")).when((F.col("turn") == 3) & (F.col("conv_id") % 5 == 0), F.col("message_id") - 2).otherwise(F.col("parent_id"))
    return m.withColumn("parent_id", parent)


#: The same in SQL, after MSGS.
FAULTS = """f AS (SELECT conv_id, turn, inbound, author, brand, text, message_id::VARCHAR AS id, (CASE WHEN turn = 0 AND conv_id % 7 = 0 THEN max(message_id) OVER (PARTITION BY conv_id)
  WHEN turn = 0 AND conv_id % 11 = 0 THEN -1 WHEN turn = 0 AND conv_id % 13 = 0 THEN message_id WHEN turn = 3 AND conv_id % 5 = 0 THEN message_id - 2 ELSE parent_id END)::VARCHAR AS up FROM m)"""

SPLIT_OF = "CASE doc_id % 3 WHEN 0 THEN 'TRAIN' WHEN 1 THEN 'DEVELOPMENT' ELSE 'GOLD' END"


def split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % 3 == 0, "TRAIN").when(F.col("doc_id") % 3 == 1, "DEVELOPMENT").otherwise("GOLD")
    return docs.select("doc_id", "text", "lang", "source", split.alias("split"))


#: Normalisations in DuckDB's dialect. ``{}`` is the text.
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), 'https?://\S+|www\.\S+', '<url>', 'g'), '@[a-z0-9_]+', '<mention>', 'g'), '\s+', ' ', 'g'), ' ')"
LEAK = r"trim(regexp_replace(regexp_replace(" + NORM + r", '\b[0-9]{{5,}}\b', '<number>', 'g'), '\s+', ' ', 'g'), ' ')"
WORDS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+(?:''+[\p{{L}}\p{{N}}_]+)*'))"
