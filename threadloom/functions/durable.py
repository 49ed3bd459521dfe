"""Tables between the steps of iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType, UserDefinedType


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application that driver and executors share: in ``spark.checkpoint.dir``, else in the warehouse.

    Everything there may be deleted once the application has ended. On a cluster a warehouse on a local disk is an error, as executors
    would write to their own.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir")
        if not shared(top, spark.sparkContext.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors see: the warehouse {top} is on a local disk")
    return f"{top}/threadloom-{spark.sparkContext.applicationId}"


def shared(path: str, master: str) -> bool:
    """Whether all processes of an application see the path: any does in local mode; on a cluster it must name a file system that is not local."""
    return master.startswith("local") or ("://" in path and not path.startswith("file:"))


def written(df: DataFrame, kinds: dict[str, UserDefinedType] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and survives lost executors. ``kinds``: columns that are read as these types, which store what the columns have."""
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/{uuid.uuid4().hex}", StructType([StructField(f.name, (kinds or {}).get(f.name, f.dataType), f.nullable, f.metadata) for f in df.schema])
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out over four tasks a core, for work that is heavy by row: files of few row groups would be read, and worked on, in few tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def forget(spark: SparkSession) -> None:
    """Deletes what ``written`` has left, for the end of an application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
