"""Tables that cut lineage, in the folder that all executors share, and the numbering of sorted rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder of this machine, if
    the executors are threads of this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="triplespark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a table when the driver ends, if it is still there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def settle(df: DataFrame) -> DataFrame:
    """df written under spark.checkpoint.dir and read back. The table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "at", first: int = 0) -> tuple[DataFrame, int]:
    """df with its rows' numbers in this order, and how many there are: sorted by range into partitions, whose sizes shift
    the numbers within each. The result is a settled table."""
    spark, columns = df.sparkSession, df.columns
    held = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    shifts, total = [], first
    for r in held.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("low")).orderBy("_part").collect():  # one for each partition
        shifts.append((r["_part"], total - r["low"]))
        total += r["n"]
    table = spark.createDataFrame(shifts, "_part int, _shift bigint")
    return held.join(F.broadcast(table), "_part").select(*columns, (F.col("_at") + F.col("_shift")).alias(name)), total - first
