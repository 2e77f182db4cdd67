"""Operators on whole collections of rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def concat(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def dedup(df: DataFrame) -> DataFrame:
    return df.distinct()


def dedup_adjacent(df: DataFrame, order: list[str], within: list[str], values: list[str]) -> DataFrame:
    """Rows whose values differ from those of the row before, in this order within each group."""
    before = F.lag(F.struct(*values)).over(Window.partitionBy(*within).orderBy(*order))
    return df.withColumn("before", before).where(~F.struct(*values).eqNullSafe(F.col("before"))).drop("before")


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of either, marked LEFT, RIGHT or BOTH."""
    both = left.distinct().select("*", F.lit(1).alias("side")).unionByName(right.distinct().select("*", F.lit(2).alias("side")))
    total = F.sum("side")
    return both.groupBy(*left.columns).agg(F.when(total == 1, "LEFT").when(total == 2, "RIGHT").otherwise("BOTH").alias("side"))


def merge_reduce(left: DataFrame, right: DataFrame, keys: list[str], *how: Column) -> DataFrame:
    """Rows of both, those with the same keys reduced."""
    return left.unionByName(right).groupBy(*keys).agg(*how)


def merge_sorted(order: list[str], *frames: DataFrame) -> DataFrame:
    return concat(*frames).orderBy(*order)


def reduce_groups(df: DataFrame, keys: list[str], *how: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*how)


def mapped(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(c.alias(n) for n, c in columns.items()))


def kept(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def differing(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def flat_map(df: DataFrame, array: Column, name: str) -> DataFrame:
    """A row for each element."""
    return df.select("*", F.explode(array).alias(name))


def dependent(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """For each row, the rows of another frame that it leads to."""
    return df.join(other, on)


def numbers(spark: SparkSession, start: int, end: int) -> DataFrame:
    return spark.range(start, end).toDF("n")


def elements(df: DataFrame, array: Column) -> DataFrame:
    """(position, element), from 0."""
    return df.select(F.posexplode(array)).toDF("position", "element")


def within(spark: SparkSession, seconds: float, action: Callable[[], object]) -> object:
    """Run an action; its jobs are cancelled, and TimeoutError is raised, after so many seconds."""
    import threading
    import uuid

    tag, late = uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"more than {seconds} s") from None
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
