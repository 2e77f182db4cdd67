"""Connected components by alternating large and small stars, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import materialize


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Links each node's larger neighbours (or, for small, its smaller ones and itself) to the least of its neighbourhood."""
    out = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if not small:
        out = out.unionByName(out.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = out.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    met = out.join(low, "u")
    if small:
        moved = met.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    else:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.where("u != v").distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and a sum of hashes, observed while they are written."""
    seen = Observation()
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
    return table, tuple(seen.get.values())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (u, v): root is the least node of its component. Nothing reaches the driver but sums.

    Rounds go on until one changes nothing: some log(nodes) squared at most."""
    now, state = _written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while state != before:
        before = state
        now, state = _written(_stars(_stars(now, small=False), small=True))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
