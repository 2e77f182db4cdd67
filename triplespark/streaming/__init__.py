"""Patterns over triples that keep arriving, in a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.patterns import TriplePattern


def triples(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of (s, p, o) from a growing folder of Parquet files."""
    return spark.readStream.schema("s string, p string, o string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def scan(stream: DataFrame, t: TriplePattern) -> DataFrame:
    """The solutions of a pattern among the triples that arrive."""
    return Graph(stream).scan(t)


def with_graph(stream: DataFrame, t: TriplePattern, graph: Graph, rest: list[TriplePattern]) -> DataFrame:
    """A pattern's arriving solutions joined with those of other patterns over a fixed graph."""
    from ..operators.joins import join, match_bgp

    return join(scan(stream, t), match_bgp(graph, rest))


def counts(stream: DataFrame) -> DataFrame:
    """Triples so far by predicate, for output mode complete or update."""
    return stream.groupBy("p").agg(F.count("*").alias("triples"))
