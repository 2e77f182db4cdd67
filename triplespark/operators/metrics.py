"""What a query costs: requests, time, bytes and bindings, for one query or a workload of them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.patterns import TriplePattern, stars
from .joins import evaluate
from .setops import within

METRICS = "query string, requests long, total_ms long, bytes long, first_result_ms long, bindings long"


@dataclass(frozen=True)
class Metrics:
    query: str
    requests: int
    total_ms: int
    bytes: int
    first_result_ms: int
    bindings: int


def late(name: str) -> Metrics:
    """What a query that ran out of time counts as."""
    return Metrics(name, -1, -1, -1, -1, -1)


def measure(name: str, solutions: DataFrame, requests: int = 1, seconds: float = 300.0) -> Metrics:
    """Run a query for its costs. Its rows are counted where they come up and go nowhere; bytes are those of the terms.

    The first result is timed by a run of its own, which ends with it."""
    spark, began = solutions.sparkSession, time.monotonic()
    size = F.lit(0).cast("long")
    for c in solutions.columns:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    seen = Observation()
    counted = solutions.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))

    def run() -> tuple[float, float]:
        solutions.limit(1).collect()
        first = time.monotonic()
        counted.write.format("noop").mode("overwrite").save()
        return first - began, time.monotonic() - first

    try:
        first, total = within(spark, seconds, run)
    except TimeoutError:
        return late(name)
    found = seen.get
    return Metrics(name, requests, round(total * 1000), found["bytes"] or 0, round(first * 1000), found["n"])


def requests_of(patterns: list[TriplePattern], method: str) -> int:
    """Scans that a method asks for: one for each pattern, each star, or for all at once."""
    return {"tpf": len(patterns), "brtpf": len(patterns), "spf": len(stars(patterns)), "endpoint": 1}[method]


def experiment(graph: Graph, workload: dict[str, list[TriplePattern]], method: str = "spf", seconds: float = 300.0, tell: Callable[[Metrics], None] = lambda m: None) -> DataFrame:
    """METRICS of every query of a workload by one access method; tell() hears of each as it ends."""
    rows = []
    for name, patterns in workload.items():
        rows.append(measure(name, evaluate(graph, patterns, method), requests_of(patterns, method), seconds))
        tell(rows[-1])
    return graph.spark.createDataFrame([astuple(r) for r in rows], METRICS)
