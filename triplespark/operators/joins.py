"""Matching of stars and basic graph patterns, and the four ways to evaluate one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import Variable
from ..plans.graph import Graph, var
from ..plans.patterns import StarPattern, TriplePattern, stars
from ..plans.planner import Statistics, order, order_stars

#: A set of bindings up to so many rows goes to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: A scan is reduced by bindings if its matches are expected to be more than so many times theirs.
FEW = 10


def join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Solutions that agree on their shared variables, all of them bound; a product if they share none."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared) if shared else left.crossJoin(right)


def unit(graph: Graph) -> DataFrame:
    """One solution without variables."""
    return graph.spark.range(1).select()


def bindings(graph: Graph, names: list[str], rows: list[tuple[str | None, ...]]) -> DataFrame:
    """A VALUES block: None is UNDEF. Equal rows count once."""
    schema = ", ".join(f"{var(n)} string" for n in names)
    return graph.spark.createDataFrame(sorted(set(rows), key=str), schema)


def star_by_joins(graph: Graph, star: StarPattern, stats: Statistics | None = None) -> DataFrame:
    """Each pattern's scan joined on the subject and any other shared variable, most selective first."""
    return reduce(join, (graph.scan(t) for t in order(list(star.patterns), stats or graph.statistics())))


def star_by_groups(graph: Graph, star: StarPattern) -> DataFrame:
    """One pass: the objects of each subject are gathered by predicate, and unfolded where all are there.

    For constant predicates; a star with a variable one goes by joins."""
    if any(isinstance(p, Variable) for p, _ in star.pairs):
        return star_by_joins(graph, star)
    predicates = list(dict.fromkeys(p for p, _ in star.pairs))
    union = reduce(DataFrame.unionByName, (graph.pairs(p).select("s", F.lit(i).alias("k"), "o") for i, p in enumerate(predicates)))
    if not isinstance(star.s, Variable):
        union = union.where(F.col("s") == star.s)
    sets = union.groupBy("s").agg(*(F.collect_set(F.when(F.col("k") == i, F.col("o"))).alias(f"o{i}") for i in range(len(predicates))))
    for i in range(len(predicates)):
        sets = sets.where(F.size(f"o{i}") > 0)
    out = {var(star.s.name): F.col("s")} if isinstance(star.s, Variable) and star.s.name else {}
    for j, (p, o) in enumerate(star.pairs):
        sets = sets.withColumn(f"x{j}", F.explode(f"o{predicates.index(p)}"))
        if not isinstance(o, Variable):
            sets = sets.where(F.col(f"x{j}") == o)
        elif o.name and var(o.name) in out:
            sets = sets.where(out[var(o.name)] == F.col(f"x{j}"))
        elif o.name:
            out[var(o.name)] = F.col(f"x{j}")
    return sets.select(*(c.alias(v) for v, c in out.items()))


def match_star(graph: Graph, star: StarPattern, stats: Statistics | None = None) -> DataFrame:
    """A column for each variable. From one table if the graph has one with all predicates, else by joins."""
    wide = graph.wide(star)
    return star_by_joins(graph, star, stats) if wide is None else wide


def match_bgp(graph: Graph, patterns: list[TriplePattern], stats: Statistics | None = None) -> DataFrame:
    """All solutions of a basic graph pattern: stars, joined in the planner's order."""
    stats = stats or graph.statistics()
    return reduce(join, (match_star(graph, s, stats) for s in order_stars(stars(patterns), stats))) if patterns else unit(graph)


def with_bindings(matches: DataFrame, values: DataFrame, rows: int | None = None) -> DataFrame:
    """Matches restricted to, and extended by, a set of bindings without UNDEF; rows: its size, if known."""
    return join(matches, F.broadcast(values) if rows is not None and rows <= BROADCAST_ROWS else values)


def distinct_stars(graph: Graph, star: StarPattern) -> DataFrame:
    """The fragment form (s, pairs): matches with the same subject and set of (predicate, object) count once."""
    named, names = [], []
    for i, (p, o) in enumerate(star.pairs):
        p, o = (p if not isinstance(p, Variable) or p.name else Variable(f".p{i}")), (o if not isinstance(o, Variable) or o.name else Variable(f".o{i}"))
        named.append((p, o))
        names.append((p, o))
    subject = star.s if not isinstance(star.s, Variable) or star.s.name else Variable(".s")
    matches = match_star(graph, StarPattern(subject, tuple(named)))
    value = lambda x: F.col(var(x.name)) if isinstance(x, Variable) else F.lit(x)
    pairs = F.array_sort(F.array_distinct(F.array(*(F.struct(value(p).alias("p"), value(o).alias("o")) for p, o in names))))
    return matches.select(value(subject).alias("s"), pairs.alias("pairs")).distinct()


def evaluate(graph: Graph, patterns: list[TriplePattern], method: str = "spf", stats: Statistics | None = None) -> DataFrame:
    """The same solutions by any access method.

    tpf: a scan for each pattern, in order, each joined to what is bound so far. brtpf: the same, a scan first reduced
    to the triples that the bindings so far can meet where these are expected to be few against its matches. spf: a star at a time. endpoint: the whole pattern at once.
    """
    stats = stats or graph.statistics()
    if method == "endpoint":
        return match_bgp(graph, patterns, stats)
    if method == "spf":
        return reduce(join, (star_by_joins(graph, s, stats) for s in order_stars(stars(patterns), stats))) if patterns else unit(graph)
    if method not in ("tpf", "brtpf"):
        raise ValueError(f"no access method {method}")
    out, size, known = None, 1.0, frozenset[str]()
    for t in order(patterns, stats):
        found = graph.scan(t)
        shared = [] if out is None else [c for c in found.columns if c in out.columns]
        if method == "brtpf" and shared and size * FEW < stats.estimate(t):
            found = found.join(out.select(*shared).distinct(), shared, "left_semi")
        size, known = size * stats.estimate(t, known), known | set(t.variables)
        out = found if out is None else join(out, found)
    return unit(graph) if out is None else out
