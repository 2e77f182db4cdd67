"""Statistics of graphs, and cardinality estimates from them."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import Variable
from ..plans.graph import Graph
from ..plans.patterns import StarPattern, TriplePattern
from ..plans.planner import Statistics
from ..plans.tables import numbered


class Estimation(Enum):
    """How a count relates to the true one."""

    UNKNOWN, APPROXIMATE, UP_TO, EXACT, MORE_THAN = range(5)


@dataclass(frozen=True)
class Estimate:
    value: float
    kind: Estimation


def void(graph: Graph) -> DataFrame:
    """One row: triples, and distinct predicates, subjects, objects, and terms that are both subject and object."""
    df = graph.df
    roles = df.select(F.col("s").alias("t"), F.lit(1).alias("r")).unionByName(df.select(F.col("o").alias("t"), F.lit(2).alias("r")))
    by_term = roles.groupBy("t").agg(F.bit_or("r").alias("r"))
    ends = by_term.agg(F.count_if(F.col("r") != 2).alias("subjects"), F.count_if(F.col("r") != 1).alias("objects"), F.count_if(F.col("r") == 3).alias("shared"))
    return df.agg(F.count("*").alias("triples"), F.count_distinct("p").alias("predicates")).crossJoin(ends)


def predicate_counts(graph: Graph) -> DataFrame:
    """(p, triples, subjects, objects): triples and distinct (s, p) pairs are both there; plans use the former."""
    return graph.df.groupBy("p").agg(F.count("*").alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


def object_counts(graph: Graph) -> DataFrame:
    return graph.df.groupBy("o").agg(F.count("*").alias("triples"))


def statistics(graph: Graph) -> Statistics:
    """For the planner: one small row for each predicate."""
    rows = predicate_counts(graph).collect()
    return Statistics(sum(r["triples"] for r in rows), {r["p"]: (r["triples"], r["subjects"], r["objects"]) for r in rows})


def characteristic_sets(graph: Graph) -> DataFrame:
    """(predicates, subjects, of: map of predicate to triples and distinct objects), a row for each set of predicates that
    a subject has. Objects are counted over the set's subjects."""
    sets = graph.df.groupBy("s").agg(F.array_sort(F.collect_set("p")).alias("predicates"))
    met = graph.df.join(sets, "s")
    each = met.groupBy("predicates", "p").agg(F.count("*").alias("triples"), F.count_distinct("o").alias("objects"))
    of = each.groupBy("predicates").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", F.struct("triples", "objects"))))).alias("of"))
    return sets.groupBy("predicates").agg(F.count("*").alias("subjects")).join(of, "predicates")


def estimate_star(sets: DataFrame, star: StarPattern, compat: bool = False) -> DataFrame:
    """One row, estimate: over the characteristic sets that have all of the star's predicates, the sum of
    subjects * product(triples of p / subjects) * least(1 / objects of p, over bound objects), over subjects if the subject is bound.

    compat leaves sets of one subject out."""
    predicates = sorted({p for p, _ in star.pairs if not isinstance(p, Variable)})
    n = F.col("subjects").cast("double")
    row = sets.where(F.forall(F.array(*map(F.lit, predicates)), lambda p: F.array_contains("predicates", p)) if predicates else F.lit(True))
    if compat:
        row = row.where("subjects > 1")
    value = n
    for p, _ in star.pairs:
        if not isinstance(p, Variable):
            value = value * F.col("of")[p]["triples"] / n
    bound = [F.lit(1.0) / F.col("of")[p]["objects"] for p, o in star.pairs if not isinstance(p, Variable) and not isinstance(o, Variable)]
    if bound:
        value = value * (F.least(*bound) if len(bound) > 1 else bound[0])
    if not isinstance(star.s, Variable):
        value = value / n
    return row.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("estimate"))


def estimate_star_simply(stats: Statistics, subjects: int, star: StarPattern) -> Estimate:
    """Without characteristic sets: subjects * product(estimate / subjects) over all patterns."""
    value = float(subjects)
    for t in star.patterns:
        value *= stats.estimate(t) / max(1, subjects)
    return Estimate(value, Estimation.APPROXIMATE)


def estimate(stats: Statistics, t: TriplePattern) -> Estimate:
    """A pattern's matches: exact for ? ? ? and ? p ?, 0 for an unknown predicate."""
    fixed = [not isinstance(x, Variable) for x in (t.s, t.p, t.o)]
    if fixed[1] and t.p not in stats.predicates:
        return Estimate(0.0, Estimation.EXACT)
    exact = not fixed[0] and not fixed[2] and len(set(t.variables)) == len([f for f in fixed if not f])
    value = float(stats.triples) if exact and not fixed[1] else stats.estimate(t)
    return Estimate(value, Estimation.EXACT if exact else Estimation.UP_TO if all(fixed) else Estimation.APPROXIMATE)


def families(sets: DataFrame) -> DataFrame:
    """Characteristic sets with a stable index, largest first: the catalog that a star's lookup reads."""
    total = F.aggregate(F.map_values("of"), F.lit(0).cast("bigint"), lambda a, x: a + x["triples"])
    rows = sets.select("predicates", "subjects", total.alias("triples"))
    ranked = rows.select((-F.col("subjects")).alias("rank"), "*")
    return numbered(ranked, "rank", "predicates", name="index")[0].select(F.col("index").cast("int").alias("index"), "predicates", "subjects", "triples")


def family_of(families_: DataFrame, star: StarPattern) -> DataFrame:
    """The families whose predicates include all of the star's; least marks the one with the fewest predicates."""
    predicates = sorted({p for p, _ in star.pairs if not isinstance(p, Variable)})
    found = families_.where(F.forall(F.array(*map(F.lit, predicates)), lambda p: F.array_contains("predicates", p)))
    least = found.agg(F.min_by("index", F.struct(F.size("predicates"), "index")).alias("best"))
    return found.crossJoin(F.broadcast(least)).select("index", "predicates", "subjects", "triples", (F.col("index") == F.col("best")).alias("least"))
