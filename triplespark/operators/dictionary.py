"""The four-section dictionary: terms to numbers by role, and triples both ways."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.tables import numbered, settle


def number(terms: DataFrame, first: int = 1) -> tuple[DataFrame, int]:
    """(term, id) in order, from `first`, and how many there are."""
    return numbered(terms.select("term"), "term", name="id", first=first)


@dataclass(frozen=True)
class Dictionary:
    """Sections (term, id): shared terms are subjects and objects alike and come first in both; predicates are apart."""

    shared: DataFrame
    subjects: DataFrame
    objects: DataFrame
    predicates: DataFrame
    sizes: dict[str, int]

    @staticmethod
    def build(graph: Graph) -> Dictionary:
        df = graph.df
        ends = df.select(F.col("s").alias("term"), F.lit(1).alias("r")).unionByName(df.select(F.col("o").alias("term"), F.lit(2).alias("r"))).groupBy("term").agg(F.bit_or("r").alias("r"))
        ends = settle(ends)
        shared, n = number(ends.where("r = 3"))
        (subjects, s), (objects, o), (predicates, p) = number(ends.where("r = 1"), n + 1), number(ends.where("r = 2"), n + 1), number(df.select(F.col("p").alias("term")).distinct())
        return Dictionary(shared, subjects, objects, predicates, {"shared": n, "subjects": s, "objects": o, "predicates": p})

    def section(self, role: str) -> DataFrame:
        """(term, id) of every term in role s, p or o."""
        return self.predicates if role == "p" else self.shared.unionByName(self.subjects if role == "s" else self.objects)

    def id_of(self, term: str, role: str) -> int:
        """0 for none, -1 for a term that is not there."""
        if not term:
            return 0
        row = self.section(role).where(F.col("term") == term).select("id").first()
        return row["id"] if row else -1

    def term_of(self, number_: int, role: str) -> str | None:
        row = self.section(role).where(F.col("id") == number_).select("term").first()
        return row["term"] if row else None

    def encode(self, triples: DataFrame) -> DataFrame:
        for c in "spo":
            own = self.section(c).select(F.col("term").alias(c), F.col("id").alias(f"{c}id"))
            triples = triples.join(F.broadcast(own) if c == "p" and self.sizes["predicates"] <= 100_000 else own, c)
        return triples.select("sid", "pid", "oid")

    def decode(self, triples: DataFrame) -> DataFrame:
        for c in "spo":
            own = self.section(c).select(F.col("term").alias(c), F.col("id").alias(f"{c}id"))
            triples = triples.join(F.broadcast(own) if c == "p" and self.sizes["predicates"] <= 100_000 else own, f"{c}id")
        return triples.select("s", "p", "o")
