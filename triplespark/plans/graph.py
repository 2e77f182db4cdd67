"""Graphs: sets of triples as DataFrames of canonical terms, and the scan that every pattern is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import Variable
from ..sources.mapping import Tables
from .patterns import StarPattern, TriplePattern
from .planner import Statistics

ORDERS = ("spo", "sop", "pso", "pos", "osp", "ops")
SCHEMA = "s string, p string, o string"


def var(name: str) -> str:
    """The column of a variable: Spark's names ignore case, SPARQL's do not."""
    return "v_" + name.encode().hex()


def name_of(column: str) -> str:
    return bytes.fromhex(column[2:]).decode()


class Graph:
    """df has columns s, p, o, without repeated rows, and optionally g."""

    def __init__(self, df: DataFrame, stats: Statistics | None = None) -> None:
        self.df, self.stats = df, stats

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def statistics(self) -> Statistics:
        """What is known of the graph's predicates, for the order of joins."""
        return self.stats or Statistics()

    def __len__(self) -> int:
        return self.df.count()

    def pairs(self, p: str) -> DataFrame:
        """(s, o) of a predicate."""
        return self.df.where(F.col("p") == p).select("s", "o")

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None, order: str | None = None) -> DataFrame:
        """Triples with these components; None or empty: any. order: one of ORDERS."""
        df = self.df
        for c, v in (("s", s), ("p", p), ("o", o)):
            if v:
                df = df.where(F.col(c) == v)
        return sorted_by(df.select("s", "p", "o"), order) if order else df.select("s", "p", "o")

    def scan(self, t: TriplePattern) -> DataFrame:
        """A column for each variable of the pattern (see var); a repeated variable must have one value."""
        fixed = [None if isinstance(x, Variable) else x for x in (t.s, t.p, t.o)]
        if fixed[1] is not None:
            df = self.pairs(fixed[1])
            for c, v in (("s", fixed[0]), ("o", fixed[2])):
                if v is not None:
                    df = df.where(F.col(c) == v)
        else:
            df = self.match(*fixed)
        out: dict[str, Column] = {}
        for c, x in (("s", t.s), ("p", t.p), ("o", t.o)):
            if isinstance(x, Variable) and x.name:
                if (v := var(x.name)) in out:
                    df = df.where(out[v] == F.col(c))
                else:
                    out[v] = F.col(c)
        return df.select(*(c.alias(v) for v, c in out.items()))

    def wide(self, star: StarPattern) -> DataFrame | None:
        """The star read from one table, if one has all its predicates; a triple store has none."""
        return None

    # changes: each gives a new graph

    def insert(self, rows: DataFrame) -> Graph:
        return Graph(self.df.select("s", "p", "o").unionByName(rows.select("s", "p", "o")).distinct())

    def remove(self, s: str | None = None, p: str | None = None, o: str | None = None) -> Graph:
        return Graph(self.df.join(self.match(s, p, o), ["s", "p", "o"], "left_anti"))

    def update(self, old: tuple[str, str, str], new: tuple[str, str, str]) -> Graph:
        same = (F.col("s") == old[0]) & (F.col("p") == old[1]) & (F.col("o") == old[2])
        return Graph(self.df.select(*(F.when(same, v).otherwise(F.col(c)).alias(c) for c, v in zip("spo", new, strict=True))).distinct())

    def minus(self, other: Graph) -> Graph:
        return Graph(self.df.join(other.df, ["s", "p", "o"], "left_anti"))

    def clear(self) -> Graph:
        return Graph(self.df.where("false"))

    def component(self, role: str) -> DataFrame:
        """One component of each triple, repeats kept."""
        return self.df.select(F.col(role).alias("term"))


class Mapped(Graph):
    """Tables seen as a graph. A pattern with a constant predicate reads its one column; only patterns without one read all."""

    def __init__(self, tables: Tables) -> None:
        self.tables, self.stats = tables, None

    def statistics(self) -> Statistics:
        if self.stats is None:
            counts = self.tables.counts()
            self.stats = Statistics(sum(n for n, _, _ in counts.values()), counts)
        return self.stats

    @property
    def spark(self) -> SparkSession:
        return self.tables.spark

    @property
    def df(self) -> DataFrame:
        """All tables in one pass each: a row's triples are exploded, not joined or read again for each column."""
        out = None
        from ..sources.mapping import BASE, INVERSE, predicate, subject_of

        for t in self.tables.names:
            po = [F.struct(F.lit(T.TYPE).alias("p"), F.lit(f"{BASE}{t.capitalize()}").alias("o"))]
            po += [F.struct(F.lit(predicate(t, c)).alias("p"), self.tables.object_of(t, c).alias("o")) for c in self.tables.columns(t)]
            rows = self.tables.read(t).select(subject_of(t).alias("s"), F.inline(F.array(*po))).where("s is not null and o is not null")
            out = rows if out is None else out.unionByName(rows)
        for p, (t, (s, _), _) in INVERSE.items():
            if t in self.tables.names and s in self.tables.names:
                out = out.unionByName(self.tables.pairs(BASE + p).select("s", F.lit(BASE + p).alias("p"), "o"))
        return out

    def pairs(self, p: str) -> DataFrame:
        out = self.tables.pairs(p)
        return self.spark.createDataFrame([], "s string, o string") if out is None else out

    def wide(self, star: StarPattern) -> DataFrame | None:
        places = [None if isinstance(p, Variable) else self.tables.place(p) for p, _ in star.pairs]
        if None in places or len({t for t, _ in places}) != 1:
            return None
        from ..sources.mapping import subject_of

        table = places[0][0]
        row = self.tables.read(table)
        values = [(star.s, subject_of(table)), *((o, self.tables.object_of(table, c)) for (_, o), (_, c) in zip(star.pairs, places, strict=True))]
        row = row.select(*(c.alias(f"c{i}") for i, (_, c) in enumerate(values)))
        out: dict[str, Column] = {}
        for i, (x, _) in enumerate(values):
            c = F.col(f"c{i}")
            row = row.where(c.isNotNull())
            if not isinstance(x, Variable):
                row = row.where(c == x)
            elif x.name and var(x.name) in out:
                row = row.where(out[var(x.name)] == c)
            elif x.name:
                out[var(x.name)] = c
        return row.select(*(c.alias(v) for v, c in out.items()))


def graph_of(rows: DataFrame, distinct: bool = True) -> Graph:
    """A graph of a DataFrame (s, p, o[, g])."""
    return Graph(rows.distinct() if distinct else rows)


def graph_of_rows(spark: SparkSession, rows: list[tuple[str, str, str]]) -> Graph:
    return Graph(spark.createDataFrame(sorted(set(rows)), SCHEMA))


class Stored(Graph):
    """A saved dataset: a folder for each predicate, and a copy sorted by object for patterns that have one but no predicate."""

    def __init__(self, df: DataFrame, by_object: DataFrame | None, stats: Statistics | None) -> None:
        super().__init__(df, stats)
        self.by_object = by_object

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None, order: str | None = None) -> DataFrame:
        if self.by_object is None or p or s or not o:
            return super().match(s, p, o, order)
        found = self.by_object.where(F.col("o") == o).select("s", "p", "o")
        return sorted_by(found, order) if order else found


def open_graph(spark: SparkSession, path: str, cache: bool = False) -> Graph:
    """A saved dataset (see sources.writers.save), with its statistics and its copy by object if it has them."""
    path = path.rstrip("/")
    df = spark.read.schema("s string, o string, p string").option("basePath", path).parquet(path).select("s", "p", "o")
    index = spark.read.schema(SCHEMA).parquet(f"{path}_by_object") if _exists(spark, f"{path}_by_object") else None
    stats = None
    if _exists(spark, f"{path}_statistics"):
        counts = {r["p"]: (r["triples"], r["subjects"], r["objects"]) for r in spark.read.parquet(f"{path}_statistics").collect()}  # one for each predicate
        stats = Statistics(sum(n for n, _, _ in counts.values()), counts)
    return Stored(df.cache() if cache else df, index.cache() if cache and index is not None else index, stats)


def open_table(spark: SparkSession, table: str) -> Graph:
    """A graph saved by sources.writers.save_table: its buckets by subject join stars without a shuffle."""
    return Graph(spark.table(table).select("s", "p", "o"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def sorted_by(df: DataFrame, order: str = "spo") -> DataFrame:
    if order not in ORDERS:
        raise ValueError(f"no order {order}")
    return df.orderBy(*order)
