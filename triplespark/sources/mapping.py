"""Relational tables as triples: the direct mapping, and from a predicate back to its table and column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T

BASE = "urn:kg:"

# Keys and foreign keys of the tables.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"],
    "pages": ["page_id"], "conversations": ["conv_id", "turn"],
}
FOREIGN = {
    "nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"},
    "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, "events": {"user_id": "customer"}, "labels": {"doc_id": "documents"},
}
#: Predicates from the other end of a foreign key, or of values that repeat: predicate, table, subject's table and column, object's table (None: literal) and column.
INVERSE = {
    "region#hasNation": ("nation", ("region", "n_regionkey"), ("nation", "n_nationkey")),
    "nation#hasCustomer": ("customer", ("nation", "c_nationkey"), ("customer", "c_custkey")),
    "customer#placed": ("orders", ("customer", "o_custkey"), ("orders", "o_orderkey")),
    "orders#hasLine": ("lineitem", ("orders", "l_orderkey"), ("lineitem", None)),
    "customer#did": ("events", ("customer", "user_id"), (None, "event_type")),
}


def subject_of(table: str, column: str | None = None) -> Column:
    """The IRI column of a table's rows, or of the row of `table` that a column names."""
    keys = [column] if column else KEYS[table]
    parts = [F.date_format(k, "yyyyMMddHHmmss") if k == "l_shipdate" else F.col(k).cast("string") for k in keys]
    return F.concat(F.lit(f"{BASE}{table}/"), F.concat_ws("-", *parts) if len(parts) > 1 else parts[0])


def predicate(table: str, column: str) -> str:
    return f"{BASE}{table}#{column}"


@dataclass(frozen=True)
class Tables:
    """Tables under a folder, one Parquet each, that are read when a query needs them."""

    spark: SparkSession
    path: str
    names: tuple[str, ...]
    _opened: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    def read(self, name: str) -> DataFrame:
        """The table; its footers are read once."""
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        return self._opened[name]

    def columns(self, name: str) -> dict[str, str]:
        return {c: t for c, t in self.read(name).dtypes if not t.startswith(("array", "map", "struct"))}

    def rows(self, name: str) -> int:
        """About how many rows a table has, from its size on disk and the width of its columns: no job is run."""
        df = self.read(name)
        plan = df._jdf.queryExecution().optimizedPlan()
        return max(1, int(plan.stats().sizeInBytes()) // max(1, int(df._jdf.schema().defaultSize())))

    def counts(self) -> dict[str, tuple[int, int, int]]:
        """About how many triples, subjects and objects each predicate has. A column that is neither a key nor a link is
        taken to repeat its values, as often as it has different ones."""
        rows = {t: self.rows(t) for t in self.names}
        out = {}
        for t, n in rows.items():
            for c in self.columns(t):
                target = FOREIGN.get(t, {}).get(c)
                out[predicate(t, c)] = n, n, min(n, rows.get(target, n)) if target else n if KEYS[t] == [c] else max(1, round(n**0.5))
        for p, (t, (s, _), (o, _)) in INVERSE.items():
            if t in rows and s in rows:
                out[BASE + p] = rows[t], min(rows[s], rows[t]), rows[t] if o else max(1, round(rows[t] ** 0.5))
        out[T.TYPE] = sum(rows.values()), sum(rows.values()), len(rows)
        return out

    def predicates(self) -> list[str]:
        own = [predicate(t, c) for t in self.names for c in self.columns(t)]
        return own + [BASE + p for p, (t, (s, _), _) in INVERSE.items() if t in self.names and s in self.names] + [T.TYPE]

    def object_of(self, table: str, column: str) -> Column:
        target = FOREIGN.get(table, {}).get(column)
        if target:
            return subject_of(target, column)
        if table == "documents" and column == "text":
            text = T.plain(F.col("text"))
            return F.when(F.col("lang").isNull(), text).otherwise(F.concat(text, F.lit("@"), F.lower("lang")))
        return T.of_column(F.col(column), self.columns(table)[column])

    def pairs(self, p: str) -> DataFrame | None:
        """(s, o) of a predicate, straight from its table; None if no table has it."""
        if p == T.TYPE:
            parts = [self.read(t).select(subject_of(t).alias("s"), F.lit(f"{BASE}{t.capitalize()}").alias("o")) for t in self.names]
            out = parts[0]
            for x in parts[1:]:
                out = out.unionByName(x)
            return out
        name = p.removeprefix(BASE)
        if name in INVERSE and p.startswith(BASE):
            table, (s, at), (o, column) = INVERSE[name]
            if table not in self.names:
                return None
            value = subject_of(o, column) if o else T.plain(F.col(column))
            out = self.read(table).select(subject_of(s, at).alias("s"), value.alias("o"))
            return out.where("s is not null and o is not null").distinct() if name == "customer#did" else out.where("s is not null and o is not null")
        table, _, column = name.partition("#")
        if not p.startswith(BASE) or table not in self.names or column not in self.columns(table):
            return None
        return self.read(table).select(subject_of(table).alias("s"), self.object_of(table, column).alias("o")).where("s is not null and o is not null")

    def place(self, p: str) -> tuple[str, str] | None:
        """The table and column of a single-valued predicate."""
        table, _, column = p.removeprefix(BASE).partition("#")
        if p.startswith(BASE) and table in self.names and column in self.columns(table):
            return table, column
        return None
