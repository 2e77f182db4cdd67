"""From SPARQL algebra to DataFrames.

Solutions are rows with a column for each variable (see graph.var), null where unbound. Which variables are certainly
bound is known while compiling, so that only joins on others need the test for unbound values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.expressions import FUNCTIONS, Value, arithmetic, constant, equal, less, mean, rank, single, total
from ..functions.terms import Variable
from ..operators.joins import bindings, join, match_bgp, unit
from . import algebra as A
from .graph import Graph, name_of, var
from .patterns import TriplePattern
from .planner import Statistics
from .sparql import parse
from .tables import settle


class Unsupported(ValueError):
    pass


@dataclass(frozen=True)
class Solutions:
    df: DataFrame
    certain: frozenset[str]  # columns


Resolve = Callable[[str], Column | None]


def _resolver(df: DataFrame) -> Resolve:
    return lambda c: F.col(c) if c in df.columns else None


@dataclass(frozen=True)
class _Flag:
    """A boolean column that stands for an EXISTS inside an expression."""

    column: str


class NamedGraphs(Graph):
    """All named graphs at once: every scan has their name in a column."""

    def __init__(self, df: DataFrame, column: str) -> None:
        super().__init__(df.where(F.col("g").isNotNull()))
        self.column = column

    def scan(self, t: TriplePattern) -> DataFrame:
        own = Graph(self.df.select(F.struct("g", "s").alias("s"), "p", "o"))
        found = own.scan(TriplePattern(Variable(".gs"), t.p, t.o))
        key = F.col(var(".gs"))
        found = found.withColumns({self.column: key["g"], "s": key["s"]}).drop(var(".gs"))
        if not isinstance(t.s, Variable):
            return found.where(F.col("s") == t.s).drop("s")
        if not t.s.name:
            return found.drop("s")
        at = var(t.s.name)
        return found.where(F.col(at) == F.col("s")).drop("s") if at in found.columns else found.withColumnRenamed("s", at)

    def paired(self) -> Graph:
        """A graph whose nodes hold the name of their graph before them, for paths, which never leave one."""
        mark = lambda c: F.concat("g", F.lit("\0"), c)
        return Graph(self.df.select(mark("s").alias("s"), "p", mark("o").alias("o")))


class Compiler:
    def __init__(self, graph: Graph, stats: Statistics | None = None) -> None:
        self.graph, self.stats = graph, graph.statistics() if stats is None else stats
        #: Columns that join but count as no shared variable: the name of the graph, inside GRAPH.
        self.beside: set[str] = {graph.column} if isinstance(graph, NamedGraphs) else set()

    # patterns

    def solve(self, node: object) -> Solutions:
        return getattr(self, "_" + type(node).__name__.lower())(node)

    def _bgp(self, node: A.BGP) -> Solutions:
        plain = [t for t in node.patterns if isinstance(t, TriplePattern)]
        paths = [t for t in node.patterns if isinstance(t, A.PathPattern)]
        parts = [match_bgp(self.graph, plain, self.stats)] if plain or not paths else []
        parts += [self._path_pattern(t) for t in paths]
        shared = lambda a, b: bool(set(a.columns) & set(b.columns))
        out = parts.pop(0)
        while parts:  # connected ones first
            out = join(out, parts.pop(next((i for i, p in enumerate(parts) if shared(out, p)), 0)))
        return Solutions(out, frozenset(out.columns))

    def _join(self, node: A.Join) -> Solutions:
        return self.join(self.solve(node.left), self.solve(node.right))

    def _meet(self, a: Solutions, b: Solutions, how: str, extra: Callable[[Resolve], Column | None] = lambda r: None) -> tuple[DataFrame, list[str]]:
        """Join on compatibility: shared variables are equal or unbound on one side. b's shared columns come out with a final r.

        Both sides fall into parts by the shared variables that are unbound there, so that each pair of parts meets on
        equal columns; only solutions without a shared bound variable make a product, as SPARQL asks."""
        shared = [c for c in a.df.columns if c in b.df.columns]
        right = b.df.withColumnsRenamed({c: c + "r" for c in shared})

        def resolve(c: str) -> Column | None:
            if c in shared and (c not in a.certain):
                return F.coalesce(F.col(c), F.col(c + "r"))
            return F.col(c) if c in a.df.columns or c in b.df.columns else None

        more = extra(resolve)

        def parts(df: DataFrame, open_: list[str], suffix: str) -> list[tuple[frozenset[str], DataFrame]]:
            out = []
            for bits in product((False, True), repeat=len(open_)):
                part = df
                for c, unbound in zip(open_, bits, strict=True):
                    part = part.where(F.col(c + suffix).isNull() if unbound else F.col(c + suffix).isNotNull())
                out.append((frozenset(c for c, unbound in zip(open_, bits, strict=True) if unbound), part))
            return out

        lefts = parts(a.df, [c for c in shared if c not in a.certain], "")
        rights = parts(right, [c for c in shared if c not in b.certain], "r")

        def on(*unbound: frozenset[str]) -> Column:
            tests = [F.col(c) == F.col(c + "r") for c in shared if not any(c in u for u in unbound)] + ([more] if more is not None else [])
            return reduce(lambda x, y: x & y, tests) if tests else F.lit(True)

        out = []
        for u, left in lefts:
            if how == "left_outer" and len(rights) == 1:
                out.append(left.join(rights[0][1], on(u, rights[0][0]), how))
                continue
            rest = left
            for i, (w, part) in enumerate(rights):
                if how in ("inner", "left_outer"):
                    out.append(left.join(part, on(u, w), "inner"))
                elif how == "left_semi":
                    out.append(rest.join(part, on(u, w), "left_semi"))
                if how != "inner" and (how != "left_semi" or i < len(rights) - 1):
                    rest = rest.join(part, on(u, w), "left_anti")
            if how in ("left_outer", "left_anti"):
                out.append(rest)
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), out), shared

    def join(self, a: Solutions, b: Solutions) -> Solutions:
        shared = {c for c in a.df.columns if c in b.df.columns}
        if shared <= a.certain & b.certain:
            return Solutions(join(a.df, b.df), a.certain | b.certain)
        df, both = self._meet(a, b, "inner")
        merged = {c: F.coalesce(F.col(c), F.col(c + "r")) for c in both}
        return Solutions(df.withColumns(merged).drop(*(c + "r" for c in both)), a.certain | b.certain)

    def _leftjoin(self, node: A.LeftJoin) -> Solutions:
        a, b = self.solve(node.left), self.solve(node.right)
        where = lambda r: reduce(lambda x, y: x & y, (self.value(e, r).true for e in node.filters)) if node.filters else None
        df, both = self._meet(a, b, "left_outer", where)
        merged = {c: F.coalesce(F.col(c), F.col(c + "r")) for c in both if c not in a.certain}
        return Solutions(df.withColumns(merged).drop(*(c + "r" for c in both)) if both else df, a.certain)

    def _union(self, node: A.Union) -> Solutions:
        a, b = self.solve(node.left), self.solve(node.right)
        return Solutions(a.df.unionByName(b.df, allowMissingColumns=True), a.certain & b.certain)

    def _minus(self, node: A.Minus) -> Solutions:
        a, b = self.solve(node.left), self.solve(node.right)
        shared = [c for c in a.df.columns if c in b.df.columns]
        if not set(shared) - self.beside:
            return a
        met = None
        if not set(shared) - self.beside <= a.certain & b.certain:  # one must be bound on both sides
            met = lambda r: reduce(lambda x, y: x | y, (F.col(c).isNotNull() & F.col(c + "r").isNotNull() for c in shared if c not in self.beside))
        df, _ = self._meet(a, Solutions(b.df.select(*shared), b.certain), "left_anti", met or (lambda r: None))
        return Solutions(df, a.certain)

    def _filter(self, node: A.Filter) -> Solutions:
        out = self.solve(node.inner)
        for e in node.conditions:
            out = self.restrict(out, e)
        return out

    def restrict(self, a: Solutions, e: object) -> Solutions:
        if isinstance(e, A.Call) and e.name == "&&":
            return self.restrict(self.restrict(a, e.args[0]), e.args[1])
        if isinstance(e, A.Call) and e.name == "!" and isinstance(e.args[0], A.Exists):
            e = A.Exists(e.args[0].inner, not e.args[0].negated)
        if isinstance(e, A.Exists):
            inner, conditions = (e.inner.inner, e.inner.conditions) if isinstance(e.inner, A.Filter) else (e.inner, ())
            outer = [c for c in conditions if not isinstance(c, A.Exists)]
            b = self.solve(inner)
            for c in conditions:
                if isinstance(c, A.Exists):
                    b = self.restrict(b, c)
            where = lambda r: reduce(lambda x, y: x & y, (self.value(c, r).true for c in outer)) if outer else None
            df, _ = self._meet(a, b, "left_anti" if e.negated else "left_semi", where)
            return Solutions(df, a.certain)
        flagged, e = self.flagged(a, e)
        return Solutions(flagged.df.where(self.value(e, _resolver(flagged.df)).true).select(*a.df.columns), a.certain)

    def flagged(self, a: Solutions, e: object) -> tuple[Solutions, object]:
        """The expression without its EXISTS: each is a column of the solutions that says whether it holds."""
        if isinstance(e, A.Exists):
            column = f"exists{sum(c.startswith('exists') for c in a.df.columns)}"
            parts = [self.restrict(a, A.Exists(e.inner, no)).df.withColumn(column, F.lit(no == e.negated)) for no in (False, True)]
            return Solutions(parts[0].unionByName(parts[1]), a.certain), _Flag(column)
        if isinstance(e, A.Call) and e.name not in A.AGGREGATES:
            args = []
            for x in e.args:
                a, x = self.flagged(a, x)
                args.append(x)
            return a, replace(e, args=tuple(args))
        return a, e

    def _extend(self, node: A.Extend) -> Solutions:
        a = self.solve(node.inner)
        flagged, e = self.flagged(a, node.expression)
        return Solutions(flagged.df.select(*a.df.columns, self.value(e, _resolver(flagged.df)).term.alias(var(node.name))), a.certain)

    def _values(self, node: A.Values) -> Solutions:
        schema = ", ".join(f"{var(n)} string" for n in node.names)
        df = self.graph.spark.createDataFrame(list(node.rows), schema)
        return Solutions(df, frozenset(var(n) for i, n in enumerate(node.names) if all(r[i] is not None for r in node.rows)))

    def _ingraph(self, node: A.InGraph) -> Solutions:
        df = self.graph.df
        if "g" not in df.columns:
            raise Unsupported("the graph has no named graphs")
        if not isinstance(node.name, Variable):
            return Compiler(Graph(df.where(F.col("g") == node.name))).solve(node.inner)
        g = var(node.name.name)
        inner = Compiler(NamedGraphs(df, g)).solve(node.inner)
        if g not in inner.df.columns:
            names = df.select(F.col("g").alias(g)).where("g is not null").distinct()
            inner = Solutions(inner.df.crossJoin(names), inner.certain)
        return Solutions(inner.df, inner.certain | {g})

    def _query(self, node: A.Query) -> Solutions:
        return self.select(node)

    # property paths

    def _path_pattern(self, t: A.PathPattern) -> DataFrame:
        if isinstance(self.graph, NamedGraphs):
            ends = A.PathPattern(Variable(".ps"), t.path, Variable(".po"))
            df = Compiler(self.graph.paired(), Statistics())._path_pattern(ends)
            s, o = (F.split(F.col(var(x)), "\0", 2) for x in (".ps", ".po"))
            return Graph(df.select(s[1].alias("s"), s[0].alias("p"), o[1].alias("o"))).scan(TriplePattern(t.s, Variable(name_of(self.graph.column)), t.o))
        start = t.s if not isinstance(t.s, Variable) else None
        end = t.o if not isinstance(t.o, Variable) else None
        df = self.path(t.path, start, end)
        if start is not None:
            df = df.where(F.col("s") == start)
        if end is not None:
            df = df.where(F.col("o") == end)
        if isinstance(t.s, Variable) and isinstance(t.o, Variable) and t.s.name == t.o.name:
            return df.where(F.col("s") == F.col("o")).select(F.col("s").alias(var(t.s.name)))
        return df.select(*(F.col(c).alias(var(x.name)) for c, x in (("s", t.s), ("o", t.o)) if isinstance(x, Variable)))

    def nodes(self) -> DataFrame:
        df = self.graph.df
        return df.select(F.col("s").alias("n")).unionByName(df.select(F.col("o").alias("n"))).distinct()

    def identity(self, *ends: str | None) -> DataFrame:
        """Every node with itself; of a path with a constant end only that one counts, whether the graph has it or not."""
        fixed = [e for e in ends if e is not None]
        if fixed:
            return self.graph.spark.createDataFrame([(e, e) for e in set(fixed)], "s string, o string")
        return self.nodes().select(F.col("n").alias("s"), F.col("n").alias("o"))

    def path(self, path: A.Path, start: str | None = None, end: str | None = None) -> DataFrame:
        """(s, o) that the path joins; start and end, if given, are all that the caller wants."""
        op, args = path.op, path.args
        if op == "iri":
            return self.graph.pairs(args[0])
        if op == "inv":
            return self.path(args[0], end, start).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if op == "seq":
            out = self.path(args[0], start, None)
            for i, a in enumerate(args[1:], 1):
                right = self.path(a, None, end if i == len(args) - 1 else None)
                out = out.withColumnRenamed("o", "m").join(right.withColumnRenamed("s", "m"), "m").select("s", "o")
            return out
        if op == "alt":
            return reduce(DataFrame.unionByName, (self.path(a, start, end) for a in args))
        if op == "not":
            out = []
            for inverse in (False, True):
                own = [p for p, i in args if i == inverse]
                if own or not inverse and not args:
                    df = self.graph.df.where(~F.col("p").isin(own)).select("s", "o")
                    out.append(df.select(F.col("o").alias("s"), F.col("s").alias("o")) if inverse else df)
            return reduce(DataFrame.unionByName, out)
        step = args[0]
        if op == "opt":
            return self.path(step, start, end).unionByName(self.identity(start, end)).distinct()
        if start is None and end is not None:  # from the constant end, backwards
            return self.path(A.Path("inv", (A.Path(op, (A.Path("inv", (step,)),)),)), None, end)
        closure = self.closure(self.path(step), start)
        return closure if op == "plus" else closure.unionByName(self.identity(start, end)).distinct()

    def closure(self, edges: DataFrame, start: str | None) -> DataFrame:
        """One step or more: the frontier moves on until it finds no new pair, so cycles end. Each round is a written table; these go when the driver ends."""
        edges = settle(edges.distinct())
        frontier = edges if start is None else edges.where(F.col("s") == start)
        seen = frontier = settle(frontier)
        hop = edges.select(F.col("s").alias("m"), F.col("o").alias("n"))
        rounds = 0
        while not frontier.isEmpty():
            frontier = settle(frontier.join(hop, F.col("o") == F.col("m")).select("s", F.col("n").alias("o")).distinct().join(seen, ["s", "o"], "left_anti"))
            seen, rounds = seen.unionByName(frontier), rounds + 1
            if rounds % 8 == 0:  # one table again, so that the plan does not grow with the rounds
                seen = settle(seen)
        return seen

    # expressions

    def value(self, e: object, resolve: Resolve, grouped: bool = False) -> Value:
        if isinstance(e, Variable):
            c = resolve(var(e.name))
            return Value("term", F.lit(None).cast("string") if c is None else c)
        if isinstance(e, str):
            return constant(e)
        if isinstance(e, _Flag):
            return Value("bool", F.col(e.column))
        if isinstance(e, A.Exists):
            raise Unsupported("EXISTS inside an aggregate or a sort key")
        if e.name in A.AGGREGATES:
            if not grouped:
                raise Unsupported(f"{e.name} outside a group")
            return self.aggregate(e, resolve)
        if e.name == "BOUND":
            c = resolve(var(e.args[0].name))
            return Value("bool", F.lit(False) if c is None else c.isNotNull())
        a = [self.value(x, resolve, grouped) for x in e.args]
        if e.name in ("&&", "||"):
            return Value("bool", a[0].true & a[1].true if e.name == "&&" else a[0].true | a[1].true)
        if e.name == "!":
            return Value("bool", ~a[0].true)
        if e.name == "NEG":
            return arithmetic("-", Value("int", F.lit(0).cast("bigint")), a[0])
        if e.name in ("=", "!="):
            return Value("bool", equal(*a) if e.name == "=" else ~equal(*a))
        if e.name in ("<", ">", "<=", ">="):
            return Value("bool", less(a[0], a[1], e.name))
        if e.name in ("+", "-", "*", "/"):
            return arithmetic(e.name, *a)
        if e.name in ("IN", "NOT IN"):
            hit = reduce(lambda x, y: x | y, (equal(a[0], x) for x in a[1:]), F.lit(False))
            return Value("bool", hit if e.name == "IN" else ~hit)
        if e.name not in FUNCTIONS:
            raise Unsupported(f"no function {e.name}")
        return FUNCTIONS[e.name](a)

    def aggregate(self, e: A.Call, resolve: Resolve) -> Value:
        distinct, separator = e.more
        if not e.args:
            return Value("int", F.count("*"))
        v = self.value(e.args[0], resolve)
        if e.name == "COUNT":
            return Value("int", F.count_distinct(v.term) if distinct else F.count(v.column))
        if e.name in ("SUM", "AVG"):
            return (total if e.name == "SUM" else mean)(v, distinct)
        v = single(v)
        if e.name in ("MIN", "MAX"):
            if v.kind != "term":
                return Value(v.kind, F.min(v.column) if e.name == "MIN" else F.max(v.column))
            keyed = F.when(v.column.isNotNull(), F.struct(v.num.alias("n"), v.text.alias("t"), v.column.alias("v")))
            return Value("term", (F.min(keyed) if e.name == "MIN" else F.max(keyed))["v"])
        if e.name == "SAMPLE":
            return Value("term", F.min(v.term))
        held = F.collect_set(v.text) if distinct else F.collect_list(v.text)
        return Value("str", F.array_join(F.sort_array(held), separator))

    # queries

    def select(self, q: A.Query) -> Solutions:
        a = self.solve(q.where)
        names = [n for n, _ in q.projection] if q.projection is not None else [v for v in A.variables_of(q.where) if v[0] != "."]
        expressions = {n: e for n, e in q.projection or [] if e is not None}

        def aggregates(e: object) -> bool:
            return isinstance(e, A.Call) and (e.name in A.AGGREGATES or any(map(aggregates, e.args)))

        order = list(q.order)
        if q.group is not None or q.having or any(map(aggregates, expressions.values())):
            df, resolve = a.df, _resolver(a.df)
            for n, e in q.group or []:
                if e is not None:
                    df = df.withColumn(var(n), self.value(e, resolve).term)
            keys = [var(n) for n, _ in q.group or []]
            resolve = _resolver(df)
            made = {n: self.value(e, resolve, True).term.alias(var(n)) for n, e in expressions.items() if aggregates(e)}
            tests = [self.value(e, resolve, True).true.alias(f"having{i}") for i, e in enumerate(q.having)]
            sorts: list[Column] = []
            for i, (e, down) in enumerate(order):
                if aggregates(e):
                    sorts.append(self.value(e, resolve, True).term.alias(var(f".o{i}")))
                    order[i] = (Variable(f".o{i}"), down)
            columns = [*made.values(), *tests, *sorts]
            df = df.groupBy(*keys).agg(*columns) if columns else df.select(*keys).distinct()
            for i in range(len(tests)):
                df = df.where(f"having{i}")
            a = Solutions(df, a.certain & frozenset(keys))
            expressions = {n: e for n, e in expressions.items() if n not in made}
        for n, e in expressions.items():
            a, e = self.flagged(a, e)
            a = Solutions(a.df.withColumn(var(n), self.value(e, _resolver(a.df)).term), a.certain)
        df = a.df
        missing = [var(n) for n in names if var(n) not in df.columns]
        df = df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df
        columns = [var(n) for n in names]
        if q.distinct and order:
            ranks = [(k, down) for e, down in order for k in rank(self.value(e, _resolver(df)))]
            df = df.select(*columns, *(k.alias(f"key{i}") for i, (k, _) in enumerate(ranks)))
            # of equal rows the first in order counts
            df = df.groupBy(*columns).agg(*((F.max if down else F.min)(f"key{i}").alias(f"key{i}") for i, (_, down) in enumerate(ranks)))
            keys = [F.col(f"key{i}").desc() if down else F.col(f"key{i}").asc() for i, (_, down) in enumerate(ranks)]
        else:
            df = df.select(*columns).distinct() if q.distinct else df
            keys = [k.desc() if down else k.asc() for e, down in order for k in rank(self.value(e, _resolver(df)))]
        if keys:
            df = df.orderBy(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df.select(*columns), a.certain & frozenset(columns))

    def run(self, q: A.Query) -> DataFrame:
        if q.form == "select":
            df = self.select(q).df
            return df.toDF(*(name_of(c) for c in df.columns))
        plain = A.Query("select", q.where, [(v, None) for v in A.variables_of(q.where)], order=q.order, limit=q.limit, offset=q.offset)
        if q.form == "ask":
            return self.solve(q.where).df.limit(1).agg((F.count("*") > 0).alias("ask"))
        df = self.select(plain).df if plain.projection else unit(self.graph)
        if q.form == "construct":
            return self.construct(df, q.template)
        fixed = [r for r in q.resources if not isinstance(r, Variable)]
        wanted = [df.select(F.col(var(r.name)).alias("s")) for r in q.resources if isinstance(r, Variable)]
        wanted += [self.graph.spark.createDataFrame([(r,) for r in fixed], "s string")] if fixed else []
        if not wanted:
            return self.graph.df.select("s", "p", "o").where("false")
        return self.graph.df.select("s", "p", "o").join(reduce(DataFrame.unionByName, wanted).distinct(), "s", "left_semi").distinct()

    def construct(self, df: DataFrame, template: list[TriplePattern]) -> DataFrame:
        """The template's triples for every solution, those that are no triples left out; its blank nodes are the solution's own."""
        fresh = F.xxhash64(*(F.coalesce(c, F.lit("")) for c in df.columns)) if df.columns else F.lit(0)

        def at(x: object) -> Column:
            if not isinstance(x, Variable):
                return F.lit(x)
            if x.name.startswith("."):
                return F.concat(F.lit(f"_:{x.name[1:]}x"), F.hex(fresh))
            return F.col(var(x.name)) if var(x.name) in df.columns else F.lit(None).cast("string")

        parts = [df.select(at(t.s).alias("s"), at(t.p).alias("p"), at(t.o).alias("o")) for t in template]
        if not parts:
            return self.graph.spark.createDataFrame([], "s string, p string, o string")
        out = reduce(DataFrame.unionByName, parts)
        return out.where((T.kind(F.col("s")) != "literal") & (T.kind(F.col("p")) == "iri") & F.col("o").isNotNull()).distinct()


def sparql(graph: Graph, text: str, prefixes: dict[str, str] | None = None, stats: Statistics | None = None) -> DataFrame:
    """Run a query. SELECT gives a column of canonical terms for each variable, ASK one boolean, the others s, p, o."""
    return Compiler(graph, stats).run(parse(text, prefixes))


__all__ = ["Compiler", "Solutions", "Unsupported", "bindings", "sparql"]
