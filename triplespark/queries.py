"""A query for each operator over the tables' direct mapping, with SQL for the same rows where it can express them."""

from __future__ import annotations

import io
import json
import tarfile
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as T
from .functions.terms import Variable as V
from .operators import dictionary, fragments, joins, metrics, setops, stats
from .plans.compiler import sparql
from .plans.graph import Graph, Mapped, graph_of, graph_of_rows, open_graph, open_table, var
from .plans.patterns import StarPattern, TriplePattern, shape, stars
from .plans.sparql import parse
from .plans.tables import delete_at_end, numbered, settle, shared_dir
from .sources import catalog, readers, writers
from .sources.mapping import BASE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PREFIXES = {"kg": BASE, "rdf": T.RDF, "xsd": T.XSD, **{f"{t[0]}{t[1]}": f"{BASE}{t}#" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")}}
CUSTOMER = {"c_custkey": "int", "c_name": "str", "c_nationkey": "nation", "c_acctbal": "num", "c_mktsegment": "str"}
NATION = {"n_nationkey": "int", "n_name": "str", "n_regionkey": "region"}
REGION = {"r_regionkey": "int", "r_name": "str"}
SUPPLIER = {"s_suppkey": "int", "s_name": "str", "s_nationkey": "nation", "s_acctbal": "num"}
MAPPED = {"customer": ("c_custkey", CUSTOMER), "nation": ("n_nationkey", NATION), "region": ("r_regionkey", REGION), "supplier": ("s_suppkey", SUPPLIER)}


def mapped(spark: SparkSession, sf_dir: str, *tables: str) -> Mapped:
    return Mapped(Tables(spark, sf_dir, tables))


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.split()) if "--" not in sql else sql
        return f

    return add


def typed(df: DataFrame, **columns: str) -> DataFrame:
    """Terms as values: str (lexical form, or an IRI), int, num, time or bool, by column; a column named a_b comes from b with kind given as 'kind:b'."""
    out = []
    for name, kind in columns.items():
        kind, _, source = kind.partition(":")
        c = F.col(source or name)
        value = {"str": T.lex(c), "int": T.num(c).cast("bigint"), "num": T.num(c), "time": T.timestamp(c), "bool": T.lex(c) == "true"}[kind]
        out.append(value.alias(name))
    return df.select(*out)


def ask(name: str, tables: str, text: str, columns: dict[str, str], sql: str) -> None:
    """Registers a SPARQL query."""
    prologue = "".join(f"PREFIX {k}: <{v}> " for k, v in PREFIXES.items())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return typed(sparql(mapped(spark, sf_dir, *tables.split()), prologue + text), **columns)

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = " ".join(sql.split())


def split_object(df: DataFrame) -> DataFrame:
    """Triples with the objects that are doubles as numbers, so that no formatting of numbers counts."""
    double = T.datatype(F.col("o")) == T.DOUBLE
    return df.select("s", "p", F.when(double.isNull() | ~double, T.lex(F.col("o"))).alias("o"), F.when(double, T.num(F.col("o"))).alias("n"))


def unpivot(*tables: str, types: bool = True) -> str:
    """SQL for the triples of tables, as split_object gives them."""
    parts = []
    for t in tables:
        key, columns = MAPPED[t]
        s = f"'urn:kg:{t}/' || {key}"
        if types:
            parts.append(f"SELECT {s} AS s, '{T.TYPE}' AS p, 'urn:kg:{t.capitalize()}' AS o, CAST(NULL AS DOUBLE) AS n FROM {t}")
        for c, kind in columns.items():
            o = {"int": f"CAST({c} AS VARCHAR)", "str": c, "num": "CAST(NULL AS VARCHAR)"}.get(kind, f"'urn:kg:{kind}/' || {c}")
            parts.append(f"SELECT {s} AS s, 'urn:kg:{t}#{c}' AS p, {o} AS o, {c if kind == 'num' else 'CAST(NULL AS DOUBLE)'} AS n FROM {t}")
    if "region" in tables and "nation" in tables:
        parts.append("SELECT 'urn:kg:region/' || n_regionkey, 'urn:kg:region#hasNation', 'urn:kg:nation/' || n_nationkey, NULL FROM nation")
    if "nation" in tables and "customer" in tables:
        parts.append("SELECT 'urn:kg:nation/' || c_nationkey, 'urn:kg:nation#hasCustomer', 'urn:kg:customer/' || c_custkey, NULL FROM customer")
    return " UNION ALL ".join(parts)


CN, ALL = unpivot("customer", "nation"), unpivot("customer", "nation", "region")


# Triple patterns


def _tp(name: str, sql_where: str, **fixed: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return split_object(mapped(spark, sf_dir, "customer", "nation").match(**fixed))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT * FROM ({CN}) WHERE {sql_where}"


_tp("tp1_all", "1 = 1")
_tp("tp2_subject", "s = 'urn:kg:customer/7'", s="urn:kg:customer/7")
_tp("tp3_pred", "p = 'urn:kg:customer#c_mktsegment'", p="urn:kg:customer#c_mktsegment")
_tp("tp4_object", "o = 'urn:kg:nation/3'", o="urn:kg:nation/3")
_tp("tp5_sp", "s = 'urn:kg:nation/3' AND p = 'urn:kg:nation#hasCustomer'", s="urn:kg:nation/3", p="urn:kg:nation#hasCustomer")
_tp("tp6_po", "p = 'urn:kg:customer#c_mktsegment' AND o = 'BUILDING'", p="urn:kg:customer#c_mktsegment", o='"BUILDING"')
_tp("tp7_so", "s = 'urn:kg:customer/7' AND o = '7'", s="urn:kg:customer/7", o=T.literal(7))
_tp("tp8_spo", "s = 'urn:kg:nation/3' AND p = 'urn:kg:nation#n_nationkey' AND o = '3'", s="urn:kg:nation/3", p="urn:kg:nation#n_nationkey", o=T.literal(3))
_tp("tp9_absent", "s = 'urn:kg:customer/none'", s="urn:kg:customer/none")


@query("SELECT 'urn:kg:x/' || n_nationkey AS x FROM nation WHERE n_nationkey = n_regionkey")
def tp10_same_var(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    at = lambda c: F.concat(F.lit("urn:kg:x/"), F.col(c).cast("string"))
    graph = graph_of(nations.select(at("n_nationkey").alias("s"), F.lit("urn:same").alias("p"), at("n_regionkey").alias("o")))
    return graph.scan(TriplePattern(V("x"), "urn:same", V("x"))).toDF("x")


@query("SELECT 'urn:kg:customer/' || c_custkey AS s, c_mktsegment AS o FROM customer WHERE c_mktsegment = 'BUILDING'")
def tp11_strings(spark, sf_dir):
    found = mapped(spark, sf_dir, "customer").match("", "urn:kg:customer#c_mktsegment", '"BUILDING"')
    return found.select("s", T.lex(F.col("o")).alias("o"))


@query(f"SELECT count(*) AS triples FROM ({ALL})")
def tp12_header(spark, sf_dir):
    graph = mapped(spark, sf_dir, "customer", "nation", "region")
    v = stats.void(graph)
    header = v.select(F.stack(F.lit(2), F.lit("triples"), F.col("triples"), F.lit("shared"), F.col("shared")).alias("k", "n"))
    rows = header.select(F.lit("urn:dataset").alias("s"), F.concat(F.lit("urn:void#"), "k").alias("p"), T.of_column(F.col("n"), "bigint").alias("o"))
    return Graph(rows).match(p="urn:void#triples").select(T.num(F.col("o")).cast("bigint").alias("triples"))


for _order in ("spo", "sop", "pso", "pos", "osp", "ops"):

    def _sorted(spark, sf_dir, order=_order):
        """All triples, with the position that the sorted graph gives each."""
        rows, _ = numbered(mapped(spark, sf_dir, "nation", "region").match(order=order), *order, first=1)
        return rows.select("at", "s", "p", T.lex(F.col("o")).alias("o"))

    QUERIES[f"tp13_order_{_order}"] = _sorted
    # a literal's quotes stand before letters; the tables' other objects are IRIs and whole numbers
    _KEY = "CASE WHEN o LIKE 'urn:%' THEN o WHEN p LIKE '%key' THEN '\"' || o || '\"^^' ELSE '\"' || o || '\"' END"
    ORACLE_SQL[f"tp13_order_{_order}"] = f"SELECT row_number() OVER (ORDER BY {', '.join(_KEY if c == 'o' else c for c in _order)}) AS at, s, p, o FROM ({unpivot('nation', 'region')})"


@query(f"SELECT p AS term FROM ({CN})")
def tp14_role(spark, sf_dir):
    return mapped(spark, sf_dir, "customer", "nation").component("p")


@query(f"SELECT count(*) AS n FROM ({CN}) WHERE p = 'urn:kg:customer#c_nationkey' AND o = 'urn:kg:nation/3'")
def tp15_find(spark, sf_dir):
    return mapped(spark, sf_dir, "customer", "nation").match(p="urn:kg:customer#c_nationkey", o="urn:kg:nation/3").agg(F.count("*").alias("n"))


# Stars

STAR = StarPattern(V("c"), tuple((f"{BASE}customer#{c}", V(c)) for c in ("c_name", "c_mktsegment", "c_acctbal")))
STAR_SQL = "SELECT 'urn:kg:customer/' || c_custkey AS c, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer"


def _star_out(df: DataFrame) -> DataFrame:
    names = {"c": "c", "name": "c_name", "segment": "c_mktsegment"}
    return df.select(*(T.lex(F.col(var(v))).alias(n) for n, v in names.items()), T.num(F.col(var("c_acctbal"))).alias("balance"))


@query(STAR_SQL)
def st1_star3(spark, sf_dir):
    return _star_out(joins.star_by_joins(mapped(spark, sf_dir, "customer"), STAR))


@query(STAR_SQL)
def st2_star3_onepass(spark, sf_dir):
    return _star_out(joins.star_by_groups(mapped(spark, sf_dir, "customer"), STAR))


@query(STAR_SQL)
def st3_star3_widerow(spark, sf_dir):
    return _star_out(mapped(spark, sf_dir, "customer").wide(STAR))


@query(STAR_SQL)
def st6_star_search(spark, sf_dir):
    return _star_out(joins.match_star(mapped(spark, sf_dir, "customer"), STAR))


DID = "SELECT DISTINCT user_id AS u, event_type AS e FROM events"
ask("st1_repeat_pred", "events customer", "SELECT ?u ?a ?b WHERE { ?u cu:did ?a ; cu:did ?b }", {"u": "str", "a": "str", "b": "str"},
    f"WITH d AS ({DID}) SELECT 'urn:kg:customer/' || x.u AS u, x.e AS a, y.e AS b FROM d x JOIN d y ON x.u = y.u")


@query(f"WITH d AS ({DID}) SELECT 'urn:kg:customer/' || x.u AS s, x.e AS a, CASE WHEN x.e = y.e THEN NULL ELSE y.e END AS b FROM d x JOIN d y ON x.u = y.u AND x.e <= y.e")
def st4_star_fragment_dedup(spark, sf_dir):
    star = StarPattern(V("u"), ((f"{BASE}customer#did", V("a")), (f"{BASE}customer#did", V("b"))))
    found = joins.distinct_stars(mapped(spark, sf_dir, "events", "customer"), star)
    return found.select("s", T.lex(F.col("pairs")[0]["o"]).alias("a"), T.lex(F.get("pairs", F.lit(1))["o"]).alias("b"))


@query("SELECT 'urn:kg:customer/' || c_custkey AS c, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def st5_star_values(spark, sf_dir):
    graph = mapped(spark, sf_dir, "customer")
    values = joins.bindings(graph, ["c_mktsegment"], [('"BUILDING"',), ('"MACHINERY"',), ('"MACHINERY"',)])
    return _star_out(joins.with_bindings(joins.match_star(graph, STAR), values, 2))


ask("st7_const_object", "customer", 'SELECT ?c ?name WHERE { ?c cu:c_mktsegment "BUILDING" ; cu:c_name ?name }', {"c": "str", "name": "str"}, "SELECT 'urn:kg:customer/' || c_custkey AS c, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
ask("st7_const_subject", "customer", "SELECT ?name ?seg WHERE { kg:customer\\/7 cu:c_mktsegment ?seg ; cu:c_name ?name }", {"name": "str", "seg": "str"}, "SELECT c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey = 7")


@query(f"SELECT t.s AS r, t.p AS p, t.o AS o, r_name AS name FROM ({unpivot('region')}) t JOIN region ON t.s = 'urn:kg:region/' || r_regionkey")
def st7_var_pred(spark, sf_dir):
    star = StarPattern(V("r"), ((V("p"), V("o")), (f"{BASE}region#r_name", V("name"))))
    found = joins.match_star(mapped(spark, sf_dir, "region"), star)
    return found.select(F.col(var("r")).alias("r"), F.col(var("p")).alias("p"), T.lex(F.col(var("o"))).alias("o"), T.lex(F.col(var("name"))).alias("name"))


# Joins and access methods

OCN = [TriplePattern(V("o"), f"{BASE}orders#o_custkey", V("c")), TriplePattern(V("c"), f"{BASE}customer#c_nationkey", V("n")), TriplePattern(V("n"), f"{BASE}nation#n_name", V("name")), TriplePattern(V("o"), f"{BASE}orders#o_orderstatus", '"F"')]
OCN_SQL = "SELECT 'urn:kg:orders/' || o_orderkey AS o, 'urn:kg:customer/' || c_custkey AS c, n_name AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'"


def _method(name: str, method: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = joins.evaluate(mapped(spark, sf_dir, "orders", "customer", "nation"), OCN, method)
        return found.select(F.col(var("o")).alias("o"), F.col(var("c")).alias("c"), T.lex(F.col(var("name"))).alias("name"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = OCN_SQL


_method("bj1_bind_join", "brtpf")
_method("bj2_nested", "tpf")
_method("bj3_star_join", "spf")
_method("bj7_bgp_chain", "endpoint")


@query(f"WITH r AS ({OCN_SQL}) SELECT count(*) AS tpf, count(*) AS brtpf, count(*) AS spf, count(*) AS endpoint FROM r")
def bj6_methods_agree(spark, sf_dir):
    graph = mapped(spark, sf_dir, "orders", "customer", "nation")
    out = None
    for m in ("tpf", "brtpf", "spf", "endpoint"):
        one = joins.evaluate(graph, OCN, m).agg(F.count("*").alias(m))
        out = one if out is None else out.crossJoin(one)
    return out


@query("SELECT 'urn:kg:nation/' || n_nationkey AS n, 'urn:kg:customer/' || c_custkey AS c FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def bj4_extension(spark, sf_dir):
    """Bindings of one pattern extended by another's matches."""
    graph = mapped(spark, sf_dir, "nation", "customer")
    bound = graph.scan(TriplePattern(V("n"), f"{BASE}nation#n_regionkey", "urn:kg:region/1"))
    return joins.join(bound, graph.scan(TriplePattern(V("c"), f"{BASE}customer#c_nationkey", V("n")))).select(F.col(var("n")).alias("n"), F.col(var("c")).alias("c"))


ask("bj5_cartesian", "region nation", "SELECT ?a ?b WHERE { kg:region\\/1 re:hasNation ?a . kg:region\\/2 re:hasNation ?b }", {"a": "str", "b": "str"},
    "SELECT 'urn:kg:nation/' || x.n_nationkey AS a, 'urn:kg:nation/' || y.n_nationkey AS b FROM nation x CROSS JOIN nation y WHERE x.n_regionkey = 1 AND y.n_regionkey = 2")

ask("sh2_path2", "orders customer", "SELECT ?o ?n WHERE { ?o or:o_custkey ?c . ?c cu:c_nationkey ?n }", {"o": "str", "n": "str"}, "SELECT 'urn:kg:orders/' || o_orderkey AS o, 'urn:kg:nation/' || c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey")
ask("sh2_path3", "lineitem orders customer", "SELECT ?n (COUNT(*) AS ?k) WHERE { ?l li:l_orderkey ?o . ?o or:o_custkey ?c . ?c cu:c_nationkey ?n } GROUP BY ?n", {"n": "str", "k": "int"},
    "SELECT 'urn:kg:nation/' || c_nationkey AS n, count(*) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
ask("sh2_path_varpred", "customer nation region", "SELECT ?c ?p ?n WHERE { ?c ?p ?x . ?x na:n_name ?n }", {"c": "str", "p": "str", "n": "str"},
    "SELECT 'urn:kg:customer/' || c_custkey AS c, 'urn:kg:customer#c_nationkey' AS p, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'urn:kg:region/' || n_regionkey, 'urn:kg:region#hasNation', n_name FROM nation")
ask("sh3_sink", "customer supplier", "SELECT ?c ?s ?n WHERE { ?c cu:c_nationkey ?n . ?s su:s_nationkey ?n }", {"c": "str", "s": "str", "n": "str"},
    "SELECT 'urn:kg:customer/' || c_custkey AS c, 'urn:kg:supplier/' || s_suppkey AS s, 'urn:kg:nation/' || c_nationkey AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey")

# Texts of our own, one of each shape.
TEXTS = {
    "star": "SELECT * WHERE { ?c cu:c_name ?n ; cu:c_mktsegment ?m ; cu:c_acctbal ?b }",
    "path": "SELECT * WHERE { ?o or:o_custkey ?c . ?c cu:c_nationkey ?n . ?n na:n_regionkey ?r }",
    "sink": "SELECT * WHERE { ?c cu:c_nationkey ?n . ?s su:s_nationkey ?n }",
    "two": "SELECT * WHERE { ?c cu:c_name ?n ; cu:c_nationkey ?k . ?k na:n_name ?m ; na:n_regionkey ?r }",
    "many": "SELECT * WHERE { ?a cu:c_name ?n ; cu:c_acctbal ?x . ?b su:s_name ?m . ?c na:n_name ?o . ?d re:r_name ?p }",
    "long": "SELECT * WHERE { ?l li:l_orderkey ?o . ?o or:o_custkey ?c . ?c cu:c_nationkey ?n . ?n na:n_regionkey ?r }",
}


def _patterns(name: str) -> list[TriplePattern]:
    return list(parse(TEXTS[name], PREFIXES).where.patterns)


@query("SELECT * FROM (VALUES ('long', 'l', 1), ('long', 'o', 1), ('long', 'c', 1), ('long', 'n', 1), ('many', 'a', 2), ('many', 'b', 1), ('many', 'c', 1), ('many', 'd', 1), ('path', 'c', 1), ('path', 'n', 1), ('path', 'o', 1), ('sink', 'c', 1), ('sink', 's', 1), ('star', 'c', 3), ('two', 'c', 2), ('two', 'k', 2)) t(query, subject, patterns)")
def sh1_decompose(spark, sf_dir):
    rows = [(q, s.s.name, len(s.pairs)) for q in TEXTS for s in stars(_patterns(q))]
    return spark.createDataFrame(rows, "query string, subject string, patterns int")


@query("SELECT * FROM (VALUES ('star', '1_stars'), ('path', '3_stars'), ('sink', '2_stars'), ('two', '2_stars'), ('many', CAST(NULL AS VARCHAR)), ('long', 'paths')) t(query, shape)")
def sh4_shapes(spark, sf_dir):
    return spark.createDataFrame([(q, shape(_patterns(q))) for q in TEXTS], "query string, shape string")


@query("SELECT 5 AS most, 3.5 AS mean")
def sh5_query_statistics(spark, sf_dir):
    sizes = spark.createDataFrame([(len(_patterns(q)),) for q in TEXTS], "n int")
    return sizes.agg(F.max("n").alias("most"), F.avg("n").alias("mean"))


@query(f"WITH t AS ({ALL}), c AS (SELECT s, count(DISTINCT p) AS k, bool_or(p = 'urn:kg:nation#n_name') AS hit FROM t GROUP BY s) SELECT k AS predicates, count(*) AS subjects FROM c WHERE hit GROUP BY k")
def sh6_family_lookup(spark, sf_dir):
    families = stats.families(stats.characteristic_sets(mapped(spark, sf_dir, "customer", "nation", "region")))
    star = StarPattern(V("n"), ((f"{BASE}nation#n_name", V("x")), (f"{BASE}nation#n_regionkey", V("r"))))
    return stats.family_of(families, star).select(F.size("predicates").cast("bigint").alias("predicates"), "subjects")


@query("SELECT * FROM (VALUES ('? p ?', 'a p b', TRUE), ('?x p ?x', 'a p b', FALSE), ('?x p ?x', 'a p a', TRUE), ('a p ?', 'b p c', FALSE)) t(pattern, other, contains)")
def sh7_containment(spark, sf_dir):
    cases = [("? p ?", (V(""), "p", V("")), "a p b"), ("?x p ?x", (V("x"), "p", V("x")), "a p b"), ("?x p ?x", (V("x"), "p", V("x")), "a p a"), ("a p ?", ("a", "p", V("")), "b p c")]
    return spark.createDataFrame([(n, o, TriplePattern(*t).contains(TriplePattern(*o.split()))) for n, t, o in cases], "pattern string, other string, contains boolean")


# SPARQL algebra

CUST = "SELECT 'urn:kg:customer/' || c_custkey AS c"
ask("al1_bgp", "customer nation region", "SELECT ?name ?seg ?nation WHERE { ?c cu:c_name ?name ; cu:c_mktsegment ?seg ; cu:c_nationkey ?n . ?n na:n_name ?nation ; na:n_regionkey ?r . ?r re:r_name \"ASIA\" }", {"name": "str", "seg": "str", "nation": "str"},
    "SELECT c_name AS name, c_mktsegment AS seg, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
ask("al2_filter_num", "customer", "SELECT ?c ?b WHERE { ?c cu:c_acctbal ?b FILTER(?b > 5000 && ?b * 2 < 15000.5) }", {"c": "str", "b": "num"}, f"{CUST}, c_acctbal AS b FROM customer WHERE c_acctbal > 5000 AND c_acctbal * 2 < 15000.5")
ask("al2_filter_str", "customer", 'SELECT ?c WHERE { ?c cu:c_mktsegment ?m FILTER(STRSTARTS(?m, "B") || CONTAINS(LCASE(?m), "chine")) }', {"c": "str"}, f"{CUST} FROM customer WHERE c_mktsegment LIKE 'B%' OR lower(c_mktsegment) LIKE '%chine%'")
ask("al2_filter_date", "orders", 'SELECT ?o ?d WHERE { ?o or:o_orderdate ?d FILTER(?d >= "1996-01-01T00:00:00.000000"^^xsd:dateTime && YEAR(?d) < 1998) }', {"o": "str", "d": "time"}, "SELECT 'urn:kg:orders/' || o_orderkey AS o, o_orderdate AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND year(o_orderdate) < 1998")
ask("al2_regex", "nation", 'SELECT ?name WHERE { ?n na:n_name ?name FILTER REGEX(?name, "^[a-m].*[0-9AEIOU]$", "i") }', {"name": "str"}, "SELECT n_name AS name FROM nation WHERE regexp_matches(n_name, '(?i)^[a-m].*[0-9AEIOU]$')")
ask("al2_filter_in", "customer", 'SELECT ?c WHERE { ?c cu:c_mktsegment ?m FILTER(?m IN ("BUILDING", "MACHINERY") && ?m NOT IN ("MACHINERY")) }', {"c": "str"}, f"{CUST} FROM customer WHERE c_mktsegment = 'BUILDING'")
ask("al3_distinct", "customer", "SELECT DISTINCT ?m ?n WHERE { ?c cu:c_mktsegment ?m ; cu:c_nationkey ?n }", {"m": "str", "n": "str"}, "SELECT DISTINCT c_mktsegment AS m, 'urn:kg:nation/' || c_nationkey AS n FROM customer")
ask("al3_reduced", "customer", "SELECT REDUCED ?m WHERE { ?c cu:c_mktsegment ?m }", {"m": "str"}, "SELECT c_mktsegment AS m FROM customer")
ask("al4_count_star", "customer nation", "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }", {"n": "int"}, f"SELECT count(*) AS n FROM ({CN})")
for _c in "spo":
    ask(f"al4_count_distinct_{_c}", "customer nation", f"SELECT (COUNT(DISTINCT ?{_c}) AS ?n) WHERE {{ ?s ?p ?o }}", {"n": "int"}, f"SELECT count(DISTINCT {_c if _c != 'o' else 'struct_pack(a := o, b := n, c := o IS NOT NULL AND p LIKE $$%key$$ AND o NOT LIKE $$urn%$$)'}) AS n FROM ({CN})".replace("$$", "'"))
ask("al4_count_var", "customer", "SELECT (COUNT(?o) AS ?n) WHERE { ?s cu:c_nationkey ?o }", {"n": "int"}, "SELECT count(*) AS n FROM customer")
ask("al5_join", "orders customer", 'SELECT ?o ?seg WHERE { { ?o or:o_custkey ?c } { ?c cu:c_mktsegment ?seg } }', {"o": "str", "seg": "str"}, "SELECT 'urn:kg:orders/' || o_orderkey AS o, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey")
ask("al5_optional", "customer orders", "SELECT ?c ?o WHERE { ?c cu:c_name ?n OPTIONAL { ?o or:o_custkey ?c } }", {"c": "str", "o": "str"}, f"{CUST}, 'urn:kg:orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
ask("al5_optional_filter", "customer orders", "SELECT ?c ?o WHERE { ?c cu:c_acctbal ?b OPTIONAL { ?o or:o_custkey ?c ; or:o_totalprice ?t FILTER(?t > ?b * 50) } }", {"c": "str", "o": "str"}, f"{CUST}, 'urn:kg:orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 50")
# The second OPTIONAL stands inside the first: beside it, a customer without orders, whose ?o is unbound, would meet every order of status F.
ask("al5_optional_chain", "customer orders", "SELECT ?c ?o ?s WHERE { ?c cu:c_custkey ?k OPTIONAL { ?o or:o_custkey ?c OPTIONAL { ?o or:o_orderstatus ?s FILTER(?s = \"F\") } } FILTER(BOUND(?o)) }", {"c": "str", "o": "str", "s": "str"}, f"{CUST}, 'urn:kg:orders/' || o_orderkey AS o, CASE WHEN o_orderstatus = 'F' THEN 'F' END AS s FROM customer JOIN orders ON o_custkey = c_custkey")
ask("al5_union", "customer supplier", "SELECT ?x ?n WHERE { { ?x cu:c_name ?n } UNION { ?x su:s_name ?n } }", {"x": "str", "n": "str"}, "SELECT 'urn:kg:customer/' || c_custkey AS x, c_name AS n FROM customer UNION ALL SELECT 'urn:kg:supplier/' || s_suppkey, s_name FROM supplier")
ask("al5_minus", "customer orders", "SELECT ?c WHERE { ?c cu:c_name ?n MINUS { ?o or:o_custkey ?c ; or:o_orderstatus \"F\" } }", {"c": "str"}, f"{CUST} FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
ask("al5_exists", "customer orders", "SELECT ?c WHERE { ?c cu:c_acctbal ?b FILTER EXISTS { ?o or:o_custkey ?c ; or:o_totalprice ?t FILTER(?t > ?b * 100) } }", {"c": "str"}, f"{CUST} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 100)")
ask("al5_not_exists", "customer orders", "SELECT ?c WHERE { ?c cu:c_name ?n FILTER NOT EXISTS { ?o or:o_custkey ?c } }", {"c": "str"}, f"{CUST} FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
ask("al6_bind", "customer", 'SELECT ?c ?label ?half WHERE { ?c cu:c_name ?n ; cu:c_mktsegment ?m ; cu:c_acctbal ?b BIND(CONCAT(?n, "-", ?m) AS ?label) BIND(?b / 2 AS ?half) }', {"c": "str", "label": "str", "half": "num"}, f"{CUST}, c_name || '-' || c_mktsegment AS label, c_acctbal / 2 AS half FROM customer")
ask("al6_values", "customer nation", 'SELECT ?c ?m ?n WHERE { VALUES (?m ?n) { ("BUILDING" kg:nation\\/3) ("MACHINERY" UNDEF) } ?c cu:c_mktsegment ?m ; cu:c_nationkey ?n }', {"c": "str", "m": "str", "n": "str"}, f"{CUST}, c_mktsegment AS m, 'urn:kg:nation/' || c_nationkey AS n FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_nationkey = 3) OR c_mktsegment = 'MACHINERY'")
ask("al6_subquery", "customer orders", "SELECT ?name ?k WHERE { { SELECT ?c (COUNT(?o) AS ?k) WHERE { ?o or:o_custkey ?c } GROUP BY ?c HAVING(COUNT(?o) > 12) } ?c cu:c_name ?name }", {"name": "str", "k": "int"}, "SELECT c_name AS name, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 12")
ask("al7_topk", "customer", "SELECT ?c ?b WHERE { ?c cu:c_acctbal ?b } ORDER BY DESC(?b) ?c LIMIT 25", {"c": "str", "b": "num"}, f"{CUST}, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c LIMIT 25")
ask("al7_offset", "customer", "SELECT ?c ?b WHERE { ?c cu:c_acctbal ?b } ORDER BY ?b ?c LIMIT 20 OFFSET 10", {"c": "str", "b": "num"}, f"{CUST}, c_acctbal AS b FROM customer ORDER BY c_acctbal, c LIMIT 20 OFFSET 10")
BYN = "FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
_G = "WHERE { ?c cu:c_nationkey ?n ; cu:c_acctbal ?b ; cu:c_mktsegment ?m . ?n na:n_name ?name } GROUP BY ?name"
ask("al8_group_count", "customer nation", f"SELECT ?name (COUNT(?c) AS ?k) (COUNT(DISTINCT ?m) AS ?d) {_G}", {"name": "str", "k": "int", "d": "int"}, f"SELECT n_name AS name, count(*) AS k, count(DISTINCT c_mktsegment) AS d {BYN}")
ask("al8_group_sum", "customer nation", f"SELECT ?name (SUM(?b) AS ?t) {_G}", {"name": "str", "t": "num"}, f"SELECT n_name AS name, sum(c_acctbal) AS t {BYN}")
ask("al8_group_avg", "customer nation", f"SELECT ?name (AVG(?b) AS ?t) {_G}", {"name": "str", "t": "num"}, f"SELECT n_name AS name, avg(c_acctbal) AS t {BYN}")
ask("al8_group_minmax", "customer nation", f"SELECT ?name (MIN(?b) AS ?l) (MAX(?b) AS ?h) (SAMPLE(?m) AS ?s) {_G}", {"name": "str", "l": "num", "h": "num", "s": "str"}, f"SELECT n_name AS name, min(c_acctbal) AS l, max(c_acctbal) AS h, min(c_mktsegment) AS s {BYN}")
ask("al8_group_having", "customer nation", f"SELECT ?name (COUNT(*) AS ?k) {_G} HAVING(AVG(?b) > 4500)", {"name": "str", "k": "int"}, f"SELECT n_name AS name, count(*) AS k {BYN} HAVING avg(c_acctbal) > 4500")
ask("al8_group_concat", "customer nation", f'SELECT ?name (GROUP_CONCAT(DISTINCT ?m; SEPARATOR="|") AS ?all) {_G}', {"name": "str", "all": "str"}, f"SELECT n_name AS name, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS all {BYN}".replace("AS all", 'AS "all"'))

# Property paths

ask("al9_seq", "customer nation region", "SELECT ?c ?r WHERE { ?c cu:c_nationkey/na:n_regionkey/re:r_name ?r }", {"c": "str", "r": "str"}, f"{CUST}, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
ask("al9_alt", "customer supplier", "SELECT ?x ?n WHERE { ?x cu:c_nationkey|su:s_nationkey ?n }", {"x": "str", "n": "str"}, "SELECT 'urn:kg:customer/' || c_custkey AS x, 'urn:kg:nation/' || c_nationkey AS n FROM customer UNION ALL SELECT 'urn:kg:supplier/' || s_suppkey, 'urn:kg:nation/' || s_nationkey FROM supplier")
ask("al9_inv", "nation", "SELECT ?r ?n WHERE { ?r ^na:n_regionkey ?n }", {"r": "str", "n": "str"}, "SELECT 'urn:kg:region/' || n_regionkey AS r, 'urn:kg:nation/' || n_nationkey AS n FROM nation")
ask("al9_opt", "nation", "SELECT ?x WHERE { kg:nation\\/3 na:n_regionkey? ?x }", {"x": "str"}, "SELECT 'urn:kg:nation/3' AS x UNION SELECT 'urn:kg:region/' || n_regionkey FROM nation WHERE n_nationkey = 3")
UP = "(cu:c_nationkey|na:n_regionkey)"
ask("al9_plus", "customer nation", f"SELECT ?c ?x WHERE {{ ?c {UP}+ ?x }}", {"c": "str", "x": "str"},
    f"{CUST}, 'urn:kg:nation/' || c_nationkey AS x FROM customer UNION {CUST}, 'urn:kg:region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'urn:kg:nation/' || n_nationkey, 'urn:kg:region/' || n_regionkey FROM nation")
ask("al9_star", "customer nation", f"SELECT ?x WHERE {{ kg:customer\\/7 {UP}* ?x }}", {"x": "str"},
    "SELECT 'urn:kg:customer/7' AS x UNION SELECT 'urn:kg:nation/' || c_nationkey FROM customer WHERE c_custkey = 7 UNION SELECT 'urn:kg:region/' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
ask("al9_not", "nation", "SELECT ?s ?o WHERE { ?s !(na:n_name|na:n_nationkey|rdf:type) ?o }", {"s": "str", "o": "str"}, "SELECT 'urn:kg:nation/' || n_nationkey AS s, 'urn:kg:region/' || n_regionkey AS o FROM nation")

# Forms


@query("SELECT count(*) > 0 AS ask FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def al10_ask(spark, sf_dir):
    return sparql(mapped(spark, sf_dir, "customer"), 'ASK { ?c cu:c_mktsegment "BUILDING" ; cu:c_nationkey kg:nation\\/3 }', PREFIXES)


@query("SELECT DISTINCT 'urn:kg:region/' || n_regionkey AS s, 'urn:kg:hasSegment' AS p, c_mktsegment AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def al10_construct(spark, sf_dir):
    out = sparql(mapped(spark, sf_dir, "customer", "nation"), "CONSTRUCT { ?r kg:hasSegment ?m } WHERE { ?c cu:c_mktsegment ?m ; cu:c_nationkey ?n . ?n na:n_regionkey ?r }", PREFIXES)
    return out.select("s", "p", T.lex(F.col("o")).alias("o"))


@query(f"SELECT DISTINCT * FROM ({CN}) WHERE s IN (SELECT 'urn:kg:customer/' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def al10_describe(spark, sf_dir):
    return split_object(sparql(mapped(spark, sf_dir, "customer", "nation"), 'DESCRIBE ?c WHERE { ?c cu:c_mktsegment "BUILDING" }', PREFIXES))


@query("SELECT DISTINCT 'urn:kg:nation/' || c_nationkey AS s, 'urn:kg:seen' AS p, 'urn:kg:yes' AS o FROM customer")
def al11_construct_distinct(spark, sf_dir):
    return sparql(mapped(spark, sf_dir, "customer"), "CONSTRUCT { ?n kg:seen kg:yes } WHERE { ?c cu:c_nationkey ?n }", PREFIXES)


@query("SELECT 'urn:kg:nation/' || n_nationkey AS s, 'urn:kg:region/' || n_regionkey AS o FROM nation WHERE n_regionkey = 1")
def al12_named_graph(spark, sf_dir):
    nations = mapped(spark, sf_dir, "nation").pairs(f"{BASE}nation#n_regionkey")
    graph = Graph(nations.select("s", F.lit("urn:in").alias("p"), "o", F.concat(F.lit("urn:g:"), F.regexp_extract("o", r"(\d+)$", 1)).alias("g")))
    return sparql(graph, "SELECT ?s ?o WHERE { GRAPH <urn:g:1> { ?s <urn:in> ?o } }")


@query("SELECT 'urn:kg:region#r_name' AS a, 'urn:kg:Region' AS b")
def al13_prefixes(spark, sf_dir):
    text = "PREFIX x: <urn:kg:region#> BASE <urn:kg:> SELECT * WHERE { BIND(x:r_name AS ?a) BIND(<urn:kg:Region> AS ?b) }"
    return sparql(mapped(spark, sf_dir, "region"), text)


# Fragments


def _page(name: str, sql: str, run: Callable[[SparkSession, str], DataFrame]) -> None:
    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = " ".join(sql.split())


SEGMENT = TriplePattern(V("s"), f"{BASE}customer#c_mktsegment", V("o"))
SEGMENT_SQL = "SELECT 'urn:kg:customer/' || c_custkey AS s, 'urn:kg:customer#c_mktsegment' AS p, c_mktsegment AS o FROM customer"
_lexed = lambda df: df.select("s", "p", T.lex(F.col("o")).alias("o"))
for _n, _k in (("fr2_tpf_page1", 1), ("fr2_tpf_page2", 2), ("fr2_tpf_past_end", 10**7)):
    _page(_n, f"{SEGMENT_SQL} ORDER BY s, p, o LIMIT 100 OFFSET {100 * (_k - 1)}", lambda spark, sf_dir, k=_k: _lexed(fragments.tpf(mapped(spark, sf_dir, "customer"), SEGMENT, k).data))
_page("fr3_tpf_ordered", f"SELECT * FROM ({unpivot('nation')}) ORDER BY s, p, o LIMIT 100", lambda spark, sf_dir: split_object(fragments.tpf(mapped(spark, sf_dir, "nation"), TriplePattern(V("s"), V("p"), V("o")), 1).data))
_page("fr4_brtpf", f"SELECT * FROM ({SEGMENT_SQL}) WHERE o IN ('BUILDING', 'MACHINERY') ORDER BY s, p, o LIMIT 100",
      lambda spark, sf_dir: _lexed(fragments.brtpf(mapped(spark, sf_dir, "customer"), SEGMENT, ["o", "other"], [('"BUILDING"', "urn:1"), ('"MACHINERY"', "urn:1"), ('"BUILDING"', "urn:2")]).data))
_page("fr5_star_page", "SELECT 'urn:kg:customer/' || c_custkey AS s, c_mktsegment AS segment, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY s LIMIT 100",
      lambda spark, sf_dir: fragments.spf(mapped(spark, sf_dir, "customer"), StarPattern(V("c"), ((f"{BASE}customer#c_mktsegment", V("m")), (f"{BASE}customer#c_name", V("n")))), ["m"], [('"BUILDING"',)]).data
      .select("s", T.lex(F.col("pairs")[0]["o"]).alias("segment"), T.lex(F.col("pairs")[1]["o"]).alias("name")))
_page("fr1_routing", "SELECT * FROM (VALUES ('brtpf', 1), ('spf', 3), ('tpf', 1)) t(kind, page)", lambda spark, sf_dir: spark.createDataFrame(
    [(r.kind, r.page) for r in map(fragments.from_url, ("/d?subject=%3Fs&page=x", "/d?values=%28%3Fs%29%7B%28%3Curn%3A1%3E%29%7D&predicate=urn:p&page=0", "/d?triples=1&star=%5Bp1,urn:p;o1,%3Fo%5D&page=3"))], "kind string, page int"))
_page("fr6_request_round_trip", "SELECT TRUE AS same", lambda spark, sf_dir: spark.createDataFrame([(fragments.from_url(fragments.to_url(r := fragments.Request(
    "spf", "d", 2, None, StarPattern(V("s"), (("urn:p", '"a,b;c [\\"x\\"]"@en'), ("urn:q", V("o")))), ("o", "s"), (("urn:1", None), ('"l"', "_:b"))))) .values[0] == r.values[0],)], "same boolean"))


def _fragment(spark: SparkSession, sf_dir: str, page: int) -> fragments.Fragment:
    return fragments.tpf(mapped(spark, sf_dir, "customer"), SEGMENT, page, dataset="kg", base="http://x")


_page("fr7_metadata", "SELECT 'http://rdfs.org/ns/void#triples' AS p, CAST(count(*) AS BIGINT) AS o FROM customer UNION ALL SELECT 'http://www.w3.org/ns/hydra/core#totalItems', CAST(count(*) AS BIGINT) FROM customer UNION ALL SELECT 'http://www.w3.org/ns/hydra/core#itemsPerPage', CAST(100 AS BIGINT)",
      lambda spark, sf_dir: _fragment(spark, sf_dir, 1).metadata().where(T.num(F.col("o")).isNotNull()).select("p", T.num(F.col("o")).cast("bigint").alias("o")))
_page("fr8_controls", "SELECT * FROM (VALUES ('http://www.w3.org/ns/hydra/core#first', 1), ('http://www.w3.org/ns/hydra/core#previous', 1)) t(p, page) UNION ALL SELECT 'http://www.w3.org/ns/hydra/core#next', 3 FROM customer HAVING count(*) > 200",
      lambda spark, sf_dir: _fragment(spark, sf_dir, 2).controls().where(F.col("p").rlike("#(first|next|previous)$")).select("p", F.coalesce(F.regexp_extract("o", r"page=(\d+)", 1).try_cast("int"), F.lit(1)).alias("page")))


def _kept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of one request and the first again, all from rows that are sorted once."""
    graph, pages = mapped(spark, sf_dir, "customer"), fragments.PageCache(2)
    found = [fragments.tpf(graph, SEGMENT, k, pages=pages) for k in (1, 2, 3, 1)]
    parts = [_lexed(f.data).select(F.lit(i).alias("ask"), "s", "o", F.lit(pages.hits).alias("hits")) for i, f in enumerate(found)]
    return reduce(DataFrame.unionByName, parts)


_page("fr9_page_cache", f"SELECT a.ask, s, o, 3 AS hits FROM (VALUES (0, 0), (1, 100), (2, 200), (3, 0)) a(ask, low) JOIN (SELECT s, o, row_number() OVER (ORDER BY s, p, o) - 1 AS n FROM ({SEGMENT_SQL})) t ON t.n >= low AND t.n < low + 100", _kept_pages)


def _asked_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern's pages followed to the last, twice: the second time none is requested."""
    graph, pages = mapped(spark, sf_dir, "customer"), fragments.PageCache()
    client = fragments.Client(lambda url: fragments.answer(graph, url, 40, pages=pages))
    request = fragments.Request("tpf", "d", 1, TriplePattern(V("s"), f"{BASE}customer#c_nationkey", "urn:kg:nation/3"))
    rows = [(turn, f.request.page, f.total, f.data.count()) for turn in (1, 2) for f in client.pages(request)]
    return spark.createDataFrame(rows, "turn int, page int, total long, n long").withColumns({"requests": F.lit(client.requests), "hits": F.lit(client.hits)})


_page("fr10_client_cache", """WITH c AS (SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 40.0)) AS INTEGER) AS pages FROM customer WHERE c_nationkey = 3)
    SELECT turn, page, total, least(40, total - 40 * (page - 1)) AS n, pages AS requests, pages AS hits FROM c, (VALUES (1), (2)) t(turn), (SELECT CAST(range AS INTEGER) AS page FROM range(1, 100000)) p WHERE page <= pages""", _asked_again)
_page("fr11_drain", f"SELECT * FROM ({unpivot('nation')})", lambda spark, sf_dir: split_object(fragments.drain(lambda k: fragments.tpf(mapped(spark, sf_dir, "nation"), TriplePattern(V("s"), V("p"), V("o")), k, 40))))
_page("fr12_metadata_filter", f"{SEGMENT_SQL} ORDER BY s, p, o LIMIT 100", lambda spark, sf_dir: (lambda f: _lexed(fragments.without_metadata(f.data.unionByName(f.metadata()).unionByName(f.controls()), fragments.to_url(f.request, f.base))))(_fragment(spark, sf_dir, 1)))


# Statistics

T_ALL = f"WITH t AS (SELECT s, p, coalesce(o, CAST(n AS VARCHAR)) || CASE WHEN n IS NOT NULL THEN '^d' WHEN p LIKE '%key' AND o NOT LIKE 'urn%' THEN '^i' ELSE '' END AS o FROM ({ALL}))"


@query(f"{T_ALL} SELECT (SELECT count(*) FROM t) AS triples, (SELECT count(DISTINCT p) FROM t) AS predicates, (SELECT count(DISTINCT s) FROM t) AS subjects, (SELECT count(DISTINCT o) FROM t) AS objects, (SELECT count(*) FROM (SELECT DISTINCT s FROM t) WHERE s IN (SELECT o FROM t)) AS shared")
def ag1_void(spark, sf_dir):
    return stats.void(mapped(spark, sf_dir, "customer", "nation", "region")).select("triples", "predicates", "subjects", "objects", "shared")


@query(f"{T_ALL} SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM t GROUP BY p")
def ag2_pred_counts(spark, sf_dir):
    return stats.predicate_counts(mapped(spark, sf_dir, "customer", "nation", "region"))


@query(f"SELECT o, count(*) AS triples FROM ({ALL}) WHERE o LIKE 'urn:%' GROUP BY o")
def ag3_obj_counts(spark, sf_dir):
    return stats.object_counts(mapped(spark, sf_dir, "customer", "nation", "region")).where("o like 'urn:%'")


SETS = f"{T_ALL}, c AS (SELECT s, string_agg(DISTINCT p, ' ' ORDER BY p) AS predicates FROM t GROUP BY s)"


@query(f"{SETS}, n AS (SELECT predicates, count(*) AS subjects FROM c GROUP BY predicates) SELECT predicates, subjects, p, count(*) AS triples, count(DISTINCT o) AS objects FROM t JOIN c USING (s) JOIN n USING (predicates) GROUP BY predicates, subjects, p")
def ag4_char_sets(spark, sf_dir):
    sets = stats.characteristic_sets(mapped(spark, sf_dir, "customer", "nation", "region"))
    return sets.select(F.array_join("predicates", " ").alias("predicates"), "subjects", F.explode("of").alias("p", "v")).select("predicates", "subjects", "p", "v.triples", "v.objects")


EST = StarPattern(V("n"), ((f"{BASE}nation#n_name", V("x")), (f"{BASE}nation#hasCustomer", V("c")), (f"{BASE}nation#n_regionkey", "urn:kg:region/1")))


@query(f"""{SETS}, n AS (SELECT predicates, count(*) AS k FROM c GROUP BY predicates), e AS (SELECT predicates, k, p, count(*) AS triples, count(DISTINCT o) AS objects FROM t JOIN c USING (s) JOIN n USING (predicates) GROUP BY predicates, k, p)
    SELECT coalesce(sum(a.k * (CAST(a.triples AS DOUBLE) / a.k) * (CAST(b.triples AS DOUBLE) / a.k) * (CAST(d.triples AS DOUBLE) / a.k) / d.objects), 0) AS estimate FROM e a JOIN e b USING (predicates) JOIN e d USING (predicates)
    WHERE a.p = 'urn:kg:nation#n_name' AND b.p = 'urn:kg:nation#hasCustomer' AND d.p = 'urn:kg:nation#n_regionkey'""")
def ag5_cs_estimate(spark, sf_dir):
    return stats.estimate_star(stats.characteristic_sets(mapped(spark, sf_dir, "customer", "nation", "region")), EST).select(F.round("estimate", 6).alias("estimate"))


ORACLE_SQL["ag5_cs_estimate"] = ORACLE_SQL["ag5_cs_estimate"].replace("SELECT coalesce(sum(", "SELECT round(coalesce(sum(").replace(", 0) AS estimate", ", 0), 6) AS estimate")


@query(f"{T_ALL} SELECT round(CAST((SELECT count(DISTINCT s) FROM t) AS DOUBLE) * ((SELECT count(*) FROM t WHERE p = 'urn:kg:nation#n_name') / CAST((SELECT count(DISTINCT s) FROM t) AS DOUBLE)) * ((SELECT count(*) FROM t WHERE p = 'urn:kg:nation#n_regionkey') / CAST((SELECT count(DISTINCT s) FROM t) AS DOUBLE)), 6) AS estimate")
def ag6_estimate(spark, sf_dir):
    graph = mapped(spark, sf_dir, "customer", "nation", "region")
    star = StarPattern(V("n"), ((f"{BASE}nation#n_name", V("x")), (f"{BASE}nation#n_regionkey", V("r"))))
    subjects = stats.void(graph).first()["subjects"]
    return spark.createDataFrame([(round(stats.estimate_star_simply(stats.statistics(graph), subjects, star).value, 6),)], "estimate double")


@query(f"{T_ALL} SELECT 'all' AS pattern, CAST(count(*) AS DOUBLE) AS estimate, 'EXACT' AS kind FROM t UNION ALL SELECT 'name', CAST(count(*) AS DOUBLE), 'EXACT' FROM t WHERE p = 'urn:kg:nation#n_name' UNION ALL SELECT 'unknown', 0.0, 'EXACT'")
def ag7_stat(spark, sf_dir):
    s = stats.statistics(mapped(spark, sf_dir, "customer", "nation", "region"))
    cases = {"all": TriplePattern(V("s"), V("p"), V("o")), "name": TriplePattern(V("s"), f"{BASE}nation#n_name", V("o")), "unknown": TriplePattern(V("s"), "urn:none", V("o"))}
    return spark.createDataFrame([(k, (e := stats.estimate(s, t)).value, e.kind.name) for k, t in cases.items()], "pattern string, estimate double, kind string")


# Dictionary

_SECTION = f"{T_ALL}, s AS (SELECT DISTINCT s AS t FROM t), o AS (SELECT DISTINCT o AS t FROM t)"


@query(f"{_SECTION} SELECT (SELECT count(*) FROM s WHERE t IN (SELECT t FROM o)) AS shared, (SELECT count(*) FROM s WHERE t NOT IN (SELECT t FROM o)) AS subjects, (SELECT count(*) FROM o WHERE t NOT IN (SELECT t FROM s)) AS objects, (SELECT count(DISTINCT p) FROM t) AS predicates")
def di1_sections(spark, sf_dir):
    d = dictionary.Dictionary.build(mapped(spark, sf_dir, "customer", "nation", "region"))
    return spark.createDataFrame([tuple(d.sizes.values())], ", ".join(f"{k} bigint" for k in d.sizes))


@query(f"SELECT * FROM ({ALL})")
def di2_roundtrip(spark, sf_dir):
    graph = mapped(spark, sf_dir, "customer", "nation", "region")
    d = dictionary.Dictionary.build(graph)
    return split_object(d.decode(d.encode(graph.df)))


# Collections

_NC = "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000"
_NS = "SELECT DISTINCT s_nationkey AS k FROM supplier"


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("k"))


_page("it1_map_filter", "SELECT c_custkey * 2 AS k FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 3", lambda spark, sf_dir: setops.mapped(setops.differing(setops.kept(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_acctbal") > 0), "c_nationkey", 3), k=F.col("c_custkey") * 2))
_page("it2_dedup", "SELECT DISTINCT c_mktsegment AS m FROM customer", lambda spark, sf_dir: setops.dedup(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("m"))))
_page("it2_dedup_adjacent", "SELECT k, v FROM (SELECT c_nationkey AS k, c_custkey AS i, c_mktsegment AS v, lag(c_mktsegment) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer) WHERE b IS NULL OR b <> v",
      lambda spark, sf_dir: setops.dedup_adjacent(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("i"), F.col("c_mktsegment").alias("v")), ["i"], ["k"], ["v"]).select("k", "v"))
_page("it3_limit_count", "SELECT count(*) AS n FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 17)", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy("c_custkey").limit(17).agg(F.count("*").alias("n")))
_page("it4_concat", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey FROM supplier", lambda spark, sf_dir: setops.concat(*_keys(spark, sf_dir)))
_page("it5_merge_annotated", f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'LEFT' WHEN a.k IS NULL THEN 'RIGHT' ELSE 'BOTH' END AS side FROM ({_NC}) a FULL JOIN ({_NS}) b ON a.k = b.k", lambda spark, sf_dir: setops.merge(*_keys(spark, sf_dir)))
_page("it6_merge_reduce", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k", lambda spark, sf_dir: setops.merge_reduce(*_keys(spark, sf_dir), ["k"], F.count("*").alias("n")))
_page("it7_multi_merge", f"SELECT k FROM ({_NC}) UNION ALL SELECT k FROM ({_NS}) UNION ALL SELECT n_nationkey FROM nation", lambda spark, sf_dir: setops.merge_sorted(["k"], *(k.distinct() for k in _keys(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"))))
_page("it8_group_reduce", "SELECT c_mktsegment AS m, max(c_acctbal) AS b FROM customer GROUP BY c_mktsegment", lambda spark, sf_dir: setops.reduce_groups(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("m"), "c_acctbal"), ["m"], F.max("c_acctbal").alias("b")))
_page("it9_flatmap", "SELECT n_nationkey AS k, unnest(string_split(n_name, 'A')) AS part FROM nation", lambda spark, sf_dir: setops.flat_map(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k"), "n_name"), F.split("n_name", "A"), "part").select("k", "part"))
_page("it9_dependent", "SELECT n_nationkey AS k, c_custkey AS c FROM nation JOIN customer ON n_nationkey = c_nationkey", lambda spark, sf_dir: setops.dependent(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("k")), spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("c")), ["k"]))
_page("it10_range", "SELECT CAST(range AS BIGINT) AS n FROM range(3, 40)", lambda spark, sf_dir: setops.numbers(spark, 3, 40))
_page("it12_sort", f"SELECT row_number() OVER (ORDER BY p, s) AS at, s, p FROM ({unpivot('nation')})", lambda spark, sf_dir: numbered(mapped(spark, sf_dir, "nation").match(order="pso").select("s", "p"), "p", "s", first=1)[0].select("at", "s", "p"))
_page("it12_dedup", f"SELECT DISTINCT * FROM ({unpivot('nation')})", lambda spark, sf_dir: (lambda d: split_object(graph_of(d.unionByName(d)).df))(mapped(spark, sf_dir, "nation").df))
_page("it12_remove", f"SELECT * FROM ({unpivot('nation')}) WHERE p <> 'urn:kg:nation#n_name'", lambda spark, sf_dir: split_object(mapped(spark, sf_dir, "nation").remove(p=f"{BASE}nation#n_name").df))
_page("src20_mutable", f"SELECT s, p, o FROM ({unpivot('region')}) WHERE s <> 'urn:kg:region/1' UNION ALL SELECT 'urn:x', 'urn:p', 'o2'",
      lambda spark, sf_dir: (lambda g: _lexed(g.insert(spark.createDataFrame([("urn:x", "urn:p", '"o"')], "s string, p string, o string")).remove(s="urn:kg:region/1").update(("urn:x", "urn:p", '"o"'), ("urn:x", "urn:p", '"o2"')).df))(mapped(spark, sf_dir, "region")))

# Sources and sinks: write, read again, compare


def _folder(spark: SparkSession) -> str:
    """A new place in the folder that driver and executors share."""
    path = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def _round(name: str, write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame], *tables: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _folder(spark)
        write(mapped(spark, sf_dir, *tables).df, path)
        return split_object(read(spark, path))

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT * FROM ({unpivot(*tables)})"


_round("src4_ntriples", writers.ntriples, readers.ntriples, "customer", "nation")
_round("src5_nquads", lambda df, path: writers.lines(df).select(F.regexp_replace("value", r" \.$", " <urn:g> .")).write.text(path), readers.nquads, "nation", "region")
_round("src6_turtle", writers.turtle, lambda spark, path: readers.read(spark, path, "turtle"), "nation", "region")
_round("src8_simple", lambda df, path: writers.lines(df).unionByName(df.sparkSession.createDataFrame([("# a comment",), ("bad line .",), ("",)], "value string")).write.text(path), lambda spark, path: readers.simple(spark, path)[0], "nation")
_round("src11_gzip", lambda df, path: writers.ntriples(df, path, "gzip"), lambda spark, path: readers.read(spark, path, "nt"), "nation")
_round("src15_rows", lambda df, path: df.write.parquet(path), lambda spark, path: graph_of(spark.read.parquet(path)).df, "customer", "nation")
_round("snk1_dataset", lambda df, path: writers.save(Graph(df), path, index=True), lambda spark, path: open_graph(spark, path).df, "customer", "nation")
_round("snk2_ntriples_gzip", lambda df, path: writers.write(df, path, "ntriples", "gzip"), readers.ntriples, "region", "nation")
_round("snk3_append", lambda df, path: [writers.append(df.where(w), path) for w in ("p like '%name'", "p not like '%name'", "p like '%name'")], lambda spark, path: graph_of(spark.read.parquet(path).select("s", "p", "o")).df, "nation")
_page("snk4_fragment_writer", "SELECT 'data' AS part, 25 AS n UNION ALL SELECT 'metadata', 7", lambda spark, sf_dir: writers.fragment_lines(fragments.tpf(mapped(spark, sf_dir, "nation"), TriplePattern(V("s"), f"{BASE}nation#n_name", V("o")))).where("part != 'controls'").groupBy("part").agg(F.count("*").cast("int").alias("n")))
_page("snk6_negotiation", "SELECT 'text/turtle' AS best", lambda spark, sf_dir: spark.createDataFrame([(writers.best_match(["application/n-triples", "text/turtle"], "application/n-triples;q=0.4, text/*;q=0.9, */*;q=0.1"),)], "best string"))


@query("SELECT c_name AS name, c_mktsegment AS segment FROM customer")
def snk7_csv(spark, sf_dir):
    path = _folder(spark)
    writers.csv(sparql(mapped(spark, sf_dir, "customer"), "SELECT ?name ?segment WHERE { ?c cu:c_name ?name ; cu:c_mktsegment ?segment }", PREFIXES), path)
    return spark.read.csv(path, header=True)


@query("SELECT count(*) AS n FROM customer")
def snk8_count(spark, sf_dir):
    return sparql(mapped(spark, sf_dir, "customer"), "SELECT ?c WHERE { ?c cu:c_name ?n }", PREFIXES).agg(F.count("*").alias("n"))


# Functions

FN = "SELECT c_name, c_acctbal, c_mktsegment, c_custkey FROM customer"
ask("fn1_term_parts", "documents", "SELECT ?d (LANG(?t) AS ?l) (STRLEN(STR(?t)) AS ?n) (isLiteral(?t) AS ?lit) WHERE { ?d do:text ?t }", {"d": "str", "l": "str", "n": "int", "lit": "bool"}, "SELECT 'urn:kg:documents/' || doc_id AS d, coalesce(lower(lang), '') AS l, length(text) AS n, TRUE AS lit FROM documents WHERE text IS NOT NULL")
ask("fn3_numeric", "customer", "SELECT ?c (ABS(?b) AS ?a) (ROUND(?b) AS ?r) (FLOOR(?b) AS ?f) (CEIL(?b) AS ?u) (?k + 1 AS ?n) WHERE { ?c cu:c_acctbal ?b ; cu:c_custkey ?k }", {"c": "str", "a": "num", "r": "num", "f": "num", "u": "num", "n": "num"}, f"{CUST}, abs(c_acctbal) AS a, floor(c_acctbal + 0.5) AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS u, CAST(c_custkey + 1 AS DOUBLE) AS n FROM customer")
ask("fn3_strings", "customer", 'SELECT ?c (UCASE(?n) AS ?u) (SUBSTR(?n, 2, 5) AS ?s) (REPLACE(?m, "[AEIOU]", "*") AS ?r) (STRBEFORE(?m, "I") AS ?b) (STRAFTER(?m, "I") AS ?a) (ENCODE_FOR_URI(?m) AS ?e) WHERE { ?c cu:c_name ?n ; cu:c_mktsegment ?m }', {"c": "str", "u": "str", "s": "str", "r": "str", "b": "str", "a": "str", "e": "str"},
    f"{CUST}, upper(c_name) AS u, substr(c_name, 2, 5) AS s, regexp_replace(c_mktsegment, '[AEIOU]', '*', 'g') AS r, CASE WHEN contains(c_mktsegment, 'I') THEN split_part(c_mktsegment, 'I', 1) ELSE '' END AS b, CASE WHEN contains(c_mktsegment, 'I') THEN substr(c_mktsegment, instr(c_mktsegment, 'I') + 1) ELSE '' END AS a, c_mktsegment AS e FROM customer")
ask("fn3_times", "orders", "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?a) WHERE { ?o or:o_orderdate ?d }", {"o": "str", "y": "int", "m": "int", "a": "int"}, "SELECT 'urn:kg:orders/' || o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS a FROM orders")
ask("fn3_conditional", "customer", 'SELECT ?c (IF(?b > 0, "in", "out") AS ?w) (COALESCE(?none, ?m) AS ?x) (DATATYPE(?b) AS ?t) WHERE { ?c cu:c_acctbal ?b ; cu:c_mktsegment ?m }', {"c": "str", "w": "str", "x": "str", "t": "str"}, f"{CUST}, CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS w, c_mktsegment AS x, '{T.DOUBLE}' AS t FROM customer")


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def fn2_escape(spark, sf_dir):
    """Texts with line breaks, quotes and non-ASCII through N-Triples lines and back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    path = _folder(spark)
    writers.ntriples(docs.select(F.concat(F.lit("urn:d:"), F.col("doc_id").cast("string")).alias("s"), F.lit("urn:text").alias("p"), T.plain(F.col("text")).alias("o")), path)
    return readers.ntriples(spark, path).select(F.substr("s", F.lit(7)).cast("bigint").alias("doc_id"), T.lex(F.col("o")).alias("text"))


# Stored graphs: saved by predicate and by object, or as a bucketed table, then asked


def stored(spark: SparkSession, sf_dir: str, *tables: str) -> Graph:
    path = _folder(spark)
    for part in ("by_object", "statistics"):
        delete_at_end(spark, f"{path}_{part}")
    writers.save(mapped(spark, sf_dir, *tables), path, index=True, statistics=True)
    return open_graph(spark, path)


def bucketed(spark: SparkSession, sf_dir: str, *tables: str) -> Graph:
    table = f"kg_{uuid.uuid4().hex}"
    writers.save_table(mapped(spark, sf_dir, *tables), table, 8)
    return open_table(spark, table)


@query(ORACLE_SQL["tp4_object"])
def src3_object_index(spark, sf_dir):
    """An object without a predicate, read from the copy by object alone."""
    return split_object(stored(spark, sf_dir, "customer", "nation").match(o="urn:kg:nation/3"))


@query(ORACLE_SQL["tp6_po"])
def tp6_stored(spark, sf_dir):
    return split_object(stored(spark, sf_dir, "customer", "nation").match(p="urn:kg:customer#c_mktsegment", o='"BUILDING"'))


@query(STAR_SQL)
def st1_stored(spark, sf_dir):
    return _star_out(joins.match_star(stored(spark, sf_dir, "customer"), STAR))


@query(STAR_SQL)
def st1_bucketed(spark, sf_dir):
    return _star_out(joins.match_star(bucketed(spark, sf_dir, "customer"), STAR))


@query(ORACLE_SQL["st5_star_values"])
def st5_stored(spark, sf_dir):
    graph = stored(spark, sf_dir, "customer")
    values = joins.bindings(graph, ["c_mktsegment"], [('"BUILDING"',), ('"MACHINERY"',)])
    return _star_out(joins.with_bindings(joins.match_star(graph, STAR), values, 2))


for _m, _method_name in (("bj1_stored", "brtpf"), ("bj2_stored", "tpf"), ("bj3_stored", "spf")):

    def _stored_method(spark, sf_dir, method=_method_name):
        found = joins.evaluate(stored(spark, sf_dir, "orders", "customer", "nation"), OCN, method)
        return found.select(F.col(var("o")).alias("o"), F.col(var("c")).alias("c"), T.lex(F.col(var("name"))).alias("name"))

    QUERIES[_m] = _stored_method
    ORACLE_SQL[_m] = OCN_SQL


@query(ORACLE_SQL["al1_bgp"])
def al1_stored(spark, sf_dir):
    text = 'SELECT ?name ?seg ?nation WHERE { ?c cu:c_name ?name ; cu:c_mktsegment ?seg ; cu:c_nationkey ?n . ?n na:n_name ?nation ; na:n_regionkey ?r . ?r re:r_name "ASIA" }'
    return typed(sparql(stored(spark, sf_dir, "customer", "nation", "region"), text, PREFIXES), name="str", seg="str", nation="str")


@query(ORACLE_SQL["al9_seq"])
def al9_stored(spark, sf_dir):
    return typed(sparql(stored(spark, sf_dir, "customer", "nation", "region"), "SELECT ?c ?r WHERE { ?c cu:c_nationkey/na:n_regionkey/re:r_name ?r }", PREFIXES), c="str", r="str")


# Sources and catalogs


@query(f"SELECT * FROM ({unpivot('nation')})")
def src1_in_memory(spark, sf_dir):
    path = _folder(spark)
    writers.save(mapped(spark, sf_dir, "nation"), path)
    return split_object(open_graph(spark, path, cache=True).df)


def _file(spark: SparkSession, content: bytes, name: str) -> str:
    """A single file in the shared folder, written by Spark."""
    path = f"{_folder(spark)}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(content))
    out.close()
    return path


def _nt(spark: SparkSession, sf_dir: str, table: str) -> str:
    """The N-Triples of a small table."""
    return "".join(r.value + "\n" for r in writers.lines(mapped(spark, sf_dir, table).df).collect())


@query("SELECT 'urn:kg:region/' || r_regionkey AS s, 'urn:kg:v#name' AS p, r_name AS o FROM region")
def src7_rdfxml(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/region.parquet").collect()
    body = "".join(f'<rdf:Description rdf:about="urn:kg:region/{r.r_regionkey}"><v:name>{r.r_name}</v:name></rdf:Description>' for r in names)
    text = f'<rdf:RDF xmlns:rdf="{T.RDF}" xmlns:v="urn:kg:v#">{body}</rdf:RDF>'
    return _lexed(readers.read(spark, _file(spark, text.encode(), "x.rdf")))


@query(f"SELECT * FROM ({unpivot('nation', 'region', types=True)}) WHERE p NOT LIKE '%hasNation'")
def src9_file_list(spark, sf_dir):
    paths = [_file(spark, _nt(spark, sf_dir, t).encode(), f"{t}.nt") for t in ("nation", "region")]
    return split_object(readers.read(spark, _file(spark, "\n".join(paths).encode(), "all.list")))


@query(f"SELECT * FROM ({unpivot('nation')}) UNION ALL SELECT * FROM ({unpivot('region')})")
def src10_archives(spark, sf_dir):
    one, two = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(one, "w") as z:
        z.writestr("nation.nt", _nt(spark, sf_dir, "nation"))
    with tarfile.open(fileobj=two, mode="w:gz") as t:
        info = tarfile.TarInfo("region.nt")
        content = _nt(spark, sf_dir, "region").encode()
        info.size = len(content)
        t.addfile(info, io.BytesIO(content))
    return split_object(readers.read(spark, _file(spark, one.getvalue(), "a.zip")).unionByName(readers.read(spark, _file(spark, two.getvalue(), "b.tgz"))))


@query("SELECT * FROM (VALUES ('a.ttl.gz', 'turtle'), ('b.NT', 'ntriples'), ('', 'ntriples'), ('c.owl', 'rdfxml'), ('d.nq.bz2', 'nquads'), ('e.doc', CAST(NULL AS VARCHAR))) t(name, format)")
def src12_format_guess(spark, sf_dir):
    def guess(name: str) -> str | None:
        try:
            return readers.guess_format(name)
        except readers.UnknownFormat:
            return None

    return spark.createDataFrame([(n, guess(n)) for n in ("a.ttl.gz", "b.NT", "", "c.owl", "d.nq.bz2", "e.doc")], "name string, format string")


@query(f"SELECT * FROM ({unpivot('nation')})")
def src13_directory(spark, sf_dir):
    """A folder of files, a repeated triple among them, as one graph."""
    path = _folder(spark)
    writers.ntriples(mapped(spark, sf_dir, "nation").df.repartition(3), path)
    writers.ntriples(mapped(spark, sf_dir, "nation").df.limit(5), path, mode="append")
    return split_object(graph_of(readers.read(spark, path, "nt")).df)


@query(f"SELECT * FROM ({unpivot('region')})")
def src14_import(spark, sf_dir):
    """Lines to a saved dataset in one job, and through a dictionary of the terms first."""
    path, target = _folder(spark), _folder(spark)
    writers.ntriples(mapped(spark, sf_dir, "region").df, path)
    graph = graph_of(readers.ntriples(spark, path))
    writers.save(graph, target)
    own = dictionary.Dictionary.build(open_graph(spark, target))
    return split_object(own.decode(own.encode(graph.df)))


CONFIG = {"title": "t", "baseURL": "http://x", "datasourcetypes": {"kept": "dataset"}, "prefixes": {"kg": BASE}}


def _catalog(spark: SparkSession, sf_dir: str) -> catalog.Catalog:
    path = _folder(spark)
    writers.save(mapped(spark, sf_dir, "region"), path)
    sources = {
        "regions": {"title": "Regions", "type": "kept", "description": "d", "settings": {"file": path, "keepInMemory": True}},
        "nations": {"title": "Nations", "type": "tables", "settings": {"path": sf_dir, "tables": ["nation"]}},
    }
    return catalog.Catalog.from_json(spark, json.dumps(CONFIG | {"datasources": sources}))


@query(f"SELECT * FROM ({unpivot('region')})")
def src17_assembler(spark, sf_dir):
    return split_object(_catalog(spark, sf_dir).graph("regions").df)


@query("SELECT * FROM (VALUES ('nations', 'Nations', 'http://x/nations'), ('regions', 'Regions', 'http://x/regions')) t(name, title, url)")
def src18_catalog(spark, sf_dir):
    return _catalog(spark, sf_dir).index().select("name", "title", "url")


@query("SELECT 'urn:a' AS s, 'urn:p' AS p, 'b' AS o UNION ALL SELECT 'urn:b', 'urn:p', 'c'")
def src21_rows(spark, sf_dir):
    return _lexed(graph_of_rows(spark, [("urn:a", "urn:p", '"b"'), ("urn:b", "urn:p", '"c"'), ("urn:a", "urn:p", '"b"')]).df)


@query("SELECT r_name AS name FROM region")
def src22_registered_type(spark, sf_dir):
    """A type of datasource of one's own, registered by name."""
    known = {"small": lambda spark, settings: mapped(spark, settings["at"], "region")}
    text = json.dumps({"datasourcetypes": {"mine": "small"}, "datasources": {"r": {"type": "mine", "settings": {"at": sf_dir}}}})
    return typed(sparql(catalog.Catalog.from_json(spark, text, known).graph("r"), "SELECT ?name WHERE { ?r re:r_name ?name }", PREFIXES), name="str")


@query("SELECT count(*) AS total, 101 AS start, least(200, count(*)) AS \"end\", 1 AS previous, CASE WHEN count(*) > 200 THEN 3 END AS next FROM customer")
def snk5_page_fields(spark, sf_dir):
    fields = writers.html_fields(_fragment(spark, sf_dir, 2))
    return spark.createDataFrame([tuple(fields.values())], "total long, start int, `end` long, previous int, next int").select("total", "start", "end", "previous", "next")


@query("SELECT * FROM (VALUES ('error', 500, ''), ('index', 200, 'nations regions'), ('notfound', 404, 'nations regions')) t(page, status, datasets)")
def snk10_pages(spark, sf_dir):
    own = _catalog(spark, sf_dir)
    pages = {"index": writers.page_fields("index", list(own.sources))}
    try:
        own.graph("nowhere")
    except catalog.DataSourceNotFound as missing:
        pages["notfound"] = writers.page_fields("notfound", list(own.sources), str(missing))
    pages["error"] = writers.page_fields("error", problem="wrong")
    return spark.createDataFrame([(k, v["status"], " ".join(v["datasets"])) for k, v in pages.items()], "page string, status int, datasets string")


# Dictionary lookups, small functions, metrics


@query("SELECT * FROM (VALUES ('urn:kg:region/1', 's', TRUE), ('urn:none', 's', FALSE), ('', 'o', FALSE)) t(term, role, found) ")
def di3_locate(spark, sf_dir):
    """Terms to numbers and back: a term that is there comes back as itself."""
    own = dictionary.Dictionary.build(mapped(spark, sf_dir, "region", "nation"))
    rows = [(t, r, (i := own.id_of(t, r)) > 0 and own.term_of(i, r) == t) for t, r in (("urn:kg:region/1", "s"), ("urn:none", "s"), ("", "o"))]
    return spark.createDataFrame(rows, "term string, role string, found boolean")


ask("fn4_is_iri", "nation", "SELECT ?o (isIRI(?o) AS ?iri) (isLiteral(?o) AS ?lit) (isBlank(?o) AS ?blank) WHERE { ?n ?p ?o }", {"o": "str", "iri": "bool", "lit": "bool", "blank": "bool"}, f"SELECT o, o LIKE 'urn:%' AS iri, o NOT LIKE 'urn:%' AS lit, FALSE AS blank FROM ({unpivot('nation')})")
ask("fn_datatypes", "customer", "SELECT ?m (SUM(?k) AS ?t) (DATATYPE(SUM(?k)) AS ?dt) (DATATYPE(AVG(?k)) AS ?da) (DATATYPE(SUM(?b)) AS ?db) (SUM(?k + 9007199254740993) AS ?big) WHERE { ?c cu:c_mktsegment ?m ; cu:c_custkey ?k ; cu:c_acctbal ?b } GROUP BY ?m", {"m": "str", "t": "str", "dt": "str", "da": "str", "db": "str", "big": "str"},
    f"SELECT c_mktsegment AS m, CAST(sum(c_custkey) AS VARCHAR) AS t, '{T.INTEGER}' AS dt, '{T.DECIMAL}' AS da, '{T.DOUBLE}' AS db, CAST(sum(CAST(c_custkey AS HUGEINT) + 9007199254740993) AS VARCHAR) AS big FROM customer GROUP BY c_mktsegment")
ask("fn_arithmetic_types", "nation", "SELECT ?k (?k + 1 AS ?a) (?k * 2.5 AS ?b) (?k / 2 AS ?c) (-?k AS ?d) (DATATYPE(?k + 1) AS ?ta) (DATATYPE(?k * 2.5) AS ?tb) (DATATYPE(?k / 2) AS ?tc) WHERE { ?n na:n_nationkey ?k }", {"k": "int", "a": "str", "b": "num", "c": "num", "d": "str", "ta": "str", "tb": "str", "tc": "str"},
    f"SELECT n_nationkey AS k, CAST(n_nationkey + 1 AS VARCHAR) AS a, n_nationkey * 2.5::DOUBLE AS b, n_nationkey / 2.0::DOUBLE AS c, CAST(-n_nationkey AS VARCHAR) AS d, '{T.INTEGER}' AS ta, '{T.DECIMAL}' AS tb, '{T.DECIMAL}' AS tc FROM nation")
ask("al8_empty_groups", "customer", "SELECT (SUM(?b) AS ?t) (AVG(?b) AS ?a) (COUNT(?b) AS ?n) (SUM(?m) AS ?wrong) WHERE { ?c cu:c_acctbal ?b ; cu:c_mktsegment ?m FILTER(?b > 1e9) }", {"t": "num", "a": "num", "n": "int", "wrong": "num"}, "SELECT 0.0 AS t, 0.0 AS a, 0 AS n, 0.0 AS wrong")
ask("al8_sum_error", "customer", "SELECT ?n (SUM(?m) AS ?wrong) (COUNT(?m) AS ?k) WHERE { ?c cu:c_mktsegment ?m ; cu:c_nationkey ?n } GROUP BY ?n", {"n": "str", "wrong": "num", "k": "int"}, "SELECT 'urn:kg:nation/' || c_nationkey AS n, CAST(NULL AS DOUBLE) AS wrong, count(*) AS k FROM customer GROUP BY c_nationkey")
ask("al5_exists_inside", "customer orders", 'SELECT ?c (EXISTS { ?o or:o_custkey ?c } AS ?has) WHERE { ?c cu:c_mktsegment ?m FILTER(?m = "BUILDING" || NOT EXISTS { ?o or:o_custkey ?c }) }', {"c": "str", "has": "bool"}, f"{CUST}, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey NOT IN (SELECT o_custkey FROM orders)")
ask("al7_distinct_order", "customer", "SELECT DISTINCT ?m WHERE { ?c cu:c_mktsegment ?m ; cu:c_acctbal ?b } ORDER BY DESC(?b) LIMIT 2", {"m": "str"}, "SELECT c_mktsegment AS m FROM customer GROUP BY c_mktsegment ORDER BY max(c_acctbal) DESC LIMIT 2")


@query("SELECT 'urn:g:' || n_regionkey AS g, 'urn:kg:nation/' || n_nationkey AS s, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name FROM nation WHERE n_nationkey <> 3")
def al12_graph_variable(spark, sf_dir):
    """GRAPH ?g around an OPTIONAL and a FILTER."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    g, s = F.concat(F.lit("urn:g:"), "n_regionkey"), F.concat(F.lit("urn:kg:nation/"), "n_nationkey")
    there = nations.select(s.alias("s"), F.lit("urn:in").alias("p"), T.of_column(F.col("n_nationkey"), "int").alias("o"), g.alias("g"))
    names = nations.where("n_nationkey % 2 = 0").select(s.alias("s"), F.lit("urn:name").alias("p"), T.plain(F.col("n_name")).alias("o"), g.alias("g"))
    out = sparql(Graph(there.unionByName(names)), "SELECT ?g ?s ?name WHERE { GRAPH ?g { ?s <urn:in> ?k OPTIONAL { ?s <urn:name> ?name } FILTER(?k != 3) } }")
    return typed(out, g="str", s="str", name="str")


@query("SELECT c_custkey AS k, length(c_name) AS same, 9 AS other FROM customer")
def fn7_common_prefix(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("k"), T.common_prefix(F.col("c_name"), F.col("c_name")).alias("same"), T.common_prefix(F.col("c_name"), F.lit("Customer#x")).alias("other"))


@query("SELECT CAST(3421780262 AS BIGINT) AS crc32, CAST(47933 AS BIGINT) AS crc16, CAST(244 AS BIGINT) AS crc8")
def fn8_checksums(spark, sf_dir):
    """The check values that the three codes are published with, of the digits 1 to 9."""
    one = spark.createDataFrame([("123456789",)], "t string")
    return one.select(*(T.crc(F.col("t"), n).cast("bigint").alias(f"crc{n}") for n in (32, 16, 8)))


@query("SELECT count(*) AS pairs, count(DISTINCT (c_mktsegment, c_nationkey)) AS keys FROM customer")
def fn6_binding_key(spark, sf_dir):
    out = sparql(mapped(spark, sf_dir, "customer"), "SELECT ?m ?n WHERE { ?c cu:c_mktsegment ?m ; cu:c_nationkey ?n }", PREFIXES)
    return out.agg(F.count("*").alias("pairs"), F.count_distinct(T.binding_key(F.col("m"), F.col("n"))).alias("keys"))


@query(f"WITH r AS ({OCN_SQL}), s AS ({STAR_SQL}) SELECT * FROM (SELECT 'chain' AS query, 'tpf' AS method, 4 AS requests, count(*) AS bindings FROM r UNION ALL SELECT 'star', 'tpf', 3, (SELECT count(*) FROM s) UNION ALL SELECT 'chain', 'spf', 3, (SELECT count(*) FROM r) UNION ALL SELECT 'star', 'spf', 1, (SELECT count(*) FROM s))")
def ag9_metrics(spark, sf_dir):
    graph, workload = mapped(spark, sf_dir, "orders", "customer", "nation"), {"chain": OCN, "star": list(STAR.patterns)}
    parts = [metrics.experiment(graph, workload, m).select("query", F.lit(m).alias("method"), F.col("requests").cast("int").alias("requests"), "bindings") for m in ("tpf", "spf")]
    return parts[0].unionByName(parts[1])


@query("SELECT -1 AS requests, -1 AS bindings")
def it11_timeout(spark, sf_dir):
    """A query that is stopped after its time counts as -1 throughout."""
    slow = spark.range(10**15).agg(F.sum(F.sin("id")).alias("x"))
    late = metrics.measure("slow", slow, 1, 0.5)
    return spark.createDataFrame([(late.requests, late.bindings)], "requests int, bindings int")
