"""The hand-checked graph of 17 triples, and what must hold on it."""

import random
from itertools import product

import pytest

from triplespark.functions import terms as T
from triplespark.functions.terms import Variable as V
from triplespark.operators import joins, stats
from triplespark.plans.compiler import sparql
from triplespark.plans.graph import Graph, graph_of_rows, name_of, var
from triplespark.plans.patterns import StarPattern, TriplePattern, shape, stars
from triplespark.plans.planner import order
from triplespark.plans.sparql import SyntaxProblem, parse_turtle

EX = "http://example.org/"
TINY = """
@prefix ex: <http://example.org/> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
ex:a ex:predicate1 "v1" ; ex:predicate2 ex:b ; ex:predicate3 "3"^^xsd:integer ; ex:predicate13 ex:b , ex:c .
ex:b ex:predicate1 "v1"@en ; ex:predicate2 ex:c ; ex:predicate3 "4.5"^^xsd:double ; ex:predicate13 ex:c .
ex:c ex:predicate1 "v2" , "v3" ; ex:predicate2 ex:a ; ex:loves ex:c .
ex:d ex:predicate1 "line1\\nline2; with, sep [x] \\"q\\"" ; rdf:type ex:T .
_:b0 ex:predicate2 ex:a .
ex:predicate1 rdf:type rdf:Property .
"""
PREFIXES = {"ex": EX, "rdf": T.RDF, "xsd": T.XSD}


@pytest.fixture(scope="module")
def tiny(spark):
    g = graph_of_rows(spark, parse_turtle(TINY))
    return Graph(g.df.cache())


def rows(graph, text):
    df = sparql(graph, text, PREFIXES)
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_counts(tiny):
    v = stats.void(tiny).first()
    assert (v.triples, v.subjects, v.predicates, v.objects, v.shared) == (17, 6, 6, 12, 3)


@pytest.mark.parametrize(
    ("s", "p", "o", "n"),
    [(None, None, None, 17), ("a", None, None, 5), (None, "predicate1", None, 5), (None, "predicate13", None, 3), (None, None, "a", 2), ("a", "predicate13", None, 2), (None, "predicate13", "c", 2), ("a", None, "b", 2), ("a", "predicate2", "b", 1), (None, "none", None, 0)],
)
def test_scans(tiny, s, p, o, n):
    assert tiny.match(*(x and EX + x for x in (s, p, o))).count() == n


@pytest.mark.parametrize(
    ("where", "n"),
    [
        ("?x ex:loves ?x", 1),
        ("?s ex:predicate13 ?x ; ex:predicate13 ?y", 5),
        ("?s ex:predicate1 ?x ; ex:predicate2 ?y ; ex:predicate3 ?z", 2),
        ("?s ex:predicate1 ?x ; ex:predicate2 ?y", 4),
        ("?a ?p ?b . ?b ?q ?c", 34),
        ("?a ?p ?b . ?b ?q ?c . ?c ?r ?d", 76),
        ("?a ?p ?o . ?b ?p ?o . ?c ?p ?o", 29),
        ("?s ex:predicate3 ?n FILTER(?n > 3)", 1),
        ("?s ex:predicate3 ?n FILTER(?n = 3.0)", 1),
        ("?s ex:predicate2 ?o OPTIONAL { ?s ex:predicate3 ?n FILTER(?n > 4) }", 4),
        ("?s ex:predicate2 ?o OPTIONAL { ?s ex:predicate3 ?n } OPTIONAL { ?o ex:predicate3 ?n }", 4),
        ("{ ?s ex:loves ?o } UNION { ?s ex:predicate3 ?n }", 3),
        ("?s ex:predicate2 ?o MINUS { ?s ex:predicate3 ?n }", 2),
        ("?s ex:predicate2 ?o MINUS { ?x ex:predicate3 ?n }", 4),
        ("?s ex:predicate2 ?o FILTER EXISTS { ?s ex:predicate3 ?n FILTER(?o != ex:c) }", 1),
        ("?s ex:predicate2 ?o FILTER NOT EXISTS { ?s ex:predicate3 ?n }", 2),
        ("VALUES (?s ?v) { (ex:a \"v1\") (ex:b UNDEF) } ?s ex:predicate1 ?v", 2),
        ("?s ex:predicate1 ?v BIND(CONCAT(STR(?v), \"!\") AS ?w) FILTER(?w = \"v2!\")", 1),
        ("ex:a ex:predicate2+ ?x", 3),
        ("ex:a ex:predicate2* ?x", 3),
        ("?x ex:predicate2+ ex:a", 4),
        ("ex:a ex:predicate2/ex:predicate2 ?x", 1),
        ("ex:a (ex:predicate2|ex:predicate13) ?x", 3),
        ("ex:a ^ex:predicate2 ?x", 2),
        ("ex:a ex:predicate2? ?x", 2),
        ("ex:a !(ex:predicate2|ex:predicate1) ?x", 3),
        ("ex:nowhere ex:predicate2* ?x", 1),
        ("?s ex:predicate1 ?v FILTER(LANG(?v) = \"en\")", 1),
        ("?s ex:predicate1 ?v FILTER(REGEX(?v, \"LINE2\", \"i\"))", 1),
        ("?s ?p ?o FILTER(isBlank(?s) || isNumeric(?o))", 3),
        ("?X ex:predicate2 ?x", 4),
    ],
)
def test_patterns(tiny, where, n):
    assert len(rows(tiny, f"SELECT * WHERE {{ {where} }}")) == n


def test_unbound_variable_of_an_optional_meets_every_value(tiny):
    """A second OPTIONAL beside the first binds what that left open; inside it, it only adds to what that found."""
    a, b, c, d = (EX + x for x in "abcd")
    first, second = "?s ex:predicate1 ?v OPTIONAL { ?s ex:loves ?o", "OPTIONAL { ?o ex:predicate3 ?n }"
    beside = rows(tiny, f"SELECT DISTINCT ?s ?o WHERE {{ {first} }} {second} FILTER(BOUND(?o)) }}")
    assert beside == sorted([(c, c), *product((a, b, d), (a, b))])
    assert rows(tiny, f"SELECT DISTINCT ?s ?o WHERE {{ {first} {second} }} FILTER(BOUND(?o)) }}") == [(c, c)]


def test_query_forms(tiny):
    assert rows(tiny, "ASK { ex:a ex:predicate2 ex:b }") == [(True,)]
    assert rows(tiny, "ASK { ex:a ex:predicate2 ex:a }") == [(False,)]
    assert rows(tiny, "CONSTRUCT { ?o ex:back ?s } WHERE { ?s ex:predicate2 ?o }") == sorted([(EX + "b", EX + "back", EX + "a"), (EX + "c", EX + "back", EX + "b"), (EX + "a", EX + "back", EX + "c"), (EX + "a", EX + "back", next(s for s, p, o in parse_turtle(TINY) if s[0] == "_"))], key=str)
    assert len(rows(tiny, "DESCRIBE ex:c")) == 4
    assert len(rows(tiny, "DESCRIBE ?s WHERE { ?s ex:predicate3 ?n }")) == 9
    assert rows(tiny, "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p HAVING(COUNT(*) > 3) ORDER BY DESC(?n) LIMIT 1") == [(EX + "predicate1", T.literal(5))]
    assert rows(tiny, "SELECT (SUM(?n) AS ?t) (AVG(?n) AS ?a) (MIN(?n) AS ?l) WHERE { ?s ex:predicate3 ?n }") == [('"7.5"^^<%s>' % T.DOUBLE, '"3.75"^^<%s>' % T.DOUBLE, T.literal(3))]
    assert rows(tiny, "SELECT DISTINCT ?s WHERE { ?s ex:predicate13 ?o }") == [(EX + "a",), (EX + "b",)]
    assert rows(tiny, "SELECT ?s WHERE { ?s ex:predicate2 ?o } ORDER BY ?s OFFSET 1 LIMIT 2") == [(EX + "a",), (EX + "b",)]
    assert rows(tiny, "SELECT ?s WHERE { { SELECT ?s WHERE { ?s ex:predicate3 ?n } ORDER BY DESC(?n) LIMIT 1 } }") == [(EX + "b",)]
    with pytest.raises(SyntaxProblem):
        sparql(tiny, "SELECT ?s WHERE { ?s ?p }")


def test_fragment_form_collapses_permutations(tiny):
    star = StarPattern(V("s"), ((EX + "predicate13", V("x")), (EX + "predicate13", V("y"))))
    assert joins.distinct_stars(tiny, star).count() == 4


def test_characteristic_sets(tiny):
    p = lambda *ns: tuple(sorted(EX + n if n != "type" else T.TYPE for n in ns))
    got = {tuple(r.predicates): r.subjects for r in stats.characteristic_sets(tiny).collect()}
    assert got == {p("predicate1", "predicate2", "predicate3", "predicate13"): 2, p("loves", "predicate1", "predicate2"): 1, p("predicate1", "type"): 1, p("predicate2"): 1, p("type"): 1}


def brute(triples, patterns):
    out = [{}]
    for t in patterns:
        out = [m for b in out for r in triples if (m := extend(b, t, r)) is not None]
    return out


def extend(b, t, r):
    b = dict(b)
    for x, v in zip((t.s, t.p, t.o), r, strict=True):
        if isinstance(x, V):
            if b.setdefault(x.name, v) != v:
                return None
        elif x != v:
            return None
    return b


@pytest.mark.parametrize("seed", range(5))
def test_methods_agree_with_brute_force(spark, seed):
    r = random.Random(seed)
    terms = [f"urn:{c}" for c in "abcd"]
    triples = sorted({tuple(r.choice(terms) for _ in range(3)) for _ in range(25)})
    graph = graph_of_rows(spark, triples)
    at = lambda names: V(r.choice(names)) if r.random() < 0.7 else r.choice(terms)
    patterns = [TriplePattern(at("xyz"), at("pq") if r.random() < 0.3 else r.choice(terms), at("xyz")) for _ in range(3)]
    names = sorted({v for t in patterns for v in t.variables})
    want = sorted(tuple(b[n] for n in names) for b in brute(triples, patterns))
    for method, turned in product(("tpf", "brtpf", "spf", "endpoint"), (patterns, patterns[::-1])):
        got = joins.evaluate(graph, turned, method)
        assert sorted(tuple(x) for x in got.select(*map(var, names)).collect()) == want if names else got.count() == len(want)
    for star in stars(patterns):
        a, b = joins.star_by_joins(graph, star), joins.star_by_groups(graph, star)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_shapes_and_orders():
    x, y, z = V("x"), V("y"), V("z")
    assert shape([TriplePattern(x, "p", y), TriplePattern(y, "p", z)]) == "2_stars"
    assert shape([TriplePattern(V(c), "p", x) for c in "abcd"]) == "paths"
    assert shape([TriplePattern(V(c), "p", x) for c in "abcda"]) is None
    assert shape([TriplePattern(x, "p", y), TriplePattern(x, "q", z)]) == "1_stars"
    assert [t.p for t in order([TriplePattern(x, V("p"), y), TriplePattern(y, "q", "o"), TriplePattern(x, "r", y)])] == ["q", "r", V("p")]
    assert TriplePattern(x, "p", x).contains(TriplePattern("a", "p", "a")) and not TriplePattern(x, "p", x).contains(TriplePattern("a", "p", "b"))
    assert name_of(var("Ünï")) == "Ünï"


def test_terms():
    for t in ("http://a/b", "_:x", '"a\nb"', '"a"@en', f'"1"^^<{T.INTEGER}>', '"say "hi""'):
        assert str(T.term(t)) == t
    assert T.unescape(T.escape("a\t\"\\é😀\n")) == "a\t\"\\é😀\n" and "\\U0001F600" in T.escape("😀")
    with pytest.raises(ValueError):
        T.unescape("\\x")
    assert [str(T.parse_term(t)) for t in ("?a", "_:b", "<u:x>", '"v"@EN', "u:x", '"v')] == ["?a", "?_:b", "u:x", '"v"@en', "u:x", T.INVALID]
