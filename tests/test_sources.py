"""Files in and out: formats, archives, odd lines; fragments' edges; the catalog; streams."""

import json
import lzma
import tarfile
import zipfile

import pytest

from tests.test_graph import EX, TINY
from triplespark.functions import terms as T
from triplespark.functions.terms import Variable as V
from triplespark.operators import fragments
from triplespark.operators.setops import within
from triplespark.plans.graph import Graph, graph_of, graph_of_rows, open_graph
from triplespark.plans.patterns import StarPattern, TriplePattern
from triplespark.plans.sparql import parse_turtle
from triplespark.sources import catalog, readers, writers
from triplespark.streaming import scan, triples


def rows(df):
    return sorted(map(tuple, df.collect()))


def shapes(found):
    """Triples with blank nodes told apart by nothing."""
    return sorted(tuple("_" if x.startswith("_:") else x for x in r) for r in found)


def test_guess():
    assert [readers.guess_format(n) for n in ("", "a.nt", "a.NT.gz", "x/b.ttl.bz2", "c.rdf", "d.nq.xz", "e.tgz")] == ["ntriples", "ntriples", "ntriples", "turtle", "rdfxml", "nquads", "tar"]
    with pytest.raises(readers.UnknownFormat):
        readers.guess_format("a.docx")


def test_ntriples_lines(spark, tmp_path):
    lines = ['<urn:s> <urn:p> "a\\tb \\"q\\" \\u00e9 \\U0001F600 \\\\n"@EN .', "# comment", "", "<urn:s> <urn:p> .", "_:b <urn:p> <urn:o> . # end", '<urn:s>\t<urn:p>\t"1"^^<http://www.w3.org/2001/XMLSchema#string> .', '<urn:s> <urn:p> "bad \\x" .']
    (tmp_path / "a.nt").write_text("\n".join(lines))
    want = sorted([("urn:s", "urn:p", '"a\tb "q" é 😀 \\n"@en'), ("_:b", "urn:p", "urn:o"), ("urn:s", "urn:p", '"1"')])
    assert rows(readers.read(spark, str(tmp_path / "a.nt"))) == want
    (tmp_path / "a.nt.xz").write_bytes(lzma.compress("\n".join(lines).encode()))
    assert rows(readers.read(spark, str(tmp_path / "a.nt.xz"))) == want
    found, bad = readers.simple(spark, str(tmp_path / "a.nt"))
    assert rows(found) == want and bad.count() == 2


def test_archives_lists_and_documents(spark, tmp_path):
    want = shapes(parse_turtle(TINY))
    (tmp_path / "a.ttl").write_text(TINY)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(tmp_path / "a.ttl", "in/a.ttl")
        z.writestr("note.docx", "no")
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as t:
        t.add(tmp_path / "a.zip", "b.zip")
    (tmp_path / "all.list").write_text(f"{tmp_path}/a.ttl\n")
    for name in ("a.ttl", "a.zip", "a.tgz", "all.list"):
        assert shapes(rows(readers.read(spark, str(tmp_path / name)))) == want


def test_rdfxml():
    text = f"""<rdf:RDF xmlns:rdf="{T.RDF}" xmlns:ex="{EX}" xml:base="http://b/">
    <ex:Thing rdf:about="x" ex:name="n" xml:lang="en"><ex:p rdf:resource="y"/><ex:q rdf:datatype="{T.INTEGER}">3</ex:q>
    <ex:r><rdf:Description rdf:ID="z"/></ex:r><ex:s rdf:parseType="Resource"><ex:t>deep</ex:t></ex:s></ex:Thing></rdf:RDF>"""
    assert shapes(readers.parse_rdfxml(text)) == sorted(
        [("http://b/x", T.TYPE, EX + "Thing"), ("http://b/x", EX + "name", '"n"@en'), ("http://b/x", EX + "p", "http://b/y"), ("http://b/x", EX + "q", T.literal(3)), ("http://b/x", EX + "r", "http://b/#z"), ("http://b/x", EX + "s", "_"), ("_", EX + "t", '"deep"@en')]
    )


def test_turtle_grammar():
    text = '@base <http://b/> . @prefix : <#> . <a> a :C ; :p 1, 2.5, 1e3, true, """l"o\nng""", [ :q ( :x "y"@EN ) ] ; . [] :p -4 .'
    found = shapes(parse_turtle(text))
    assert len(found) == 13 and ("http://b/a", "http://b/#p", f'"2.5"^^<{T.DECIMAL}>') in found and ("_", "http://b/#p", T.literal(-4)) in found


def test_saved_datasets(spark, tmp_path):
    g = graph_of_rows(spark, parse_turtle(TINY))
    writers.save(g, str(tmp_path / "d"), index=True)
    assert rows(open_graph(spark, str(tmp_path / "d")).df) == rows(g.df)
    found = open_graph(spark, str(tmp_path / "d")).match(p=EX + "predicate1")
    assert found.count() == 5 and "PartitionFilters: [isnotnull(p" in found._jdf.queryExecution().toString()
    writers.append(g.df, str(tmp_path / "d"))
    writers.compact(spark, str(tmp_path / "d"), str(tmp_path / "e"))
    assert rows(open_graph(spark, str(tmp_path / "e")).df) == rows(g.df)
    writers.save_table(g, "tiny_triples", 2)
    try:
        assert rows(graph_of(spark.table("tiny_triples")).df.select("s", "p", "o")) == rows(g.df)
    finally:
        spark.sql("drop table tiny_triples")


def test_fragment_pages(spark):
    t = TriplePattern(V("s"), "urn:p", V("o"))
    for n, pages in ((99, 1), (100, 1), (101, 2), (0, 0)):
        g = graph_of_rows(spark, [("urn:s", "urn:p", T.literal(i)) for i in range(n)]) if n else Graph(spark.createDataFrame([], "s string, p string, o string"))
        f = fragments.tpf(g, t)
        assert (f.total, f.last, f.data.count()) == (n, pages < 2, min(n, 100))
        assert fragments.tpf(g, t, 3).data.count() == 0
    assert [fragments.page_number(x) for x in (None, "", "x", "0", "-3", "7")] == [1, 1, 1, 1, 1, 7]


def test_restricted_patterns(spark):
    g = graph_of_rows(spark, [("urn:a", "urn:p", "urn:b"), ("urn:c", "urn:p", "urn:d")])
    t = TriplePattern(V("s"), V("p"), V("o"))
    count = lambda names, values: fragments.restrict(g, t, names, values).count()
    assert count(["s"], []) == 0 and count(["s"], [("urn:a",)]) == 1 and count(["s"], [(None,)]) == 2
    assert count(["p", "x"], [("urn:p", "1"), ("urn:p", "2")]) == 2 and count(["s", "o"], [("urn:a", None), (None, "urn:d")]) == 2
    star = StarPattern(V("s"), (("urn:p", V("o")),))
    assert fragments.spf(g, star, ["o"], [("urn:b",), (None,)]).total == 2


def test_requests():
    star = StarPattern(V("s"), (("urn:p", '"a, b; [c]"@en'), ("urn:q", V("o"))))
    r = fragments.Request("spf", "d", 2, None, star, ("o",), (("urn:1",), (None,)))
    assert fragments.from_url(fragments.to_url(r, "http://h")) == r
    assert fragments.from_url("/d?subject=%22x").pattern.s == T.INVALID
    assert writers.best_match(["a/b", "text/turtle"], "text/*;q=0.5,*/*;q=0.1") == "text/turtle" and writers.best_match(["a/b"], "x/y") == ""


def test_catalog(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TINY)
    config = {"baseURL": "http://h", "datasourcetypes": {"Mine": "rdf"}, "datasources": {"t": {"title": "Tiny", "type": "Mine", "settings": {"file": str(tmp_path / "a.ttl")}}}}
    c = catalog.Catalog.from_json(spark, json.dumps(config))
    assert len(c.graph("t")) == 17 and c.index().first().url == "http://h/t"
    with pytest.raises(catalog.DataSourceNotFound):
        c.graph("none")
    with pytest.raises(catalog.DuplicateDataSourceType):
        c.register("Mine", None)
    with pytest.raises(catalog.UnknownDataSourceType):
        catalog.Catalog.from_json(spark, '{"datasourcetypes": {"X": "none"}}')


def test_stream(spark, tmp_path):
    graph_of_rows(spark, parse_turtle(TINY)).df.write.parquet(str(tmp_path / "in"))
    q = scan(triples(spark, str(tmp_path / "in")), TriplePattern(V("s"), EX + "predicate13", V("o"))).writeStream.format("memory").queryName("arrived").start()
    try:
        q.processAllAvailable()
        assert spark.table("arrived").count() == 3
    finally:
        q.stop()


def test_within(spark):
    assert within(spark, 60, lambda: spark.range(10).count()) == 10
