import duckdb

from tests.llm.conftest import SF
from triplespark.llm import queries
from triplespark.llm import url_filter as url_filter_module
from triplespark.llm.url_filter import url_filter


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op8_url_filter']})").fetchall()
    assert sorted(map(tuple, queries.op8_url_filter(spark, SF).collect())) == sorted(want)


def test_odd_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, "no scheme/x", 0), (4, "http://A.Org", 0), (5, "http://a.org/x", 0), (5, "http://a.org/x", 0), (None, "https://www.Bad.net/p/?q#f", 0), (6, "http://bad.net/p/index.html", 0), (7, "http://bad.net/pp", 0), (8, "http://notorg/x", 0), (9, "http://org/", 0), (10, "x://b.com/de/1?u=http://a.org/", 0), (11, "http://h.com#/fr/", 0), (12, "http://bad.net/P", 0)],
        "page_id long, url string, block int",
    )
    listed = spark.createDataFrame([("http://bad.net/p",), (None,), ("",), ("http://bad.net/p/",)], "url string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, listed, queries.URL_RULES).collect()}
    assert got == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.org", "", None, "allow"), (5, "a.org", "/x", "org/", "allow"), (None, "www.bad.net", "/p/", None, "block"),
        (6, "bad.net", "/p/index.html", None, "block"), (7, "bad.net", "/pp", None, "allow"), (8, "notorg", "/x", None, "allow"), (9, "org", "/", "org/", "allow"), (10, "b.com", "/de/1", "com/de/", "block"), (11, "h.com", "", None, "allow"), (12, "bad.net", "/P", None, "allow"),
    }
    assert url_filter(pages, listed, queries.URL_RULES).count() == 14
    assert {r.verdict for r in url_filter(pages, listed.where("false"), []).collect()} == {"allow"}
    assert url_filter(pages.where("false"), listed, []).collect() == []


def test_long_and_frequent_urls(spark, monkeypatch):
    """A very long URL, a listed page that most rows are, and a list that fills its filter up."""
    monkeypatch.setattr(url_filter_module, "MOST_BLOCKS", 1)
    rows = [(i, "http://hot.net/p") for i in range(500)] + [(1000 + i, f"http://h{i}.net/x") for i in range(300)] + [(9999, "http://long.net/" + "a/" * 20_000), (9998, "http://long.net/" + "a/" * 20_001)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = pages.where("page_id < 1200 or page_id = 9999").select("url")
    got = {r.page_id: r.verdict for r in url_filter(pages, listed, []).collect()}
    assert len(got) == len(rows) and {i for i, v in got.items() if v == "block"} == {i for i, _ in rows if i < 1200 or i == 9999}
