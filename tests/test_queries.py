"""Every registered query of the graph engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from triplespark import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
#: One of each kind; the driver compares all of them.
NAMES = ["tp2_subject", "tp6_po", "tp10_same_var", "st1_repeat_pred", "st2_star3_onepass", "st3_star3_widerow", "st4_star_fragment_dedup", "bj1_bind_join", "bj5_cartesian", "al5_optional_chain", "al8_group_concat", "al9_plus", "al10_describe", "fr4_brtpf", "fr5_star_page", "ag4_char_sets", "di1_sections", "it5_merge_annotated", "src8_simple", "src6_turtle", "snk1_dataset", "fn3_strings",
         "sh4_shapes", "tp13_order_pos", "fr9_page_cache", "fr10_client_cache", "src3_object_index", "st1_stored", "al1_stored", "fn_datatypes", "fn_arithmetic_types", "al5_exists_inside", "al12_graph_variable", "al7_distinct_order", "al8_sum_error", "ag9_metrics", "it11_timeout", "snk10_pages", "fn8_checksums", "src10_archives"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql(f'SELECT {", ".join(chr(34) + n + chr(34) for n in names)} FROM ({queries.ORACLE_SQL[name]})').fetchall()
    assert plain(df.select(*names).collect()) == plain(want)


def test_all_have_sql():
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stars_over_buckets_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = queries.joins.match_star(queries.bucketed(spark, SF, "customer"), queries.STAR)
        assert "Exchange" not in plan_of(star) and "SortMergeJoin" in plan_of(star)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_objects_are_read_from_their_copy(spark):
    graph = queries.stored(spark, SF, "customer", "nation")
    assert all("_by_object/" in f for f in graph.match(o="urn:kg:nation/3").inputFiles())
    assert not any("_by_object/" in f for f in graph.match(p="urn:kg:nation#n_name", o="urn:kg:nation/3").inputFiles())
    assert graph.statistics().predicates["urn:kg:nation#n_name"][0] == 25


def test_bound_parts_of_optionals_join_on_equal_columns(spark):
    """Only solutions without a shared bound variable make a product."""
    text = "SELECT * WHERE { ?c cu:c_name ?n OPTIONAL { ?o or:o_custkey ?c } OPTIONAL { ?o or:o_custkey ?c ; or:o_orderstatus ?s } }"
    plan = plan_of(queries.sparql(queries.mapped(spark, SF, "customer", "orders"), text, queries.PREFIXES))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_customers_without_orders_meet_no_order(spark, con, tmp_path):
    """Customers 3 and 4 have none, customer 2 has no name, order 14 has no status and order 15 no customer."""
    made = {
        "customer": "select * replace (if(c_custkey = 2, null, c_name) as c_name) from customer where c_custkey between 1 and 4",
        "orders": "select k as o_orderkey, c as o_custkey, s as o_orderstatus from (values (11, 1, 'F'), (12, 1, 'O'), (13, 2, 'F'), (14, 2, null), (15, null, 'F')) t(k, c, s)",
    }
    sql = queries.ORACLE_SQL["al5_optional_chain"]
    own = duckdb.connect()
    for t, rows in made.items():
        con.sql(f"copy ({rows}) to '{tmp_path}/{t}.parquet' (format parquet)")
        own.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = queries.QUERIES["al5_optional_chain"](spark, str(tmp_path))
    got = plain(df.select("c", "o", "s").collect())
    assert len(got) == 4 and got == plain(own.sql(f"SELECT c, o, s FROM ({sql})").fetchall())
    assert "NestedLoop" not in plan_of(df) and "CartesianProduct" not in plan_of(df)
