"""Every query of the engine against its SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

from prosegauge.plans import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(rows):
    return sorted(str([repr(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, FOLDER)
    names = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*names).collect()]
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert rows and len(set(names)) == len(names)
        return
    want = duck.execute(f"select {', '.join(names)} from ({sql})")
    assert sorted(d[0] for d in duck.execute(sql).description) == names
    want = duck.execute(f"select {', '.join(names)} from ({sql})").fetchall()
    assert len(rows) == len(want) and plain(rows) == plain(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["cross_page_merge", "top_navigation", "repeated_edges", "passive_version_diff"])
def test_no_query_is_vacuous(spark, name):
    assert queries.queries()[name](spark, FOLDER).limit(20).count() == 20 or name == "repeated_edges"
    assert queries.queries()[name](spark, FOLDER).count() > 1


def test_every_role_and_rule_is_met(spark):
    rows = queries.queries()["tag_group_resolution"](spark, FOLDER)
    assert {r["role"] for r in rows.select("role").distinct().collect()} == {"body", "heading", "list", "table", "table_of_contents", "decorative", "navigation", "unknown"}
    assert {"header", "footer"} <= {r["role"] for r in queries.queries()["line_roles"](spark, FOLDER).select("role").distinct().collect()}
    words, tags, *_ = queries._word_tables(spark, FOLDER)
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("sum(size(regexp_extract_all(coalesce(text, ''), '\\\\S+', 0))) AS n").first()["n"]
    assert words.where("native_index < 500").count() == n, "whole texts are laid out"
