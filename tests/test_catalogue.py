"""Every registered query against its oracle, and a canary that the comparison can fail."""

from collections import Counter

import pytest

from tessel.plans import catalogue
from tests.oracle import connection, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_matches_oracle(spark, con, name):
    assert difference(catalogue.queries()[name](spark, SF), con, catalogue.oracles()[name]) is None


def test_comparison_can_fail(spark, con):
    df = catalogue.opened(spark, SF).sql("SELECT r_regionkey + 1 AS k FROM region")
    assert difference(df, con, "SELECT r_regionkey AS k FROM region") is not None
    assert difference(df.limit(2), con, "SELECT r_regionkey + 1 AS k FROM region") is not None


def test_plans_push_down(spark):
    df = catalogue.opened(spark, SF).sql("SELECT c_name FROM customer WHERE c_custkey = 42 AND c_acctbal > 0")
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(c_custkey,42)" in plan and "c_mktsegment" not in plan.split("ReadSchema")[-1]


def test_whole_texts_are_split(spark):
    got = {r.doc_id: r.n for r in catalogue.queries()["fn_str_to_array"](spark, SF).collect()}
    assert got == {r.doc_id: len(r.text.split(" ")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_all_lineitems_are_read(spark):
    """At a size with order keys beyond 2000."""
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    assert catalogue.queries()["agg_regr"](spark, d).first().n == rows.filter("l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL").count()
    left = Counter(r[0] for r in rows.select("l_linenumber").collect()) - Counter(r[0] for r in spark.read.parquet(f"{d}/nation.parquet").select("n_regionkey").collect())
    assert Counter(r.k for r in catalogue.queries()["setop_except_all"](spark, d).collect()) == left


@pytest.mark.parametrize("name", ["agg_regr", "setop_except_all"])
def test_matches_oracle_on_more_rows(spark, name):
    d = "/root/testdata/sf0.01"
    assert difference(catalogue.queries()[name](spark, d), connection(d), catalogue.oracles()[name]) is None


def test_ties_and_zeros_are_kept(spark):
    orders, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    got = {r.o_orderkey: r.i for r in catalogue.queries()["expr_cast"](spark, SF).collect()}
    assert got == {r.o_orderkey: round(r.o_totalprice) for r in orders.collect()}  # round() takes ties to even
    assert any(r.o_totalprice % 1 == 0.5 for r in orders.collect())
    assert catalogue.queries()["fn_math_basic"](spark, SF).count() == items.count()
