"""Queries that once read an id subset: what they count, against the sizes of the tables, without their oracles."""

import pytest

from quernstone.plans import registry

SF = "/root/testdata/sf0.01"  # at sf0.001 the subsets were the whole tables
QUERIES = registry.queries()


@pytest.fixture(scope="module")
def sizes(spark):
    count = lambda e, t: spark.read.parquet(f"{SF}/{t}.parquet").selectExpr(f"{e} AS n").first()["n"]
    return {"orders": count("count(*)", "orders"), "lineitem": count("count(*)", "lineitem"), "customers": count("count(DISTINCT o_custkey)", "orders"), "pairs": count("count(DISTINCT l_orderkey & 255, l_partkey | 1024)", "lineitem")}


@pytest.mark.parametrize(("name", "size"), [("win_lag_lead_ntile", "orders"), ("win_frames", "orders"), ("win_nth_value", "orders"), ("agg_ordered", "customers"), ("sort_nulls", "orders")])
def test_relational(spark, sizes, name, size):
    assert QUERIES[name](spark, SF).count() == sizes[size]


def test_matrix(spark, sizes):
    one = lambda name: QUERIES[name](spark, SF).first().asDict()
    for a, b in (("eq", "ne"), ("lt", "ge"), ("le", "gt")):
        x, y = one(f"matrix_{a}"), one(f"matrix_{b}")
        assert all(x[k] + y[k] == sizes["lineitem"] for k in x)
    s = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_linenumber AS a", "CAST(l_quantity AS INT) % 9 - 4 AS b", "CAST(rint(l_quantity / 2) AS INT) AS h")
    want = s.selectExpr("sum(a + b) AS p", "sum(a - b) AS m", "sum(a * b) AS t", "sum(a) AS a", "sum(h) AS h", "count(nullif(b, 0)) AS n").first()
    for name, v in (("add", want["p"]), ("sub", want["m"]), ("mul", want["t"])):
        assert set(one(f"matrix_{name}_int").values()) == {v}
        assert set(one(f"matrix_{name}_float").values()) == {v}
    assert set(one("matrix_cast_int").values()) == {want["a"]} and set(one("matrix_cast_float_int").values()) == {want["h"]}
    for t in ("i1", "i2", "i4", "i8", "f4", "f8", "n"):
        assert sum(r["n"] for r in QUERIES[f"matrix_agg_{t}"](spark, SF).collect()) == want["n"]


@pytest.mark.parametrize(("name", "size"), [("arith_ops", "lineitem"), ("bitwise_ops", "pairs"), ("bitwise_shift", "lineitem"), ("math_fns", "lineitem"), ("trig_fns", "lineitem"), ("round_half_even", "lineitem"), ("casts_numeric", "orders")])
def test_scalar(spark, sizes, name, size):
    assert QUERIES[name](spark, SF).count() == sizes[size]
