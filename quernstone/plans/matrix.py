"""Operators over every pair of types, generated: arithmetic, comparison, casts and aggregates."""

from __future__ import annotations

from quernstone.plans.base import Plans

P = Plans()

INTS = {"i1": "TINYINT", "i2": "SMALLINT", "i4": "INT", "i8": "BIGINT"}
FLOATS = {"f4": "FLOAT", "f8": "DOUBLE"}
NUMERIC = {"n": "DECIMAL(12, 3)"}
ALL = {**INTS, **FLOATS, **NUMERIC}

_SRC = "(SELECT l_orderkey, l_linenumber AS a, CAST(l_quantity AS INT) % 9 - 4 AS b FROM lineitem) s"


def _pairs(types: dict[str, str]):
    return [(x, y) for x in types for y in types]


for _op, _name in (("+", "add"), ("-", "sub"), ("*", "mul")):
    P.same(
        f"matrix_{_name}_int",
        "SELECT " + ", ".join(f"CAST(sum(CAST(CAST(a AS {INTS[x]}) {_op} CAST(b AS {INTS[y]}) AS BIGINT)) AS BIGINT) AS {x}_{y}" for x, y in _pairs(INTS)) + f" FROM {_SRC}",
    )
    P.same(
        f"matrix_{_name}_float",
        "SELECT " + ", ".join(f"round(sum(CAST(CAST(a AS {ALL[x]}) {_op} CAST(b AS {ALL[y]}) AS DOUBLE)), 4) AS {x}_{y}" for x, y in _pairs(ALL) if "f" in x + y or "n" in x + y) + f" FROM {_SRC}",
    )
for _op, _name in (("=", "eq"), ("<>", "ne"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge")):
    P.same(f"matrix_{_name}", "SELECT " + ", ".join(f"count(CASE WHEN CAST(a AS {ALL[x]}) {_op} CAST(b AS {ALL[y]}) THEN 1 END) AS {x}_{y}" for x, y in _pairs(ALL)) + f" FROM {_SRC}")

# casts between integers, and from floats by half-even rounding
_HALF = "(SELECT l_linenumber, l_quantity / 2 AS h FROM lineitem) s"
_CAST = "SELECT " + ", ".join(f"CAST(sum(CAST({{r}}(CAST(h AS {FLOATS[x]}){{z}}) AS {INTS[y]})) AS BIGINT) AS {x}_{y}" for x in FLOATS for y in INTS) + f" FROM {_HALF}"
P.same("matrix_cast_float_int", _CAST.format(r="rint", z=""), _CAST.format(r="round_even", z=", 0"))
P.same("matrix_cast_int", "SELECT " + ", ".join(f"CAST(sum(CAST(CAST(a AS {ALL[x]}) AS {INTS[y]})) AS BIGINT) AS {x}_{y}" for x in (*INTS, "n") for y in INTS) + f" FROM {_SRC}")

# every aggregate over every type, with nulls and filters
for _t, _type in ALL.items():
    _v = f"CAST(nullif(b, 0) AS {_type})"
    P.same(
        f"matrix_agg_{_t}",
        f"SELECT a, count({_v}) AS n, CAST(sum(CAST({_v} AS DOUBLE)) AS DOUBLE) AS s, CAST(min({_v}) AS DOUBLE) AS lo, CAST(max({_v}) AS DOUBLE) AS hi, round(avg(CAST({_v} AS DOUBLE)), 8) AS av, "
        f"round(stddev_samp({_v}), 8) AS ss, round(stddev_pop({_v}), 8) AS sp, round(var_samp({_v}), 8) AS vs, round(var_pop({_v}), 8) AS vp, count({_v}) FILTER (WHERE b > 1) AS nf, CAST(max({_v}) FILTER (WHERE b < 0) AS DOUBLE) AS mf FROM {_SRC} GROUP BY a",
    )

P.same("datetime_compare", "SELECT count(CASE WHEN l_shipdate > o_orderdate THEN 1 END) AS gt, count(CASE WHEN CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE) THEN 1 END) AS le, count(CASE WHEN CAST(l_shipdate AS DATE) = o_orderdate + INTERVAL '30' DAY THEN 1 END) AS eq, count(CASE WHEN CAST(o_orderdate AS DATE) <> l_shipdate THEN 1 END) AS ne FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
P.same("time_compare", "SELECT count(CASE WHEN hour(ts) < 12 THEN 1 END) AS am, count(CASE WHEN hour(ts) * 60 + minute(ts) >= 1110 THEN 1 END) AS late FROM events")
P.same("uuid_compare", "SELECT count(CASE WHEN md5(a.n_name) < md5(b.n_name) THEN 1 END) AS lt, count(CASE WHEN md5(a.n_name) = md5(b.n_name) THEN 1 END) AS eq FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
P.same("money_arith", "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(19, 2))) AS DOUBLE) AS s, CAST(max(CAST(o_totalprice AS DECIMAL(19, 2)) - CAST(100 AS DECIMAL(19, 2))) AS DOUBLE) AS m FROM orders GROUP BY o_orderstatus")
P.same("hashed_in_list", "SELECT count(*) AS n FROM part WHERE p_partkey IN (" + ", ".join(str(i * 7 % 2003) for i in range(60)) + ") OR p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')")
P.same("hashed_case", "SELECT CASE p_size " + " ".join(f"WHEN {i} THEN 'k{i % 5}'" for i in range(1, 40)) + " ELSE 'rest' END AS k, count(*) AS n FROM part GROUP BY 1")

QUERIES, ORACLES = P.queries, P.oracles
