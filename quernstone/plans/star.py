"""Star-schema and decision-support queries on the driver tables.

Shapes follow the public Star Schema Benchmark and TPC-H, with the columns that
the driver tables have.  Dimensions are small beside the fact table; whether a
side is broadcast is left to its measured size (AQE), never to a hint.  Sums of
products are rounded to all the decimals they can have: no tie hangs on the
order in which doubles were added.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.plans.base import Plans
from quernstone.session import table

P = Plans()
REV = "sum(l_extendedprice * (1 - l_discount))"


@P.plan(
    """SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"""
)
def flagship_revenue(spark, sf_dir):
    """Filter-only sum: discount and quantity skip row groups in the scan; the reader lists the zoneless date range too, but can't skip by it."""
    li = table(spark, sf_dir, "lineitem")
    return li.filter(
        (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
        & F.col("l_discount").between(0.05, 0.07)
        & (F.col("l_quantity") < 24)
    ).agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"))


# ---- star schema, flights 1 to 4 -------------------------------------------
FLIGHT1 = """SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {w}"""
P.same("ssb_q11", FLIGHT1.format(w="year(o_orderdate) = 1997 AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25"))
P.same("ssb_q12", FLIGHT1.format(w="year(o_orderdate) = 1998 AND month(o_orderdate) = 1 AND l_discount BETWEEN 0.04 AND 0.06 AND l_quantity BETWEEN 26 AND 35"))
P.same("ssb_q13", FLIGHT1.format(w="year(o_orderdate) = 1998 AND date_trunc('week', o_orderdate) = TIMESTAMP '1998-02-02 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity BETWEEN 26 AND 40"))

FLIGHT2 = """SELECT round(sum(l_extendedprice), 2) AS revenue, CAST(year(o_orderdate) AS BIGINT) AS d_year, p_brand
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE {w} GROUP BY year(o_orderdate), p_brand ORDER BY d_year, p_brand"""
P.same("ssb_q21", FLIGHT2.format(w="p_type = 'PROMO' AND r_regionkey = 1"))
P.same("ssb_q22", FLIGHT2.format(w="p_brand BETWEEN 'Brand#2' AND 'Brand#4' AND r_regionkey = 2"))
P.same("ssb_q23", FLIGHT2.format(w="p_brand = 'Brand#3' AND r_regionkey = 3"))

FLIGHT3 = """SELECT cn.n_name AS c_nation, sn.n_name AS s_nation, CAST(year(o_orderdate) AS BIGINT) AS d_year, round(sum(l_extendedprice), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
JOIN region cr ON cn.n_regionkey = cr.r_regionkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
WHERE {w} GROUP BY cn.n_name, sn.n_name, year(o_orderdate) ORDER BY d_year ASC, revenue DESC"""
P.same("ssb_q31", FLIGHT3.format(w="cr.r_regionkey = 2 AND sr.r_regionkey = 2 AND year(o_orderdate) BETWEEN 1995 AND 1997"))
P.same("ssb_q32", FLIGHT3.format(w="cn.n_name = 'NATION_7' AND sn.n_name IN ('NATION_7', 'NATION_8') AND year(o_orderdate) BETWEEN 1995 AND 1999"))
P.same("ssb_q33", FLIGHT3.format(w="(cn.n_name = 'NATION_1' OR cn.n_name = 'NATION_5') AND (sn.n_name = 'NATION_1' OR sn.n_name = 'NATION_5') AND year(o_orderdate) BETWEEN 1995 AND 2001"))
P.same("ssb_q34", FLIGHT3.format(w="(cn.n_name = 'NATION_1' OR cn.n_name = 'NATION_5') AND (sn.n_name = 'NATION_1' OR sn.n_name = 'NATION_5') AND year(o_orderdate) = 1997 AND month(o_orderdate) = 12"))

FLIGHT4 = """SELECT CAST(year(o_orderdate) AS BIGINT) AS d_year, {k} AS k, round(sum(l_extendedprice - l_quantity * p_retailprice * 0.5), 4) AS profit
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
WHERE {w} GROUP BY year(o_orderdate), {k} ORDER BY d_year, k"""
P.same("ssb_q41", FLIGHT4.format(k="cn.n_name", w="cn.n_regionkey = 1 AND sn.n_regionkey = 1 AND p_type IN ('SMALL', 'LARGE')"))
P.same("ssb_q42", FLIGHT4.format(k="sn.n_name", w="cn.n_regionkey = 1 AND sn.n_regionkey = 1 AND year(o_orderdate) IN (1997, 1998) AND p_type IN ('SMALL', 'LARGE')"))
P.same("ssb_q43", FLIGHT4.format(k="p_brand", w="sn.n_name = 'NATION_6' AND year(o_orderdate) IN (1997, 1998)"))

# ---- TPC-H shapes -----------------------------------------------------------
P.same(
    "tpch_q1",
    f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
round({REV}, 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
P.same(
    "tpch_q2",
    """SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON s_nationkey = n_nationkey WHERE p_size = 15 AND p_type LIKE '%PROMO' AND l_extendedprice / l_quantity =
 (SELECT min(l2.l_extendedprice / l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
)
P.same(
    "tpch_q3",
    f"""SELECT l_orderkey, round({REV}, 4) AS revenue, o_orderdate, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
)
P.same(
    "tpch_q4",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
)
P.same(
    "tpch_q5",
    f"""SELECT n_name, round({REV}, 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name ORDER BY revenue DESC""",
)
P.same("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
P.same(
    "tpch_q7",
    f"""SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE ((n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_4') OR (n1.n_name = 'NATION_4' AND n2.n_name = 'NATION_3'))
AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1999-12-31') s GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
)
P.same(
    "tpch_q8",
    """SELECT o_year, round(sum(CASE WHEN nation_name = 'NATION_8' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation_name
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
WHERE p_type = 'ECONOMY') x GROUP BY o_year ORDER BY o_year""",
)
P.same(
    "tpch_q9",
    """SELECT nation_name, o_year, round(sum(amount), 4) AS sum_profit FROM (
SELECT n_name AS nation_name, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity * 0.1 AS amount
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE p_brand LIKE '%#2%') p GROUP BY nation_name, o_year ORDER BY nation_name, o_year DESC""",
)
P.same(
    "tpch_q10",
    f"""SELECT c_custkey, c_name, round({REV}, 4) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
P.same(
    "tpch_q11",
    """SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 8
GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.001 FROM lineitem l2 JOIN supplier s2 ON l2.l_suppkey = s2.s_suppkey WHERE s2.s_nationkey < 8) ORDER BY value DESC, l_partkey""",
)
P.same(
    "tpch_q12",
    """SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY l_returnflag ORDER BY l_returnflag""",
)
P.same(
    "tpch_q13",
    """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) x
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
)
P.same(
    "tpch_q14",
    """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'""",
)
P.same(
    "tpch_q15",
    f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, round({REV}, 4) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
)
P.same(
    "tpch_q16",
    """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
)
P.same(
    "tpch_q17",
    """SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#3' AND l_quantity < (SELECT 0.4 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
)
P.same(
    "tpch_q18",
    """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
)
P.same(
    "tpch_q19",
    f"""SELECT round({REV}, 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""",
)
P.same(
    "tpch_q20",
    """SELECT s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND s_suppkey IN (
SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE 'SMALL%') GROUP BY l_suppkey, l_partkey HAVING sum(l_quantity) > 60) ORDER BY s_name""",
)
P.same(
    "tpch_q21",
    """SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey
WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
)
P.same(
    "tpch_q22",
    """SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE substring(c_mktsegment, 1, 1) IN ('A', 'B', 'M', 'H', 'F') AND c_acctbal > (SELECT avg(c_acctbal) FROM customer c2 WHERE c2.c_acctbal > 0)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_mktsegment ORDER BY c_mktsegment""",
)
P.same(
    "star_rank_topk",
    f"""SELECT region_name, supp_name, rev, CAST(rnk AS BIGINT) AS rnk FROM (SELECT r_name AS region_name, s_name AS supp_name, round({REV}, 4) AS rev,
rank() OVER (PARTITION BY r_name ORDER BY round({REV}, 4) DESC) AS rnk
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, s_name) x WHERE rnk <= 3""",
)
P.same(
    "star_topk_limit",
    f"""SELECT n_name, c_mktsegment, round({REV}, 4) AS rev FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey
GROUP BY n_name, c_mktsegment ORDER BY rev DESC, n_name, c_mktsegment LIMIT 10""",
)

QUERIES, ORACLES = P.queries, P.oracles
