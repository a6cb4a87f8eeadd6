"""Types that Spark lacks or orders differently: ranges, times with zones, addresses, cubes, geometries, half floats."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions import arith, dates, geometry, nested, ranges
from quernstone.operators import joins
from quernstone.plans.base import Plans
from quernstone.session import spread, table

P = Plans()
c = F.col


def _count(condition, name):
    return F.count(F.when(condition, 1)).alias(name)


# ---- ranges ------------------------------------------------------------------------
_BOUNDS = """(SELECT o_orderpriority AS g, o_custkey % 500 AS v,
 coalesce(CASE WHEN o_orderkey % 17 > 0 THEN o_custkey % 500 END, -1000000) AS a, coalesce(CASE WHEN o_orderkey % 19 > 0 THEN o_custkey % 500 + o_orderkey % 40 END, 1000000) AS b,
 o_orderkey % 17 > 0 AND o_orderkey % 19 > 0 AND o_orderkey % 40 = 0 AS e, o_orderkey % 520 AS p, o_orderkey % 520 + o_custkey % 60 AS q, o_custkey % 60 = 0 AS f FROM orders) r"""
_OVER = "(NOT e AND NOT f AND a < q AND p < b)"
_NEXT = "(NOT e AND NOT f AND (b = p OR q = a))"


def _xy(spark, sf_dir):
    k, u = c("o_orderkey"), c("o_custkey")
    low, high = F.when(k % 17 > 0, u % 500), F.when(k % 19 > 0, u % 500 + k % 40)
    return table(spark, sf_dir, "orders").select(c("o_orderpriority").alias("g"), (u % 500).alias("v"), ranges.of_ints(low, high).alias("x"), ranges.of_ints(k % 520 - 1, k % 520 + u % 60, "()").alias("y"))


@P.plan(
    f"""SELECT g, count(CASE WHEN NOT e AND v >= a AND v < b THEN 1 END) AS has_value, count(CASE WHEN f OR (NOT e AND a <= p AND b >= q) THEN 1 END) AS has_range, count(CASE WHEN e OR (NOT f AND p <= a AND q >= b) THEN 1 END) AS within,
 count(CASE WHEN {_OVER} THEN 1 END) AS over, count(CASE WHEN NOT e AND NOT f AND b <= p THEN 1 END) AS before, count(CASE WHEN NOT e AND NOT f AND q <= a THEN 1 END) AS after, count(CASE WHEN NOT e AND NOT f AND b <= q THEN 1 END) AS not_right,
 count(CASE WHEN NOT e AND NOT f AND a >= p THEN 1 END) AS not_left, count(CASE WHEN {_NEXT} THEN 1 END) AS adjacent, count(CASE WHEN (e AND f) OR (NOT e AND NOT f AND a = p AND b = q) THEN 1 END) AS eq,
 count(CASE WHEN (e AND NOT f) OR (NOT e AND NOT f AND (a < p OR (a = p AND b < q))) THEN 1 END) AS lt, count(CASE WHEN (f AND NOT e) OR (NOT e AND NOT f AND (a > p OR (a = p AND b > q))) THEN 1 END) AS gt FROM {_BOUNDS} GROUP BY g"""
)
def range_int_predicates(spark, sf_dir):
    """Integer ranges, some empty, some without bounds: every predicate."""
    x, y = c("x"), c("y")
    return _xy(spark, sf_dir).groupBy("g").agg(
        _count(ranges.contains_value(x, c("v")), "has_value"), _count(ranges.contains(x, y), "has_range"), _count(ranges.contains(y, x), "within"), _count(ranges.overlaps(x, y), "over"), _count(ranges.before(x, y), "before"), _count(ranges.before(y, x), "after"),
        _count(ranges.not_right_of(x, y), "not_right"), _count(ranges.not_left_of(x, y), "not_left"), _count(ranges.adjacent(x, y), "adjacent"), _count(ranges.compare(x, y) == 0, "eq"), _count(ranges.compare(x, y) < 0, "lt"), _count(ranges.compare(x, y) > 0, "gt"),
    )


@P.plan(
    f"""SELECT g, count(CASE WHEN NOT {_OVER} THEN 1 END) AS apart, CAST(sum(CASE WHEN {_OVER} THEN greatest(a, p) + least(b, q) ELSE 0 END) AS BIGINT) AS inter, count(CASE WHEN e THEN 1 END) AS empty_x, count(CASE WHEN NOT e AND a = -1000000 THEN 1 END) AS open_low, count(CASE WHEN NOT e AND b = 1000000 THEN 1 END) AS open_high,
 CAST(sum(CASE WHEN e AND f THEN 0 WHEN e THEN p + q WHEN f THEN a + b ELSE least(a, p) + greatest(b, q) END) AS BIGINT) AS merged,
 CAST(sum(CASE WHEN NOT ({_OVER} OR {_NEXT} OR e OR f) OR (e AND f) THEN 0 WHEN e THEN p + q WHEN f THEN a + b ELSE least(a, p) + greatest(b, q) END) AS BIGINT) AS joined,
 CAST(sum(CASE WHEN e THEN 0 WHEN NOT {_OVER} THEN a + b WHEN a < p AND b > q THEN 0 WHEN a < p THEN a + p WHEN b > q THEN q + b ELSE 0 END) AS BIGINT) AS minus FROM {_BOUNDS} GROUP BY g"""
)
def range_int_functions(spark, sf_dir):
    """Integer ranges: intersection, merge, union, difference, bounds."""
    x, y = c("x"), c("y")
    ends = lambda r: F.when(r["empty"], F.lit(0)).otherwise(F.coalesce(r["lower"], F.lit(-1000000)) + F.coalesce(r["upper"], F.lit(1000000)))
    total = lambda v, name: F.sum(v).cast("long").alias(name)
    over = ranges.overlaps(x, y)
    inside = over & F.coalesce(x["lower"] < y["lower"], x["lower"].isNull()) & F.coalesce(x["upper"] > y["upper"], x["upper"].isNull())
    can_join = over | ranges.adjacent(x, y) | x["empty"] | y["empty"]
    return _xy(spark, sf_dir).groupBy("g").agg(
        _count(ranges.intersection(x, y)["empty"], "apart"), total(ends(ranges.intersection(x, y)), "inter"), _count(x["empty"], "empty_x"), _count(ranges.lower_inf(x), "open_low"), _count(ranges.upper_inf(x), "open_high"), total(ends(ranges.merge(x, y)), "merged"),
        total(F.when(can_join, ends(ranges.union(x, y))).otherwise(0), "joined"), total(F.when(inside, F.lit(0)).otherwise(ends(ranges.difference(x, y))), "minus"),
    )


@P.plan(
    """SELECT g, count(CASE WHEN s <= t2 AND t1 <= e THEN 1 END) AS closed, count(CASE WHEN s < t2 AND t1 < e THEN 1 END) AS open, count(CASE WHEN t1 BETWEEN s AND e THEN 1 END) AS has, count(CASE WHEN e = t1 OR t2 = s THEN 1 END) AS touch
FROM (SELECT l_returnflag AS g, o_orderdate AS s, o_orderdate + INTERVAL 60 DAY AS e, l_shipdate AS t1, l_shipdate + INTERVAL 30 DAY AS t2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey) r GROUP BY g"""
)
def range_timestamp(spark, sf_dir):
    """Timestamp ranges with inclusive and exclusive bounds."""
    day = lambda x, n: x + F.expr(f"INTERVAL '{n}' DAY")
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey"))
    s, t = c("o_orderdate"), c("l_shipdate")
    r = j.select(c("l_returnflag").alias("g"), t.alias("t"), ranges.make(s, day(s, 60), "[]").alias("x"), ranges.make(t, day(t, 30), "[]").alias("y"), ranges.make(t, day(t, 30), "()").alias("z"))
    return r.groupBy("g").agg(_count(ranges.overlaps(c("x"), c("y")), "closed"), _count(ranges.overlaps(c("x"), c("z")), "open"), _count(ranges.contains_value(c("x"), c("t")), "has"), _count(ranges.adjacent(c("x"), c("z")), "touch"))


@P.plan("SELECT o_orderstatus AS g, CAST(sum(CASE WHEN d >= DATE '1995-02-01' AND d <= DATE '1996-02-10' THEN 1 ELSE 0 END) AS BIGINT) AS near, min(greatest(d, DATE '1995-02-01')) AS lo, max(least(d + 10, DATE '1996-02-11')) AS hi FROM (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS d FROM orders) o WHERE d + 10 > DATE '1995-02-01' AND d < DATE '1996-02-11' GROUP BY o_orderstatus")
def range_date(spark, sf_dir):
    """Date ranges are discrete: (a, b] is [a + 1, b + 1)."""
    d = c("d")
    year = ranges.of_dates(F.lit("1995-01-31").cast("date"), F.lit("1996-02-10").cast("date"), "(]")
    own = table(spark, sf_dir, "orders").select("o_orderstatus", c("o_orderdate").cast("date").alias("d")).withColumn("x", ranges.of_dates(d, F.date_add(d, 10)))
    met = own.withColumn("y", year).filter(ranges.overlaps(c("x"), c("y"))).withColumn("i", ranges.intersection(c("x"), c("y")))
    return met.groupBy(c("o_orderstatus").alias("g")).agg(F.sum(ranges.contains_value(c("y"), d).cast("long")).alias("near"), F.min("i.lower").alias("lo"), F.max("i.upper").alias("hi"))


# ---- times -----------------------------------------------------------------------------
_US = "CAST(epoch_us(ts) % 86400000000 AS BIGINT)"
_EAST = "CAST((user_id % 27 - 12) * 1800 AS BIGINT)"
_OTHER = "CAST((event_id % 27 - 12) * 1800 AS BIGINT)"


@P.plan(
    f"""SELECT event_id, m1 < m2 OR (m1 = m2 AND -e1 < -e2) AS lt, m1 = m2 AND e1 = e2 AS eq, (us + 7200000000) % 86400000000 AS later, ((us + (3600 - e1) * 1000000) % 86400000000 + 86400000000) % 86400000000 AS paris, us // 3600000000 AS h, (us % 3600000000) // 60000000 AS mi,
CAST(sign(e1) * (abs(e1) // 3600) AS BIGINT) AS zh, CAST(sign(e1) * (abs(e1) % 3600 // 60) AS BIGINT) AS zm, (us - e1 * 1000000) / 1000000.0::DOUBLE AS epoch, make_timestamp(CAST(date_diff('day', DATE '1970-01-01', DATE '2001-01-31') AS BIGINT) * 86400000000 + us - e1 * 1000000) AS moment
FROM (SELECT event_id, {_US} AS us, {_EAST} AS e1, {_OTHER} AS e2, {_US} - {_EAST} * 1000000 AS m1, 43200000000 - {_OTHER} * 1000000 AS m2 FROM events) t"""
)
def timetz_ops(spark, sf_dir):
    """Times with zones: order, interval arithmetic, zone changes, fields, date + timetz."""
    ev = table(spark, sf_dir, "events")
    a = dates.timetz(dates.time_us(c("ts")), (c("user_id") % 27 - 12) * 1800)
    b = dates.timetz(F.lit(43_200_000_000), (c("event_id") % 27 - 12) * 1800)
    day = F.lit("2001-01-31").cast("date")
    return ev.select("event_id", a.alias("a"), b.alias("b")).select(
        "event_id", (dates.timetz_key(c("a")) < dates.timetz_key(c("b"))).alias("lt"), (dates.timetz_key(c("a")) == dates.timetz_key(c("b"))).alias("eq"), dates.timetz_add(c("a"), 7_200_000_000)["us"].alias("later"), dates.timetz_at(c("a"), 3600)["us"].alias("paris"),
        dates.extract_timetz("hour", c("a")).alias("h"), dates.extract_timetz("minute", c("a")).alias("mi"), dates.extract_timetz("timezone_hour", c("a")).alias("zh"), dates.extract_timetz("timezone_minute", c("a")).alias("zm"), dates.extract_timetz("epoch", c("a")).alias("epoch"),
        dates.date_at_timetz(day, c("a")).cast("timestamp_ntz").alias("moment"),
    )


@P.plan(
    f"""SELECT event_id, make_timestamp(CAST(epoch_us(date_trunc('day', ts)) + (us + 50000000000) % 86400000000 AS BIGINT)) AS moved, us < 36000000000 AND 32400000000 < us + 3600000000 AS met, (us % 60000000) / 1000000.0::DOUBLE AS s, (us % 60000000) / 1000.0::DOUBLE AS ms,
CAST(-(user_id % 5) * 30 - user_id % 40 AS BIGINT) * 86400000000 < -70 * 86400000000 AS longer FROM (SELECT event_id, user_id, ts, {_US} AS us FROM events) t"""
)
def date_time_ops(spark, sf_dir):
    """date + time, OVERLAPS of times, seconds and milliseconds, negated intervals."""
    us = dates.time_us(c("ts"))
    months, days, rest = dates.interval_negate(c("user_id") % 5, c("user_id") % 40, F.lit(0))
    met = dates.overlaps(us, us + 3_600_000_000, F.lit(32_400_000_000), F.lit(36_000_000_000))
    return table(spark, sf_dir, "events").select(
        "event_id", dates.date_at_time(c("ts").cast("date"), dates.time_add(us, 50_000_000_000)).alias("moved"), met.alias("met"), dates.extract("second", c("ts")).alias("s"), dates.extract("milliseconds", c("ts")).alias("ms"),
        (dates.interval_key(months, days, rest) < dates.interval_key(F.lit(-2), F.lit(-10), F.lit(0))).alias("longer"),
    )


# ---- addresses ---------------------------------------------------------------------------
_NETS = """(SELECT event_id, 167772160 + CAST(user_id % 4 AS BIGINT) * 65536 + CAST(event_id % 256 AS BIGINT) * 256 + 7 AS a, CAST(8 + user_id % 25 AS BIGINT) AS m, 167772160 + CAST(event_id % 4 AS BIGINT) * 65536 + CAST(user_id % 256 AS BIGINT) * 256 + 7 AS b, CAST(8 + event_id % 25 AS BIGINT) AS n FROM events) t"""


@P.plan(
    f"""SELECT event_id, CASE WHEN x < y THEN -1 WHEN x > y THEN 1 WHEN m < n THEN -1 WHEN m > n THEN 1 WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS cmp, x = y AND n > m AS sup, x = y AND n >= m AS supeq, x = y AND m > n AS sub, x = y AND m >= n AS subeq, x = y AS over
FROM (SELECT *, a >> (32 - least(m, n)) AS x, b >> (32 - least(m, n)) AS y FROM {_NETS}) s"""
)
def inet_compare(spark, sf_dir):
    """Networks: order, <<, <<=, >>, >>=, &&."""
    dotted = lambda p, q, bits: nested.inet(F.concat(F.lit("10."), (p % 4).cast("string"), F.lit("."), (q % 256).cast("string"), F.lit(".7/"), (bits % 25 + 8).cast("string")))
    u, e = c("user_id"), c("event_id")
    t = table(spark, sf_dir, "events").select("event_id", dotted(u, e, u).alias("a"), dotted(e, u, e).alias("b"))
    a, b = c("a"), c("b")
    return t.select("event_id", nested.inet_compare(a, b).alias("cmp"), nested.inet_contains(a, b, True).alias("sup"), nested.inet_contains(a, b).alias("supeq"), nested.inet_contains(b, a, True).alias("sub"), nested.inet_contains(b, a).alias("subeq"), nested.inet_overlaps(a, b).alias("over"))


_HEX = "md5(CAST(o_custkey AS VARCHAR))"


@P.plan(
    f"""SELECT o_orderpriority AS g, min(u) AS least, max(u) AS most, count(CASE WHEN u < w THEN 1 END) AS lt, count(CASE WHEN m < n THEN 1 END) AS mac_lt, count(CASE WHEN m >= n THEN 1 END) AS mac_ge, count(DISTINCT substr(m, 1, 9) || '00:00:00') AS makers
FROM (SELECT o_orderpriority, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS u, '80000000-0000-0000-0000-000000000000' AS w,
 substr(h, 1, 2) || ':' || substr(h, 3, 2) || ':' || substr(h, 5, 2) || ':' || substr(h, 7, 2) || ':' || substr(h, 9, 2) || ':' || substr(h, 11, 2) AS m, '08:00:2b:01:02:03' AS n FROM (SELECT o_orderpriority, {_HEX} AS h FROM orders) o) t GROUP BY o_orderpriority"""
)
def uuid_macaddr_compare(spark, sf_dir):
    """UUIDs and hardware addresses over a column, from different written forms."""
    h = F.md5(c("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", nested.uuid(F.concat(F.lit("{"), F.upper(h), F.lit("}"))).alias("u"), nested.macaddr(F.concat_ws("-", *[F.substring(h, 2 * i + 1, 2) for i in range(6)])).alias("m"))
    w, n = nested.uuid(F.lit("80000000000000000000000000000000")), nested.macaddr(F.lit("0800.2B01.0203"))
    return rows.groupBy(c("o_orderpriority").alias("g")).agg(F.min("u").alias("least"), F.max("u").alias("most"), _count(c("u") < w, "lt"), _count(c("m") < n, "mac_lt"), _count(c("m") >= n, "mac_ge"), F.count_distinct(nested.macaddr_trunc(c("m"))).alias("makers"))


@P.plan("SELECT o_orderstatus AS g, count(CASE WHEN m < 100000.05 THEN 1 END) AS lt, count(CASE WHEN m <> n THEN 1 END) AS ne, CAST(sum(m / 2.5) AS DOUBLE) AS half, CAST(min(m) AS DOUBLE) AS lo FROM (SELECT o_orderstatus, CAST(o_totalprice AS DECIMAL(19, 2)) AS m, CAST(CAST(o_totalprice AS BIGINT) AS DECIMAL(19, 2)) AS n FROM orders) o GROUP BY o_orderstatus")
def money_compare(spark, sf_dir):
    """Money: comparison, casts, quotients."""
    m = arith.money(c("o_totalprice"))
    n = arith.money(F.rint("o_totalprice").cast("long"))
    return table(spark, sf_dir, "orders").select("o_orderstatus", m.alias("m"), n.alias("n")).groupBy(c("o_orderstatus").alias("g")).agg(_count(c("m") < 100000.05, "lt"), _count(c("m") != c("n"), "ne"), F.sum(c("m").cast("double") / 2.5).alias("half"), F.min("m").cast("double").alias("lo"))


# ---- cubes and geometries ---------------------------------------------------------------------
@P.plan(
    """SELECT vec_id, a < b OR (a = b AND (p < q OR (p = q AND (a2 < b2 OR (a2 = b2 AND p2 < q2))))) AS lt, a <= 0 AND a2 >= 0.05 AS inside FROM (SELECT vec_id, least(x, y) AS a, least(z, w) AS p, least(z, w) AS b, least(x, y) AS q, greatest(x, y) AS a2, greatest(z, w) AS p2, greatest(z, w) AS b2, greatest(x, y) AS q2
FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS w FROM embeddings) e) t"""
)
def cube_order(spark, sf_dir):
    """Cubes: order by lower, then upper corners; contained in."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    x, y, z, w = (e[i] for i in range(4))
    one = nested.cube(F.array(x, z), F.array(y, w))
    two = nested.cube(F.array(z, x), F.array(w, y))
    small = nested.cube(F.array(F.lit(0.0)), F.array(F.lit(0.05)))
    return table(spark, sf_dir, "embeddings").select("vec_id", (nested.cube_key(one) < nested.cube_key(two)).alias("lt"), nested.cube_contained(small, nested.cube(F.array(x), F.array(y))).alias("inside"))


_PART = "(SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice / 50 AS y FROM part) t"


@P.plan(
    f"""SELECT p_partkey, round(sqrt(power(x - 20, 2) + power(y - 20, 2)), 8) AS d, round(CASE WHEN x BETWEEN 10 AND 40 AND y BETWEEN 10 AND 30 THEN 0 ELSE sqrt(power(greatest(10 - x, 0, x - 40), 2) + power(greatest(10 - y, 0, y - 30), 2)) END, 8) AS to_box,
x > 10 AND x < 40 AND y > 10 AND y < 30 AND NOT (x >= 20 AND x <= 25 AND y >= 15 AND y <= 25) AS inside, greatest(10 - x, 0, x - 40) <= 2 AND greatest(10 - y, 0, y - 30) <= 2 AS near_box, x >= 10 AND x <= 40 AND y >= 10 AND y <= 30 AS in_bounds,
CASE WHEN x > 10 AND x < 40 AND y > 10 AND y < 30 AND NOT (x >= 20 AND x <= 25 AND y >= 15 AND y <= 25) THEN '0FFFFF212' WHEN x >= 10 AND x <= 40 AND y >= 10 AND y <= 30 AND NOT (x > 20 AND x < 25 AND y > 15 AND y < 25) THEN 'F0FFFF212' ELSE 'FF0FFF212' END AS relate FROM {_PART}"""
)
def geometry_points(spark, sf_dir):
    """Points and a polygon with a hole: distance, contains, expand, boxes, relate."""
    ring = lambda x0, y0, x1, y1: [geometry.place(p, q) for p, q in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    srid = lambda g: geometry.st_setsrid(g, 4326)
    box, hole = srid(geometry.polygon(ring(10.0, 10.0, 40.0, 30.0), ring(20.0, 15.0, 25.0, 25.0))), srid(geometry.st_makepoint(20.0, 20.0, 5.0))
    whole = srid(geometry.polygon(ring(10.0, 10.0, 40.0, 30.0)))
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")).select("p_partkey", srid(geometry.st_makepoint(c("p_size"), c("p_retailprice") / 50)).alias("g"))
    g = c("g")
    return rows.select(
        "p_partkey", F.round(geometry.st_distance(g, hole), 8).alias("d"), F.round(geometry.st_distance(whole, g), 8).alias("to_box"), geometry.st_contains(box, g).alias("inside"), geometry.geometry_overlaps(geometry.st_expand(whole, 2.0), g).alias("near_box"),
        geometry.geometry_within(g, whole).alias("in_bounds"), geometry.st_relate(g, box).alias("relate"),
    )


@P.plan(f"SELECT p_partkey, y > 20 AND x > 0 AND x < 40 AS crosses, CASE WHEN y > 20 AND x > 0 AND x < 40 THEN -1 ELSE 0 END AS direction, x >= 10 AND x <= 40 AND y > 10 AS cuts, x > 10 AND x < 40 AND y <= 30 AS held, round(CASE WHEN y >= 20 AND x <= 40 THEN 0 WHEN y < 20 AND x <= 40 THEN 20 - y WHEN y >= 20 THEN x - 40 ELSE sqrt(power(x - 40, 2) + power(20 - y, 2)) END, 8) AS far FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_partkey % 37 + 0.5 AS y FROM part) t WHERE x > 0 AND x <> 10 AND x <> 40")
def geometry_lines(spark, sf_dir):
    """Lines upwards from the axis against a level line and a box: crosses, direction, contains, distance."""
    x, y = c("x"), c("y")
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", c("p_size").cast("double").alias("x"), (c("p_partkey") % 37 + 0.5).cast("double").alias("y")).filter((x > 0) & (x != 10) & (x != 40)))
    level = geometry.line([geometry.place(0.0, 20.0), geometry.place(40.0, 20.0)])
    box = geometry.polygon([geometry.place(p, q) for p, q in ((10.0, 10.0), (40.0, 10.0), (40.0, 30.0), (10.0, 30.0), (10.0, 10.0))])
    up = rows.select("p_partkey", geometry.line([geometry.place(x, 0.0), geometry.place(x, y)]).alias("up"), geometry.line([geometry.place(x, F.least(y, F.lit(30.0))), geometry.place(x, F.greatest(y, F.lit(10.0)))]).alias("upper"), geometry.line([geometry.place(x, 10.0), geometry.place(x, F.greatest(y, F.lit(10.5)))]).alias("stem"), "y")
    return up.select("p_partkey", geometry.st_crosses(c("up"), level).alias("crosses"), geometry.st_linecrossingdirection(level, c("up")).alias("direction"), geometry.st_crosses(c("up"), box).alias("cuts"), geometry.st_contains(box, c("stem")).alias("held"), F.round(geometry.st_distance(c("up"), level), 8).alias("far"))


@P.plan(
    """SELECT s_suppkey, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM (SELECT p_partkey, p_size + 0.25 AS x, p_partkey % 50 + 0.25 AS y FROM part) p JOIN (SELECT s_suppkey, s_suppkey % 40 AS a, s_suppkey * 7 % 40 AS b, 5 + s_suppkey % 6 AS w FROM supplier) s
ON x > a AND y > b AND x + y - a - b < w GROUP BY s_suppkey"""
)
def spatial_join_polygons(spark, sf_dir):
    """Points in triangles, counted: a grid join of the boxes, then the polygons themselves."""
    points = table(spark, sf_dir, "part").select("p_partkey", geometry.st_makepoint(c("p_size") + 0.25, c("p_partkey") % 50 + 0.25).alias("g"))
    a, b, w = c("s_suppkey") % 40, c("s_suppkey") * 7 % 40, c("s_suppkey") % 6 + 5
    triangle = geometry.polygon([geometry.place(p, q) for p, q in ((a, b), (a + w, b), (a, b + w), (a, b))])
    shapes = table(spark, sf_dir, "supplier").select("s_suppkey", triangle.alias("t"))
    found = joins.spatial_sums(shapes, points, "t", "g", geometry.st_contains, 8.0, {"n": F.lit(1), "keys": c("p_partkey")})
    return found.groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))


_SQUARES = "(SELECT s_suppkey, s_suppkey % 23 * 2.0 AS x, s_suppkey * 7 % 19 * 2.0 AS y, 0.5 + s_suppkey % 3 AS w FROM supplier)"


@P.plan(f"SELECT a.s_suppkey AS one, b.s_suppkey AS two FROM {_SQUARES} a JOIN {_SQUARES} b ON a.s_suppkey < b.s_suppkey AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.w AND b.y <= a.y + a.w")
def spatial_join_shapes(spark, sf_dir):
    """Shapes that meet shapes: each pair once, whatever cells they share."""
    x, y, w = c("s_suppkey") % 23 * 2.0, c("s_suppkey") * 7 % 19 * 2.0, c("s_suppkey") % 3 + 0.5
    square = geometry.polygon([geometry.place(p, q) for p, q in ((x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y))])
    one = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("one"), square.alias("g"))
    two = one.select(c("one").alias("two"), c("g").alias("h"))
    return joins.spatial_join(one, two, "g", "h", geometry.intersects, 4.0).filter("one < two").select("one", "two")


# ---- half floats ---------------------------------------------------------------------------------
def _half(x: str) -> str:
    unit = f"power(2.0, greatest(floor(log2(CASE WHEN abs({x}) > 0 THEN abs({x}) ELSE 1 END)), -14) - 10)"
    return f"CASE WHEN round_even(abs({x}) / {unit}, 0) * {unit} >= 65520 THEN 'inf'::DOUBLE ELSE round_even(abs({x}) / {unit}, 0) * {unit} END * sign({x})"


@P.plan(f"SELECT l_returnflag AS g, count(h) AS n, sum(h) AS s, min(h) AS lo, max(h) AS hi, round(avg(h), 8) AS av, round(stddev_samp(h), 6) AS sd, round(var_pop(h), 6) AS vp, count(CASE WHEN h > k THEN 1 END) AS gt, count(CASE WHEN h = k THEN 1 END) AS eq FROM (SELECT l_returnflag, {_half('l_tax')} AS h, {_half('l_discount')} AS k FROM lineitem) t GROUP BY l_returnflag")
def float2_aggregates(spark, sf_dir):
    """Aggregates and comparisons of half-precision values."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", arith.float2(c("l_tax")).cast("double").alias("h"), arith.float2(c("l_discount")).cast("double").alias("k"))
    h = c("h")
    return rows.groupBy(c("l_returnflag").alias("g")).agg(F.count(h).alias("n"), F.sum(h).alias("s"), F.min(h).alias("lo"), F.max(h).alias("hi"), F.round(F.avg(h), 8).alias("av"), F.round(F.stddev_samp(h), 6).alias("sd"), F.round(F.var_pop(h), 6).alias("vp"), _count(h > c("k"), "gt"), _count(h == c("k"), "eq"))


# ---- JSON, text input, domains -----------------------------------------------------------------------
@P.plan("SELECT event_id, CAST(user_id AS VARCHAR) AS dotted, CAST(event_id AS VARCHAR) AS inner_b, event_type AS odd, CAST(NULL AS VARCHAR) AS none FROM events")
def json_odd_keys(spark, sf_dir):
    """Keys with dots and quotes are keys, not paths."""
    doc = F.concat(F.lit('{"a.b":'), c("user_id").cast("string"), F.lit(',"a":{"b":'), c("event_id").cast("string"), F.lit('},"it\'s":"'), c("event_type"), F.lit('"}'))
    rows = table(spark, sf_dir, "events").select("event_id", doc.alias("d"))
    return rows.select("event_id", nested.json_ref(c("d"), "a.b").alias("dotted"), nested.json_ref(nested.json_ref(c("d"), "a"), "b").alias("inner_b"), nested.json_ref(c("d"), "it's").alias("odd"), nested.json_ref(c("d"), "b").alias("none"))


@P.plan("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12, 2)) AS n, o_orderkey % 2048 AS h, o_orderkey % 256 = 7 AS hit FROM orders")
def text_input(spark, sf_dir):
    """Text read as numeric, half float and network address."""
    k = c("o_orderkey")
    host = nested.inet(F.concat(F.lit("10.0.0."), (k % 256).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.trim(F.concat(F.lit("  "), c("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit(" "))).cast("decimal(12,2)").alias("n"), arith.float2((k % 2048).cast("string").cast("float")).cast("long").alias("h"), (nested.inet_compare(host, nested.inet(F.lit("10.0.0.7"))) == 0).alias("hit"))


@P.plan("SELECT l_linenumber AS k, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_linenumber")
def domain_check(spark, sf_dir):
    """A domain over a type: values that break its constraint are an error, nulls pass."""
    positive = lambda x: arith.guard(x > 0, x, "value for domain positive violates check constraint")
    return table(spark, sf_dir, "lineitem").groupBy(positive(c("l_linenumber")).alias("k")).agg(F.count("*").alias("n"), F.round(F.sum(positive(c("l_quantity"))), 2).alias("q"))


# ---- user functions ------------------------------------------------------------------------------------
@P.plan("SELECT c_mktsegment, round(exp(avg(ln(abs(c_acctbal) + 1))), 6) AS mean FROM customer GROUP BY c_mktsegment")
def udaf_geometric(spark, sf_dir):
    """A user's aggregate in Python: partial states per task in Arrow batches, merged after a small shuffle."""

    def partial(batches):
        for frame in batches:
            logs = (frame["c_acctbal"].abs() + 1).map(math.log)
            state = logs.groupby(frame["c_mktsegment"]).agg(["sum", "count"]).reset_index()
            yield state.set_axis(["c_mktsegment", "s", "n"], axis=1)

    @F.pandas_udf(T.DoubleType())
    def finish(s: pd.Series, n: pd.Series) -> float:
        return float(math.exp(s.sum() / n.sum()))

    states = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal").mapInPandas(partial, "c_mktsegment string, s double, n bigint")
    return states.groupBy("c_mktsegment").agg(F.round(finish("s", "n"), 6).alias("mean"))


@P.plan("SELECT n_name, i, i * n_regionkey AS product FROM (SELECT n_name, n_regionkey, unnest(range(n_regionkey + 1)) AS i FROM nation) t")
def udtf_python(spark, sf_dir):
    """A user's table function in Python, laterally joined."""

    @F.udtf(returnType="i bigint, product bigint")
    class Multiples:
        def eval(self, k: int):
            for i in range(k + 1):
                yield i, i * k

    spark.udtf.register("quern_multiples", Multiples)
    return spark.sql("SELECT n_name, m.i, m.product FROM {nation}, LATERAL quern_multiples(n_regionkey) m", nation=table(spark, sf_dir, "nation"))


@P.plan("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 200000 AND o_orderkey % 3 = 0 GROUP BY o_orderpriority")
def udf_barrier(spark, sf_dir):
    """Native predicates run in the scan; what a Python predicate sees has passed them."""

    @F.pandas_udf(T.BooleanType())
    def third(k: pd.Series) -> pd.Series:
        return k % 3 == 0

    return table(spark, sf_dir, "orders").filter((c("o_totalprice") > 200000) & third("o_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


# ---- what a sketch can promise ---------------------------------------------------------------------------
@P.plan("SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS within FROM lineitem GROUP BY l_returnflag")
def approx_distinct_within(spark, sf_dir):
    """The sketch's estimate lies within five standard errors of the exact count."""
    # repeated values don't change a sketch; beside a distinct count it would be kept for each of them
    different = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey").distinct()
    rows = different.groupBy("l_returnflag").agg(F.count("l_partkey").alias("exact"), F.approx_count_distinct("l_partkey", 0.01).alias("estimate"))
    return rows.select("l_returnflag", "exact", (F.abs(c("estimate") - c("exact")) <= 0.05 * c("exact") + 1).alias("within"))


QUERIES, ORACLES = P.queries, P.oracles
