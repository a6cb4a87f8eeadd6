"""Scalar functions by family, each over a driver table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import arith, dates, nested, text
from quernstone.plans.base import Plans
from quernstone.session import table

P = Plans()
c = F.col

# ---- numbers -----------------------------------------------------------------------
P.same("arith_ops", "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_tax AS s, l_quantity * l_tax AS m, l_extendedprice / l_quantity AS d, -l_quantity AS neg, abs(l_tax - l_discount) AS ab FROM lineitem")
P.same("bitwise_ops", "SELECT l_orderkey & 255 AS a, l_partkey | 1024 AS o, count(*) AS n FROM lineitem GROUP BY 1, 2")


@P.plan("SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, (-o_orderkey) // 7 AS nq, (-o_orderkey) % 7 AS nr FROM orders")
def int_div_mod(spark, sf_dir):
    """Integer division truncates; the remainder has the dividend's sign."""
    k = c("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", arith.int_div(k, F.lit(7)).alias("q"), (k % 7).alias("r"), arith.int_div(-k, F.lit(7)).alias("nq"), (-k % 7).alias("nr"))


@P.plan("SELECT l_orderkey, l_linenumber, xor(l_orderkey, l_partkey) AS x, ~l_orderkey AS inv, l_linenumber::BIGINT << 3 AS sl, l_orderkey >> 2 AS sr FROM lineitem")
def bitwise_shift(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_orderkey").bitwiseXOR(c("l_partkey")).alias("x"), F.bitwise_not("l_orderkey").alias("inv"), F.shiftleft(c("l_linenumber").cast("long"), 3).alias("sl"), F.shiftright("l_orderkey", 2).alias("sr"))


@P.plan(
    """SELECT l_orderkey, l_linenumber, round(cbrt(l_extendedprice), 8) AS cb, ceil(l_tax * 10) AS ce, floor(l_tax * 10) AS fl, round(exp(l_tax), 10) AS ex, round(ln(l_quantity), 10) AS l, round(log10(l_quantity), 10) AS l10,
round(power(l_quantity, 1.5), 6) AS p, sign(l_tax - 0.04) AS sg, round(sqrt(l_quantity), 10) AS sq, trunc(-l_extendedprice) AS tr, round_even(l_quantity / 2, 0) AS re, round(pi(), 10) AS pi FROM lineitem"""
)
def math_fns(spark, sf_dir):
    q, t, e = c("l_quantity"), c("l_tax"), c("l_extendedprice")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_orderkey", "l_linenumber", F.round(F.cbrt(e), 8).alias("cb"), F.ceil(t * 10).cast("double").alias("ce"), F.floor(t * 10).cast("double").alias("fl"), F.round(arith.exp(t), 10).alias("ex"), F.round(arith.ln(q), 10).alias("l"), F.round(arith.log10(q), 10).alias("l10"),
            F.round(arith.power(q, F.lit(1.5)), 6).alias("p"), F.signum(t - 0.04).cast("int").alias("sg"), F.round(arith.sqrt(q), 10).alias("sq"), arith.trunc(-e).alias("tr"), arith.dround(q / 2).alias("re"), F.round(F.pi(), 10).alias("pi"),
        )
    )


@P.plan(
    """SELECT l_orderkey, l_linenumber, round(degrees(l_tax), 8) AS dg, round(radians(l_quantity), 8) AS rd, round(acos(l_tax), 8) AS ac, round(asin(l_tax), 8) AS sn, round(atan(l_quantity), 8) AS at, round(atan2(l_tax, l_quantity), 8) AS a2,
round(cos(l_quantity), 8) AS cs, round(cot(l_quantity), 6) AS ct, round(sin(l_quantity), 8) AS si, round(tan(l_tax), 8) AS ta FROM lineitem"""
)
def trig_fns(spark, sf_dir):
    q, t = c("l_quantity"), c("l_tax")
    r = lambda x, n, k=8: F.round(x, k).alias(n)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(F.degrees(t), "dg"), r(F.radians(q), "rd"), r(arith.acos(t), "ac"), r(arith.asin(t), "sn"), r(F.atan(q), "at"), r(F.atan2(t, q), "a2"), r(F.cos(q), "cs"), r(F.cot(q), "ct", 6), r(F.sin(q), "si"), r(F.tan(t), "ta"))


@P.plan("SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS h, CAST(round_even(l_extendedprice, 0) AS BIGINT) AS e FROM lineitem")
def round_half_even(spark, sf_dir):
    """Casts of floats to integers round half to even."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arith.round_int(c("l_quantity") / 2).alias("h"), arith.round_int(c("l_extendedprice")).alias("e"))


P.same("casts_numeric", "SELECT o_orderkey, CAST(o_orderkey % 100 AS TINYINT) AS i1, CAST(o_orderkey % 1000 AS SMALLINT) AS i2, CAST(o_orderkey AS INT) AS i4, CAST(o_orderkey AS DOUBLE) AS f8, CAST(o_orderkey % 1000 AS FLOAT) AS f4, CAST(CAST(o_totalprice AS DECIMAL(19, 2)) AS VARCHAR(40)) AS money FROM orders")
P.same("text_to_num", "SELECT n_nationkey, CAST(substring(n_name, 8, 10) AS BIGINT) + 1 AS k, CAST(substring(n_name, 8, 10) AS DOUBLE) / 4 AS d FROM nation")


_UNIT = "power(2.0, greatest(floor(log2(CASE WHEN abs({x}) > 0 THEN abs({x}) ELSE 1 END)), -14) - 10)"
_HALF = "CAST(CASE WHEN round_even(abs({x}) / " + _UNIT + ", 0) * " + _UNIT + " >= 65520 THEN 'inf'::DOUBLE ELSE round_even(abs({x}) / " + _UNIT + ", 0) * " + _UNIT + " END AS FLOAT)"


@P.plan(f"SELECT l_orderkey, l_linenumber, {_HALF.replace('{x}', 'l_extendedprice')} AS half_price, {_HALF.replace('{x}', 'l_tax')} AS half_tax FROM lineitem")
def float2_round(spark, sf_dir):
    """Half-precision rounding (tested against numpy too)."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arith.float2(c("l_extendedprice")).alias("half_price"), arith.float2(c("l_tax")).alias("half_tax"))


# ---- text ------------------------------------------------------------------------------
@P.plan("SELECT doc_id, length(text) AS n, substring(text, 1, 3) AS a, substring(text, 1, 2) AS b, substring(text, 5) AS d, substring(text, 1, 0) AS z FROM documents")
def substr_pg(spark, sf_dir):
    """Places before the first count against the length."""
    t = c("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n"), text.substr(t, 1, 3).alias("a"), text.substr(t, 0, 3).alias("b"), text.substr(t, 5).alias("d"), text.substr(t, -4, 2).alias("z"))


P.same("text_multibyte", "SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(octet_length(text)) AS BIGINT) AS bytes, count(CASE WHEN text LIKE '%é%' THEN 1 END) AS e, count(CASE WHEN text LIKE '%ü_%' THEN 1 END) AS u FROM documents GROUP BY lang", "SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(CASE WHEN text LIKE '%é%' THEN 1 END) AS e, count(CASE WHEN text LIKE '%ü_%' THEN 1 END) AS u FROM documents GROUP BY lang")
P.same("text_compare", "SELECT a.n_name AS a, b.n_name AS b, a.n_name < b.n_name AS lt, a.n_name = b.n_name AS eq, a.n_name >= b.n_name AS ge FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")


@P.plan("SELECT p_brand, count(*) AS n FROM part WHERE rtrim(p_brand || repeat(' ', p_size % 4)) IN ('Brand#1', 'Brand#3', 'Brand#11', 'Brand#23') AND (p_type LIKE 'S%' OR p_type LIKE 'P%') AND p_brand LIKE 'B%' AND p_brand LIKE '%#%' GROUP BY p_brand")
def bpchar_like_sets(spark, sf_dir):
    """char(n) comparison, LIKE ANY and LIKE ALL."""
    padded = text.bpchar(F.concat(c("p_brand"), F.repeat(F.lit(" "), c("p_size") % 4)))
    same = padded.isin(*["Brand#1", "Brand#3", "Brand#11", "Brand#23"])
    return table(spark, sf_dir, "part").filter(same & text.like_any(c("p_type"), ["S%", "P%"]) & text.like_all(c("p_brand"), ["B%", "%#%"])).groupBy("p_brand").agg(F.count("*").alias("n"))


@P.plan("SELECT event_id, CAST(user_id AS VARCHAR) AS dp, event_type AS kind, 'true' AS flag, CAST(NULL AS VARCHAR) AS missing, CAST(user_id AS VARCHAR) AS gq FROM events")
def vcf_attributes(spark, sf_dir):
    """VCF INFO and sample attributes."""
    ev = table(spark, sf_dir, "events")
    info = F.concat(F.lit("DP="), c("user_id").cast("string"), F.lit(";KIND="), c("event_type"), F.lit(";DB"))
    sample = F.concat(F.lit("0|1:"), c("user_id").cast("string"), F.lit(":7"))
    return ev.select("event_id", text.vcf_info(info, "DP").alias("dp"), text.vcf_info(info, "KIND").alias("kind"), text.vcf_info(info, "DB").alias("flag"), text.vcf_info(info, "XX").alias("missing"), text.vcf_variant(F.lit("GT:GQ:HQ"), sample, "GQ").alias("gq"))


# ---- dates ---------------------------------------------------------------------------------
_UNITS = ("century", "decade", "millennium", "year", "quarter", "month", "week", "isoyear", "dow", "isodow", "doy", "day", "hour", "minute")
_EXTRACTS = ", ".join(f"CAST(date_part('{u}', ts) AS BIGINT) AS u_{u}" for u in _UNITS)


@P.plan(f"SELECT event_id, {_EXTRACTS}, date_part('epoch', ts) AS u_epoch, CAST(date_part('microseconds', ts) AS BIGINT) AS u_us, round(julian(ts), 4) AS u_julian, CAST(0 AS BIGINT) AS u_tz FROM events")
def extract_units(spark, sf_dir):
    """EXTRACT for every unit."""
    ts = c("ts")
    units = [dates.extract(u, ts).alias(f"u_{u}") for u in _UNITS]
    return table(spark, sf_dir, "events").select("event_id", *units, dates.extract("epoch", ts).alias("u_epoch"), dates.extract("microseconds", ts).alias("u_us"), F.round(dates.extract("julian", ts), 4).alias("u_julian"), dates.extract("timezone", ts).alias("u_tz"))


@P.plan("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS plus, CAST(o_orderdate AS DATE) - 7 AS minus, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) AS days, date_trunc('month', o_orderdate) AS m, o_orderdate + INTERVAL 1 MONTH AS nm, o_orderdate - INTERVAL 36 HOUR AS h FROM orders")
def date_arith(spark, sf_dir):
    d, ts = c("o_orderdate").cast("date"), c("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_add(d, 30).alias("plus"), F.date_sub(d, 7).alias("minus"), dates.date_diff_days(d, F.lit("1995-01-01").cast("date")).cast("long").alias("days"),
        F.date_trunc("month", ts).cast("timestamp_ntz").alias("m"), (ts + F.expr("INTERVAL '1' MONTH")).alias("nm"), (ts - F.expr("INTERVAL '36' HOUR")).alias("h"),
    )


@P.plan("SELECT event_id, CAST((epoch_us(ts) + 50000000000) % 86400000000 AS BIGINT) AS wrapped, CAST(epoch_us(ts) % 86400000000 AS BIGINT) AS us FROM events")
def time_arith(spark, sf_dir):
    """time + interval wraps at midnight."""
    us = dates.time_us(c("ts"))
    return table(spark, sf_dir, "events").select("event_id", dates.time_add(us, 50_000_000_000).alias("wrapped"), us.alias("us"))


@P.plan("SELECT CAST(sum(CASE WHEN (l_shipdate < o_orderdate + INTERVAL 90 DAY) AND (o_orderdate < l_shipdate + INTERVAL 30 DAY) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def overlaps(spark, sf_dir):
    """(a1, a2) OVERLAPS (b1, b2)."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), c("l_orderkey") == c("o_orderkey"))
    hit = dates.overlaps(c("o_orderdate"), c("o_orderdate") + F.expr("INTERVAL '90' DAY"), c("l_shipdate"), c("l_shipdate") + F.expr("INTERVAL '30' DAY"))
    return j.agg(F.sum(hit.cast("int")).cast("long").alias("n"))


@P.plan("SELECT event_id, CAST((user_id % 5) * 30 + user_id % 40 AS BIGINT) * 86400000000 > 70 * 86400000000 AS longer FROM events")
def interval_compare(spark, sf_dir):
    """Intervals compare by months of 30 days."""
    key = dates.interval_key(c("user_id") % 5, c("user_id") % 40, F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", (key > dates.interval_key(F.lit(2), F.lit(10), F.lit(0))).alias("longer"))


# ---- JSON -----------------------------------------------------------------------------------
@P.plan("SELECT event_id, json_extract_string(props, '$.k') AS t, CAST(json_extract_string(props, '$.k') AS INT) AS i, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 2 AS h, json_extract_string(props, '$.none') AS missing FROM events")
def json_ref(spark, sf_dir):
    p = c("props")
    return table(spark, sf_dir, "events").select("event_id", nested.json_ref(p, "k").alias("t"), nested.json_number(p, "k", "int").alias("i"), (nested.json_number(p, "k", "double") / 2).alias("h"), nested.json_ref(p, "none").alias("missing"))


@P.plan("SELECT event_id, true AS has_k, false AS has_x, CAST(user_id AS VARCHAR) AS first, event_type AS last, CAST(NULL AS VARCHAR) AS beyond FROM events")
def json_arrays(spark, sf_dir):
    """doc ? key, array elements from both ends."""
    arr = F.concat(F.lit("["), c("user_id").cast("string"), F.lit(',"x","'), c("event_type"), F.lit('"]'))
    return table(spark, sf_dir, "events").select("event_id", nested.json_exists(c("props"), "k").alias("has_k"), nested.json_exists(c("props"), "x").alias("has_x"), nested.json_ref(arr, 0).alias("first"), nested.json_ref(arr, -1).alias("last"), nested.json_ref(arr, 9).alias("beyond"))


# ---- network addresses, boxes, geometry ---------------------------------------------------------
@P.plan("SELECT user_id % 256 AS a, event_id % 256 AS b, (user_id % 256) // 16 = 3 AS inside, event_id % 256 < 128 AS half, count(*) AS n FROM events GROUP BY ALL")
def inet_contains(spark, sf_dir):
    """IPv4 and IPv6 networks: >>= by prefix bits."""
    ev = table(spark, sf_dir, "events")
    four = nested.inet(F.concat(F.lit("10.1."), (c("user_id") % 256).cast("string"), F.lit(".7")))
    net4, net6 = nested.inet(F.lit("10.1.48.0/20")), nested.inet(F.lit("2001:db8::/113"))
    low = nested.inet(F.concat(F.lit("2001:db8::"), F.lower(F.hex(c("event_id") % 256 * 256))))
    out = ev.select((c("user_id") % 256).alias("a"), (c("event_id") % 256).alias("b"), nested.inet_contains(net4, four).alias("inside"), nested.inet_contains(net6, low).alias("half"))
    return out.groupBy("a", "b", "inside", "half").agg(F.count("*").alias("n"))


@P.plan("SELECT vec_id, embedding[1] >= -0.2 AND embedding[1] <= 0.2 AND embedding[2] >= -0.2 AND embedding[2] <= 0.2 AS inside, CAST(embedding[1] AS DOUBLE) AS ll, round(sqrt(power(CAST(embedding[1] AS DOUBLE) - embedding[3], 2) + power(CAST(embedding[2] AS DOUBLE) - embedding[4], 2)), 6) AS d FROM embeddings")
def cube_ops(spark, sf_dir):
    """n-dimensional boxes on the first coordinates of the vectors."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    first, second = F.slice(e, 1, 2), F.slice(e, 3, 2)
    lim = lambda v: F.array(F.lit(v), F.lit(v))
    box = nested.cube(lim(0.2), lim(-0.2))
    point = nested.cube(first, first)
    return table(spark, sf_dir, "embeddings").select("vec_id", nested.cube_contains(box, point).alias("inside"), nested.cube_ll_coord(point, 1).alias("ll"), F.round(nested.cube_distance(first, second), 6).alias("d"))


@P.plan("SELECT p_partkey, round(sqrt(power(p_size - 25.0, 2) + power(p_retailprice - 1000.0, 2)), 6) AS dist, sqrt(power(p_size - 25.0, 2) + power(p_retailprice - 1000.0, 2)) <= 200.0 AS near, (p_size + 0.25) + (p_retailprice / 100.0) < 40.0 AS inside, p_size >= 5 AND p_size <= 45 AS in_box FROM part WHERE p_retailprice > 0")
def postgis_points(spark, sf_dir):
    """st_distance, st_dwithin, st_contains and box operators on points."""
    x, y = c("p_size").cast("double"), c("p_retailprice")
    tri = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((-100.0, -100.0), (140.0, -100.0), (-100.0, 140.0), (-100.0, -100.0))])
    box = nested.box2d(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((6.0, -1e9), (44.0, 1e9))]))
    here = F.struct(x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))
    return table(spark, sf_dir, "part").filter("p_retailprice > 0").select(
        "p_partkey", F.round(nested.st_distance(x, y, F.lit(25.0), F.lit(1000.0)), 6).alias("dist"), nested.st_dwithin(x, y, F.lit(25.0), F.lit(1000.0), 200.0).alias("near"),
        nested.st_contains(tri, x + 0.25, y / 100).alias("inside"), nested.box_overlaps(nested.st_expand(box, 1.0), here).alias("in_box"),
    )


@P.plan("SELECT s_suppkey, upper(substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 6)) AS u, '08:00:2b:00:00:00' AS mac FROM supplier")
def uuid_macaddr(spark, sf_dir):
    """Digest text and macaddr truncation."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.upper(F.substring(F.md5(c("s_suppkey").cast("string")), 1, 6)).alias("u"), nested.macaddr_trunc(F.lit("08:00:2b:01:02:03")).alias("mac"))


QUERIES, ORACLES = P.queries, P.oracles
