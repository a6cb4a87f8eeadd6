"""Functions whose semantics differ from Spark's own, with expected values by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import arith, dates, geometry, nested, ranges, text
from quernstone.operators import aggregates, joins
from quernstone.sources import arrow_files, delimited, patterns
from quernstone.streaming import tables as stream_tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_int_div_truncates(spark):
    assert [one(spark, arith.int_div(F.lit(a), F.lit(b))) for a, b in ((7, 2), (-7, 2), (7, -2), (2**62, 3))] == [3, -3, -3, 2**62 // 3]


def test_rounds_half_to_even(spark):
    assert [one(spark, arith.round_int(F.lit(x))) for x in (0.5, 1.5, 2.5, -2.5)] == [0, 2, 2, -2]


@pytest.mark.parametrize("bad", [lambda: arith.ln(F.lit(0.0)), lambda: arith.sqrt(F.lit(-1.0)), lambda: arith.asin(F.lit(2.0)), lambda: arith.exp(F.lit(1000.0)), lambda: arith.power(F.lit(0.0), F.lit(-1.0))])
def test_domain_errors(spark, bad):
    with pytest.raises(Exception, match="cannot take|out of range|invalid argument"):
        one(spark, bad())


def test_domain_null(spark):
    assert one(spark, arith.ln(F.lit(None).cast("double"))) is None


def test_float2_like_numpy(spark):
    values = [0.0, 1.0, 0.1, -3.14159, 65504.0, 65519.9, 65520.0, 6e-8, 5.96e-8, 1e-9, 1234.567, 2049.0, 2051.0]
    got = [r["x"] for r in spark.createDataFrame([(v,) for v in values], "v double").select(arith.float2(F.col("v")).alias("x")).collect()]
    with np.errstate(over="ignore"):
        assert got == [float(np.float16(v)) for v in values]


def test_substr_like_postgres(spark):
    s = F.lit("hello")
    assert [one(spark, text.substr(s, a, b)) for a, b in ((0, 3), (-1, 3), (2, 2), (10, 2), (1, 0))] == ["he", "h", "el", "", ""]
    with pytest.raises(Exception, match="negative substring"):
        one(spark, text.substr(s, 1, -1))


@pytest.mark.parametrize("unit,expected", [("century", 21), ("decade", 202), ("millennium", 3), ("dow", 0), ("isodow", 7), ("isoyear", 2024), ("epoch", 1704627000.5)])
def test_extract(spark, unit, expected):
    assert one(spark, dates.extract(unit, F.lit("2024-01-07 11:30:00.5").cast("timestamp_ntz"))) == expected


def test_overlaps_points_and_order(spark):
    d = lambda s: F.lit(s).cast("date")
    a, b, c = d("2020-01-01"), d("2020-02-01"), d("2020-03-01")
    assert one(spark, dates.overlaps(a, b, b, c)) is False
    assert one(spark, dates.overlaps(c, a, b, b)) is True
    assert one(spark, dates.overlaps(a, a, a, a)) is True


def test_json_negative_index(spark):
    assert one(spark, nested.json_ref(F.lit('["a","b","c"]'), -1)) == "c"
    assert one(spark, nested.json_ref(F.lit('["a"]'), -2)) is None


@pytest.mark.parametrize("a,b,strict,expected", [("10.0.0.0/8", "10.1.2.3", False, True), ("10.0.0.0/8", "11.1.2.3", False, False), ("10.0.0.0/8", "10.0.0.0/8", True, False), ("2001:db8::/32", "2001:db8:1::5", False, True), ("::/0", "1.2.3.4", False, False)])
def test_inet(spark, a, b, strict, expected):
    assert one(spark, nested.inet_contains(nested.inet(F.lit(a)), nested.inet(F.lit(b)), strict)) is expected


def test_corr_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.select(aggregates.corr(F.col("y"), F.col("x")).alias("r")).first()["r"] is None


def test_crossing_direction(spark):
    p = [F.lit(float(v)) for v in (0, 0, 2, 0, 1, -1, 1, 1)]
    q = [F.lit(float(v)) for v in (0, 0, 2, 0, 1, 1, 1, -1)]
    assert (one(spark, nested.st_crosses_segment(*p)), one(spark, nested.st_crosses_segment(*q))) == (1, -1)


def test_patterns():
    assert patterns.check_pattern("line_1997_A.parquet", "line_@{year}_${kind}.parquet") == {"year": "1997", "kind": "A"}
    assert patterns.check_pattern("line_x_A.parquet", "line_@{year}_${kind}.parquet") is None
    assert patterns.check_pattern("ab.txt", "?b.*") == {}


def test_delimited_schema_is_strict(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("1\tx\nbad\ty\n")
    with pytest.raises(Exception):
        delimited.read(spark, str(tmp_path / "a.tsv"), "k:int4;v:text").collect()


def test_arrow_statistics_skip_batches(spark, tmp_path):
    arrow_files.register(spark)
    path = str(tmp_path / "a")
    spark.range(10_000).coalesce(1).write.format("arrow_files").option("path", path).option("stats", "id").option("batchRows", "1000").mode("append").save()
    reader = arrow_files.ArrowReader(path, None, [])
    list(reader.pushFilters([arrow_files.GreaterThan(("id",), 8500)]))
    assert [p.number for p in reader.partitions()] == [8, 9]
    assert spark.read.format("arrow_files").option("path", path).load().filter("id > 8500").count() == 1499
    assert any(k == "min_values" for _, _, k, _ in arrow_files.metadata_info(path))


def scanned_rows(df):
    """Rows that the file scan of a plan gives."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        elif p.getClass().getSimpleName() == "FileSourceScanExec":
            found += p.metrics().apply("numOutputRows").value()
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_key_range_skips_row_groups(spark, tmp_path):
    """What the docstrings say: a range on a number skips row groups, one on a zoneless timestamp doesn't."""
    path = str(tmp_path / "t")
    rows = spark.range(100_000).select("id", F.timestamp_micros(F.col("id") * 60_000_000).cast("timestamp_ntz").alias("ts"))
    rows.coalesce(1).write.option("parquet.block.size", 1024).option("parquet.page.row.count.limit", 1000).option("parquet.block.row.count.limit", 1000).parquet(path)
    t = spark.read.parquet(path)
    assert scanned_rows(t.filter("id BETWEEN 5000 AND 5999").groupBy().count()) < 20_000
    ntz = lambda n: F.timestamp_micros(F.lit(n * 60_000_000)).cast("timestamp_ntz")
    assert scanned_rows(t.filter((F.col("ts") >= ntz(5000)) & (F.col("ts") < ntz(6000))).groupBy().count()) == 100_000


def test_flagship_pushes_down(spark, sf_dir):
    from quernstone.plans.star import flagship_revenue

    plan = flagship_revenue(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_returnflag" not in plan and "ReadSchema" in plan


def test_rank_filter_becomes_group_limit(spark, sf_dir):
    from quernstone.plans import relational

    plan = relational.QUERIES["win_rank_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_checked_broadcast(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    assert "broadcast" in joins.checked_broadcast(df)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.checked_broadcast(df, 1)._jdf.queryExecution().logical().toString().lower()


def test_as_of_join_small(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 10, 1)], "k string, t int, v int")
    got = {(r["k"], r["t"]): r["v"] for r in joins.as_of_join(left, right, "k", "t", "t", "v").collect()}
    assert got == {("a", 5): 50, ("a", 1): None, ("b", 9): None}


def test_as_of_join_buckets(spark):
    import random

    rng = random.Random(4)
    lt = [("ab"[rng.randrange(2)], rng.randrange(200), i) for i in range(80)]
    rt = [("ab"[rng.randrange(2)], t, t * 10) for t in rng.sample(range(200), 40)]
    left, right = spark.createDataFrame(lt, "k string, t int, i int"), spark.createDataFrame(rt, "k string, t int, v int")
    got = {r["i"]: r["v"] for r in joins.as_of_join(left, right, "k", "t", "t", "v", bucket=lambda t: F.floor(t / 16)).collect()}
    assert got == {i: max(((b, v) for kk, b, v in rt if kk == k and b <= t), default=(0, None))[1] for k, t, i in lt}


def test_empty_inputs(spark):
    left = spark.createDataFrame([], "k string, t int")
    right = spark.createDataFrame([], "k string, t int, v int")
    assert joins.as_of_join(left, right, "k", "t", "t", "v").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_salted_join_like_plain(spark, how):
    big = spark.createDataFrame([(k % 5, i) for i, k in enumerate(range(40))] + [(None, 99), (77, 98)], "k int, i int")
    small = spark.createDataFrame([(k, f"s{k}{j}") for k in (0, 1, 1, 9, 10) for j in range(2)] + [(None, "n")], "k int, s string")
    want = sorted(map(str, big.join(small, ["k"], how).select(*sorted(big.join(small, ["k"], how).columns)).collect()))
    got = joins.salted_join(big, small, ["k"], 4, how)
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == want


def test_json_keys_are_not_paths(spark):
    doc = F.lit("""{"a.b":1,"a":{"b":2},"x'y":"q","*":5,"":6,"n":null}""")
    assert [one(spark, nested.json_ref(doc, k)) for k in ("a.b", "a", "x'y", "*", "", "n", "b")] == ["1", '{"b":2}', "q", "5", "6", None, None]


def test_vcf_values_and_header(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##fileformat=VCFv4.2\n##source=a=b\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n1\t5\t.\tA\tT\t3.5\tPASS\tX=a=b;DB;X=c;E=\tGT\t0|1\t1|1\n")
    row = delimited.read_vcf(spark, str(tmp_path)).first()
    assert row["attributes"] == {"X": "a=b", "DB": None, "E": ""} and row["samples"] == ["0|1", "1|1"] and row["qual"] == 3.5
    assert sorted((r["key"], r["value"]) for r in delimited.vcf_header(spark, str(tmp_path)).collect()) == [("fileformat", "VCFv4.2"), ("source", "a=b")]
    assert sorted((r["place"], r["name"]) for r in delimited.vcf_samples(spark, str(tmp_path)).collect()) == [(0, "S1"), (1, "S2")]


def test_arrow_statistics_of_all_types(spark, tmp_path):
    """Dates, timestamps, decimals, booleans and text skip batches; NaN hides a bound; results are as without skipping."""
    import datetime
    import decimal

    arrow_files.register(spark)
    path = str(tmp_path / "a")
    cols = ["id", "date_add(date'2020-01-01', cast(id as int)) AS d", "cast(timestamp_micros(id * 1000000) as timestamp_ntz) AS t", "cast(id as decimal(10,2)) AS n", "id >= 500 AS b", "lpad(cast(id as string), 4, '0') AS s", "if(id = 950, double('NaN'), id) AS f", "if(id < 900, null, id) AS u"]
    spark.range(1000).selectExpr(*cols).coalesce(1).write.format("arrow_files").option("path", path).option("stats", "id,d,t,n,b,s,f,u").option("batchRows", "100").mode("append").save()
    day, moment = datetime.date(2020, 1, 1), datetime.datetime(1970, 1, 1)
    for where, batches, rows in (
        ((">", "d", day + datetime.timedelta(799)), [8, 9], 200), (("<", "t", moment + datetime.timedelta(seconds=150)), [0, 1], 150), ((">=", "n", decimal.Decimal("899.5")), [9], 100), (("=", "b", False), [0, 1, 2, 3, 4], 500),
        (("not", ("=", "b", False)), [5, 6, 7, 8, 9], 500), (("starts", "s", "03"), [3], 100), ((">", "f", 880.0), [8, 9], 119 + 0), (("is_null", "u"), list(range(9)), 900), (("not_null", "u"), [9], 100),
        (("or", ("<", "id", 50), ("and", (">", "id", 300), ("<", "id", 320)), ("not", ("<", "id", 990))), [0, 3, 9], 79), (("not", ("or", ("<", "id", 900), (">", "u", 950))), [9], 51), (("<>", "b", True), [0, 1, 2, 3, 4], 500),
    ):
        assert [p.number for p in arrow_files.ArrowReader(path, None, where=where).partitions()] == batches, where
        assert arrow_files.load(spark, path, where).count() == rows, where
    assert spark.read.format("arrow_files").load(path).filter("d > date'2022-03-10' and not b").count() == 0
    assert len(arrow_files.metadata_stats(path)) == 80


def test_arrow_writer_bounds_files(spark, tmp_path):
    arrow_files.register(spark)
    path = str(tmp_path / "a")
    spark.range(50_000).coalesce(1).write.format("arrow_files").option("path", path).option("fileBytes", "100000").option("meta.id.unit", "row").option("meta.who", "me").mode("append").save()
    assert len(arrow_files.files_of(path)) > 2
    back = spark.read.format("arrow_files").option("metadata", "id.unit,who,id.none").option("pathname", "path").load(path)
    assert back.agg(F.count("*"), F.sum("id"), F.count_distinct("path")).first()[:2] == (50_000, 50_000 * 49_999 // 2) and {tuple(r) for r in back.select("`id.unit`", "who", "`id.none`").distinct().collect()} == {("row", "me", None)}
    assert [p.path for p in arrow_files.ArrowReader(path, None, [("who", "file", "who")], where=("=", "who", "you")).partitions()] == [""]


def test_keyed_table_versions(spark, tmp_path):
    t = stream_tables.KeyedTable(str(tmp_path / "t"), ["k"], "at", fold=3)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, at int, v int, op string")
    assert t.read(spark) is None and t.info(spark)["version"] is None
    want = {}
    for epoch in range(10):
        t.apply(rows(("a", epoch, epoch, "put"), (f"k{epoch}", epoch, 1, "put"), (f"k{epoch - 2}", epoch, 0, "delete"), ("a", epoch - 5, -1, "put")), epoch)
        t.apply(rows(("a", 999, 999, "put")), epoch)  # the same epoch again changes nothing
        want["a"], want[f"k{epoch}"] = epoch, 1
        want.pop(f"k{epoch - 2}", None)
        assert {r["k"]: r["v"] for r in t.read(spark).collect()} == want
    info = t.info(spark)
    assert info["base"] and info["deltas"] <= 3 and info["versions"] == 2
    t.truncate(spark)
    assert t.read(spark).count() == 0
    t.apply(rows(("z", 1, 5, "put")), 20)
    assert [(r["k"], r["v"]) for r in t.read(spark).collect()] == [("z", 5)]


def test_ranges_like_postgres(spark):
    i = lambda a, b, s="[)": ranges.of_ints(F.lit(a).cast("int"), F.lit(b).cast("int"), s)
    num = lambda a, b, s: ranges.make(F.lit(a).cast("double"), F.lit(b).cast("double"), s)
    got = lambda e: one(spark, e)
    assert tuple(got(i(1, 5, "[]"))) == (1, 6, True, False, False) and tuple(got(i(3, 3))) == (None, None, False, False, True) and tuple(got(i(3, 4, "()"))) == (None, None, False, False, True)
    assert tuple(got(i(None, 5, "(]"))) == (None, 6, False, False, False)
    with pytest.raises(Exception, match="less than or equal"):
        got(i(5, 1))
    assert got(ranges.contains_value(num(1, 2, "[]"), F.lit(2.0))) is True and got(ranges.contains_value(num(1, 2, "[)"), F.lit(2.0))) is False
    assert got(ranges.adjacent(num(1, 2, "[)"), num(2, 3, "[]"))) is True and got(ranges.adjacent(num(1, 2, "[]"), num(2, 3, "[]"))) is False and got(ranges.adjacent(num(1, 2, "()"), num(2, 3, "()"))) is False
    assert got(ranges.overlaps(num(1, 2, "[]"), num(2, 3, "[]"))) is True and got(ranges.overlaps(num(1, 2, "[)"), num(2, 3, "[]"))) is False
    assert got(ranges.contains(i(1, 5), i(3, 3))) is True and got(ranges.contains(i(3, 3), i(1, 5))) is False and got(ranges.before(i(1, 3), i(3, 5))) is True
    assert got(ranges.compare(i(3, 3), i(None, 1))) == -1 and got(ranges.compare(num(1, 2, "[)"), num(1, 2, "(]"))) == -1 and got(ranges.compare(i(1, None), i(1, 9))) == 1
    assert tuple(got(ranges.difference(i(1, 9), i(5, 20))))[:2] == (1, 5) and tuple(got(ranges.difference(i(1, 9), i(0, 20))))[4] is True
    with pytest.raises(Exception, match="not be contiguous"):
        got(ranges.difference(i(1, 9), i(3, 5)))
    with pytest.raises(Exception, match="not be contiguous"):
        got(ranges.union(i(1, 3), i(5, 9)))
    assert tuple(got(ranges.merge(i(1, 3), i(5, None)))) == (1, None, True, False, False) and got(ranges.upper_inf(i(1, None))) is True
    assert got(ranges.contains_value(i(1, 3), F.lit(None).cast("int"))) is None


def test_geometries(spark):
    at = lambda *ps: [geometry.place(float(x), float(y)) for x, y in ps]
    ring = lambda a, b: at((a, a), (b, a), (b, b), (a, b), (a, a))
    box, holed, small = geometry.polygon(ring(0, 10)), geometry.polygon(ring(0, 10), ring(4, 6)), geometry.polygon(ring(1, 3))
    point = lambda x, y: geometry.st_makepoint(float(x), float(y))
    road = geometry.line(at((-5, 5), (5, 5), (5, 20)))
    got = lambda e: one(spark, e)
    assert [got(geometry.st_contains(g, h)) for g, h in ((box, point(5, 5)), (holed, point(5, 5)), (box, point(0, 5)), (box, small), (holed, small), (small, box), (holed, geometry.polygon(ring(3, 7))), (box, road), (road, point(0, 5)), (road, point(-5, 5)), (box, box))] == [True, False, False, True, True, False, False, False, True, False, True]
    assert [got(geometry.st_crosses(g, h)) for g, h in ((road, box), (box, road), (road, geometry.line(at((0, 0), (0, 9)))), (road, geometry.line(at((0, 5), (0, 9)))), (road, geometry.line(at((-1, 5), (1, 5)))), (road, geometry.line(at((20, 0), (20, 9)))))] == [True, True, True, False, False, False]
    assert [got(geometry.st_relate(g, h)) for g, h in ((point(1, 1), point(1, 1)), (point(5, 5), box), (box, point(0, 3)), (point(0, 5), road), (road, point(-5, 5)), (box, geometry.polygon(ring(20, 30))))] == ["0FFFFFFF2", "0FFFFF212", "FF20F1FF2", "0FFFFF102", "FF10F0FF2", "FF2FF1212"]
    assert [round(got(geometry.st_distance(g, h)), 6) for g, h in ((point(3, 4), point(0, 0)), (box, point(13, 14)), (box, point(5, 5)), (holed, point(5, 5)), (road, geometry.line(at((8, 0), (8, 30)))), (box, geometry.polygon(ring(13, 20))))] == [5.0, 5.0, 0.0, 1.0, 3.0, round(18**0.5, 6)]
    level, zig = geometry.line(at((0, 0), (10, 0))), geometry.line(at((1, -1), (1, 1), (2, -1)))
    assert [got(geometry.st_linecrossingdirection(level, b)) for b in (zig, geometry.line(at((1, -1), (1, 1))), geometry.line(at((1, 1), (1, -1))), geometry.line(at((1, -1), (1, 1), (2, -1), (2.5, 1))), road)] == [-3, -1, 1, -2, 0]
    assert got(geometry.geometry_overlaps(geometry.st_expand(box, 2.0), point(12, 12))) is True and got(geometry.geometry_contains(box, small)) is True and got(geometry.geometry_within(box, small)) is False and got(geometry.st_dwithin(box, point(13, 14), 5.0)) is True
    assert got(geometry.st_makepoint(1.0, 2.0, 3.0, 4.0))["rings"][0][0].asDict() == {"x": 1.0, "y": 2.0, "z": 3.0, "m": 4.0}
    with pytest.raises(Exception, match="mixed SRID"):
        got(geometry.st_contains(geometry.st_setsrid(box, 4326), point(1, 1)))


def test_addresses(spark):
    cmp = lambda a, b: one(spark, nested.inet_compare(nested.inet(F.lit(a)), nested.inet(F.lit(b))))
    assert [cmp("10.0.0.1", "10.0.0.2"), cmp("10.0.0.0/8", "10.0.0.0/16"), cmp("255.0.0.0", "::1"), cmp("10.0.0.1/8", "10.0.0.0/8"), cmp("1.2.3.4", "1.2.3.4/32")] == [-1, -1, -1, 1, 0]
    assert one(spark, nested.macaddr(F.lit("08002B:010203"))) == "08:00:2b:01:02:03"
    for bad in (nested.macaddr(F.lit("08:00")), nested.uuid(F.lit("12"))):
        with pytest.raises(Exception, match="invalid input syntax"):
            one(spark, bad)


def test_time_zones(spark):
    t = lambda h, e: dates.timetz(F.lit(h * 3_600_000_000), F.lit(e * 3600))
    assert one(spark, dates.timetz_key(t(12, 2)) < dates.timetz_key(t(11, 0))) is True and one(spark, dates.timetz_key(t(12, 0)) < dates.timetz_key(t(13, 1))) is False and one(spark, dates.timetz_key(t(13, 1)) < dates.timetz_key(t(12, 0))) is True
    assert one(spark, dates.timetz_at(t(1, 5), 0))["us"] == 20 * 3_600_000_000 and one(spark, dates.extract_timetz("timezone_hour", t(1, -5))) == -5


def test_create_table_text():
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL('`a"b` int NOT NULL, n decimal(9,2), t timestamp_ntz, x array<string>, s struct<k:int>')
    assert delimited.create_table(schema, "t 1") == 'CREATE TABLE "t 1" ("a""b" integer NOT NULL, "n" numeric(9,2), "t" timestamp, "x" text[], "s" jsonb)'
    assert arrow_files.unique_names(["a", "b", "a", "a_1", "a"]) == ["a", "b", "a_2", "a_1", "a_3"]


def test_parquet_cache_sees_changed_files(spark, tmp_path):
    from quernstone.sources.parquet_cache import ParquetCache

    path = str(tmp_path / "p")
    cache = ParquetCache(spark, limit_bytes=10_000_000)
    spark.range(10).selectExpr("id", "id * 2 AS x").write.parquet(path)
    assert cache.read(path, ["x"]).count() == 10 and cache.read(path, ["x"]) is cache.read(path, ["x"]) and len(cache.info()) == 1
    spark.range(5).selectExpr("id", "id * 2 AS x").write.mode("append").parquet(path)
    assert cache.read(path, ["x"]).count() == 15 and len(cache.info()) == 1
    cache.limit = 1
    cache.read(path)
    assert [i[1] for i in cache.info()] == ["*"]
