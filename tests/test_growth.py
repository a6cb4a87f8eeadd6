"""What queries do as tables grow, on small inputs built for it."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import geometry
from quernstone.operators import aggregates, joins


@pytest.fixture
def asked(spark):
    """A predicate that always holds, and how often it was asked."""
    times = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def ask(_):
        times.add(1)
        return True

    return lambda a, b: ask(F.concat(a["kind"], b["kind"])), times


def _points(spark, n, places, key):
    return spark.range(n).select(F.col("id").alias(key), geometry.st_makepoint(F.col("id") % places + 0.5, 0.5).alias(f"{key}_g"))


def test_spatial_sums_ask_once_for_a_place(spark, asked):
    predicate, times = asked
    shapes = _points(spark, 60, 3, "a")
    got = joins.spatial_sums(shapes, _points(spark, 90, 3, "b"), "a_g", "b_g", predicate, 4.0, {"n": F.lit(1), "keys": F.col("b")}).select("a", "n", "keys").collect()
    assert sorted(map(tuple, got)) == [(a, 30, sum(b for b in range(90) if b % 3 == a % 3)) for a in range(60)]
    assert times.value <= 6


def test_spatial_join_asks_once_for_equal_shapes(spark, asked):
    predicate, times = asked
    got = joins.spatial_join(_points(spark, 60, 3, "a"), _points(spark, 90, 3, "b"), "a_g", "b_g", predicate, 4.0)
    assert got.columns == ["a", "a_g", "b", "b_g"]
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(a, b) for a in range(60) for b in range(90) if a % 3 == b % 3]
    assert times.value <= 6


def test_corr_of_a_constant_side_in_several_partitions(spark):
    for n in (49, 98):  # (1 / n) * n isn't 1
        rows = spark.range(0, 2 * n, numPartitions=2).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("one"))
        assert tuple(rows.agg(aggregates.corr(F.col("x"), F.col("one")), aggregates.corr(F.col("one"), F.col("x"))).first()) == (None, None)
        assert round(rows.agg(aggregates.corr(F.col("x"), F.col("x") * 2).alias("r")).first()["r"], 12) == 1.0


def test_box_counts(spark):
    """Against the enumerating join; shared places, places on sides, empty and turned boxes, negative values."""
    k = F.col("id")
    points = spark.range(400).select((k * 37 % 29 - 11).cast("double").alias("x"), (k * 53 % 23 - 9.5).cast("double").alias("y"))
    low = spark.range(300).select(k.alias("box"), (k * 7 % 31 - 12).cast("double").alias("x0"), (k * 11 % 27 - 11.5).cast("double").alias("y0"), (k % 7 - 1).cast("double").alias("w"), (k % 9 - 1).cast("double").alias("h"))
    boxes = low.select("box", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))
    c = F.col
    got = joins.box_counts(points, boxes, c("x"), c("y"), c("x0"), c("y0"), c("x1"), c("y1")).select("box", "n").collect()
    held = lambda p, b: b["x0"] <= p["x"] <= b["x1"] and b["y0"] <= p["y"] <= b["y1"]
    every = points.collect()
    want = [(b["box"], n) for b in boxes.collect() if (n := sum(held(p, b) for p in every))]
    assert sorted(map(tuple, got)) == sorted(want)
    assert joins.box_counts(points.limit(0), boxes, c("x"), c("y"), c("x0"), c("y0"), c("x1"), c("y1")).count() == 0


def test_approx_distinct_within_keeps_one_sketch_a_flag(spark, sf_dir):
    """No sketch is an aggregate of a step that groups by the counted value."""
    from quernstone.plans import registry

    df = registry.queries()["approx_distinct_within"](spark, sf_dir)
    steps = df._jdf.queryExecution().executedPlan().toString().split("\n")
    sketches = [s for s in steps if "approx_count_distinct" in s and "Aggregate(keys" in s]
    assert sketches and all("l_partkey" not in s.partition("keys=[")[2].partition("]")[0] for s in sketches)
    same = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.01).alias("e"))
    once = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.01).alias("e"))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, once.collect()))


@pytest.mark.parametrize("name", ["geometry_points", "geometry_lines"])
def test_geometry_rows_are_dealt_to_all_cores(spark, sf_dir, name):
    from quernstone.plans import registry

    df = registry.queries()[name](spark, sf_dir)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    sizes = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in sizes) < 2 * sum(r["count"] for r in sizes) / spark.sparkContext.defaultParallelism


def test_segments_whose_boxes_touch(spark):
    at = lambda *ps: [geometry.place(float(x), float(y)) for x, y in ps]
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    edge = geometry.line(at((0, 0), (4, 4)))
    assert [one(geometry.intersects(edge, geometry.line(at(*ps)))) for ps in (((4, 4), (8, 0)), ((2, 2), (2, 9)), ((4, 0), (0, 4)), ((3, 2), (4, 3)), ((5, 4), (9, 4)), ((-3, 0), (0, 0)))] == [True, True, True, False, False, True]


def test_many_small_arrow_batches_share_partitions(spark, tmp_path):
    from quernstone.sources import arrow_files

    arrow_files.register(spark)
    path = str(tmp_path / "a")
    spark.range(12_000).coalesce(1).write.format("arrow_files").option("path", path).option("stats", "id").option("batchRows", "10").option("meta.item", ",".join(map(str, range(1200)))).mode("append").save()
    parts = arrow_files.ArrowReader(path, None).partitions()
    assert len(parts) <= arrow_files.PARTITIONS and sum(1 + len(p.more) for p in parts) == 1200
    some = arrow_files.ArrowReader(path, None, where=("or", ("<", "id", 25), (">=", "id", 11_990))).partitions()
    assert [p.number for p in some] == [0, 1, 2, 1199]
    back = spark.read.format("arrow_files").option("split", "item").load(path)
    assert back.rdd.getNumPartitions() == len(parts)
    assert back.filter("cast(item as bigint) = id div 10").count() == back.select("id").distinct().count() == 12_000
    assert arrow_files.packed([(arrow_files.PARTITION_BYTES, parts)])[0].more == ()
