"""Join operators that plain SQL has no good plan for.

All are equi-joins on cells or buckets with an exact recheck, so they shuffle
on a key that spreads, spill like any join and can be split when skewed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions import geometry

#: A side is broadcast only where its measured size is below this.
BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Size that Spark's statistics give for a plan (its files' size, before any filter, at least)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a side for broadcast if its size allows; beyond it, the join shuffles."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def band_join(left: DataFrame, right: DataFrame, key: Column, low: Column, high: Column, width: float) -> DataFrame:
    """Rows of ``left`` whose key lies in [low, high] of a row of ``right``.

    The number line is cut into cells of ``width``; a range is repeated for the
    cells that it touches.
    """
    cells = F.sequence(F.floor(low / width), F.floor(high / width))
    wide = right.withColumn("_cell", F.explode(cells))
    return left.withColumn("_cell", F.floor(key / width)).join(wide, "_cell").filter((key >= low) & (key <= high)).drop("_cell")


def as_of_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, value: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each left row with the latest right value (that isn't null) at or before its time.

    One union and one window: linear, no range join.  ``value`` is added; null
    where nothing came before.  ``bucket`` maps a time to a coarser, monotonic
    number: windows then hold a bucket of a key, not all of a hot key, and the last
    value of earlier buckets is carried in from one row per key and bucket.
    """
    names = left.columns
    number = bucket or (lambda t: F.lit(0))
    a = left.withColumn("_t", F.col(left_time)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(True))
    b = right.select(F.col(on), F.col(right_time).alias("_t"), F.col(value).alias("_v"), F.lit(False).alias("_left"))
    every = a.unionByName(b, allowMissingColumns=True).withColumn("_b", number(F.col("_t")))
    w = Window.partitionBy(on, "_b").orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("_own", F.last("_v", ignorenulls=True).over(w)).filter("_left")
    if bucket is None:
        return found.withColumn(value, F.col("_own")).select(*names, value)
    ends = every.groupBy(on, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_end"))
    before = Window.partitionBy(on).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(on).alias("_on"), F.col("_b").alias("_cb"), F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    joined = found.join(carried, F.col(on).eqNullSafe(F.col("_on")) & (F.col("_b") == F.col("_cb")), "left")
    return joined.withColumn(value, F.coalesce("_own", "_carry")).select(*names, value)


def grid_join(points: DataFrame, boxes: DataFrame, x: Column, y: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column, size: float) -> DataFrame:
    """Points with the boxes that hold them: an equi-join on grid cells, then the exact bounds."""
    cx = F.explode(F.sequence(F.floor(xmin / size), F.floor(xmax / size)))
    wide = boxes.withColumn("_cx", cx).withColumn("_cy", F.explode(F.sequence(F.floor(ymin / size), F.floor(ymax / size))))
    cells = points.withColumn("_cx", F.floor(x / size)).withColumn("_cy", F.floor(y / size))
    return cells.join(wide, ["_cx", "_cy"]).filter((x >= xmin) & (x <= xmax) & (y >= ymin) & (y <= ymax)).drop("_cx", "_cy")


def running_sums(rows: DataFrame, by: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Sums of ``value`` over the rows of a group up to each row, in order.

    ``bucket`` is a number that doesn't fall along the order: windows hold a
    bucket of a group, and the sum of earlier buckets is carried in.
    """
    own = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by, bucket).agg(F.sum(value).alias("_end"))
    carried = ends.select(*by, bucket, F.coalesce(F.sum("_end").over(before), F.lit(0)).alias("_carry"))
    return rows.withColumn(name, F.sum(value).over(own)).join(carried, [*by, bucket]).withColumn(name, F.col(name) + F.col("_carry")).drop("_carry")


#: Buckets that the windows of a sorted column are cut into, by its quantiles.
BUCKETS = 128


def box_counts(points: DataFrame, boxes: DataFrame, x: Column, y: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> DataFrame:
    """The boxes that hold points, with their number ``n``, without making a pair of a box and a point.

    Different values of y are numbered; a point belongs to a block of every size
    1, 2, 4, ... of these numbers, and what lies below a box's side is a sum of
    few blocks.  In a block, points are counted along x up to the box's two
    sides.  So a point or side makes as many rows as the number of values of y
    has bits, at most, whatever the boxes hold.
    """
    sides = ["_x0", "_y0", "_x1", "_y1"]
    places = points.select(x.cast("double").alias("_x"), y.cast("double").alias("_y")).dropna().groupBy("_x", "_y").agg(F.count("*").alias("_n"))
    keyed = boxes.select("*", *[v.cast("double").alias(n) for n, v in zip(sides, (xmin, ymin, xmax, ymax), strict=True)])
    forms = keyed.select(*sides).filter("_x0 <= _x1 AND _y0 <= _y1").distinct()

    def bucket(v: str) -> Callable[[Column], Column]:
        cuts = sorted(set(places.approxQuantile(v, [i / BUCKETS for i in range(1, BUCKETS)], 0.2 / BUCKETS)))
        return lambda e: F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda s: s <= e))

    def turned(rows: DataFrame, low: str, high: str, *others: str) -> DataFrame:
        """Two rows of a box: before points at its lower side (-1), behind those at its upper side (1)."""
        ends = F.array(F.struct(F.lit(-1).alias("_at"), F.col(low).alias("_v")), F.struct(F.lit(1).alias("_at"), F.col(high).alias("_v")))
        return rows.select(*sides, *others, F.explode(ends).alias("_e")).select(*sides, *others, "_e.*")

    # numbers of the values of y, from 1, and of the values below each side
    ys = places.select("_y").distinct()
    levels = ys.count().bit_length()
    in_order = ys.select(F.col("_y").alias("_v"), F.lit(0).alias("_at"), F.lit(1).alias("_one")).unionByName(turned(forms, "_y0", "_y1").withColumn("_one", F.lit(0)), allowMissingColumns=True)
    by_y = running_sums(in_order.withColumn("_b", bucket("_y")(F.col("_v"))).withColumn("_all", F.lit(0)), ["_all"], "_b", ["_v", "_at"], "_one", "_rank")
    of_y = by_y.filter("_at = 0").select(F.col("_v").alias("_y"), (F.col("_rank") - 1).alias("_rank"))

    # blocks: a number's bits, from the highest, name those that lie below it; these have even numbers only
    level = F.explode(F.sequence(F.lit(0), F.lit(max(levels - 1, 0)))).alias("_l")
    shifted = F.expr("shiftright(_rank, _l)")
    held = places.join(of_y, "_y").select("_x", "_n", "_rank", level).filter(shifted % 2 == 0).select("_l", shifted.alias("_k"), F.col("_x").alias("_v"), F.lit(0).alias("_at"), "_n")
    held = held.groupBy("_l", "_k", "_v", "_at").agg(F.sum("_n").alias("_n"))
    below = by_y.filter("_at <> 0").select(*sides, F.col("_at").alias("_sign"), "_rank", level).filter(shifted % 2 == 1).select(*sides, "_sign", "_l", (shifted - 1).alias("_k"))
    asks = turned(below, "_x0", "_x1", "_sign", "_l", "_k").withColumn("_n", F.lit(0).cast("long"))
    along = running_sums(held.unionByName(asks, allowMissingColumns=True).withColumn("_b", bucket("_x")(F.col("_v"))), ["_l", "_k"], "_b", ["_v", "_at"], "_n", "_sum")
    counts = along.filter("_at <> 0").groupBy(*sides).agg(F.sum(F.col("_sum") * F.col("_at") * F.col("_sign")).alias("n")).filter("n > 0")
    return keyed.join(counts, sides).select(*boxes.columns, "n")


def spatial_pairs(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate: Callable[[Column, Column], Column], size: float) -> DataFrame:
    """Pairs of rows of both sides for whose geometries a predicate holds that needs their boxes to meet.

    Both sides are repeated for the grid cells that their boxes touch and joined
    on cells; a pair is looked at only in the cell of the lower left corner of
    what their boxes share, so it comes once; then the exact predicate decides.
    It is asked for every pair of rows: where geometries repeat, ``spatial_join``
    and ``spatial_sums`` ask once for each pair of different ones.
    """

    def spread(df: DataFrame, geom: str, side: str) -> DataFrame:
        boxed = df.withColumn(f"_b{side}", geometry.box2df(F.col(geom)))
        cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(f"_b{side}.{low}") / size), F.floor(F.col(f"_b{side}.{high}") / size)))
        return boxed.withColumn("_cx", cells("xmin", "xmax")).withColumn("_cy", cells("ymin", "ymax"))

    pairs = spread(left, left_geom, "l").join(spread(right, right_geom, "r"), ["_cx", "_cy"])
    low = lambda k: F.floor(F.greatest(F.col(f"_bl.{k}"), F.col(f"_br.{k}")) / size)
    once = geometry.box_overlaps(F.col("_bl"), F.col("_br")) & (F.col("_cx") == low("xmin")) & (F.col("_cy") == low("ymin"))
    return pairs.filter(once).filter(predicate(F.col(left_geom), F.col(right_geom))).drop("_cx", "_cy", "_bl", "_br")


def spatial_join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate: Callable[[Column, Column], Column], size: float) -> DataFrame:
    """Pairs of rows as of ``spatial_pairs``; the predicate is asked once for each pair of different geometries."""
    found = spatial_pairs(left.select(left_geom).distinct(), right.select(right_geom).distinct(), left_geom, right_geom, predicate, size)
    return left.join(found, left_geom).join(right, right_geom).select(*left.columns, *right.columns)


def spatial_sums(shapes: DataFrame, points: DataFrame, shape_geom: str, point_geom: str, predicate: Callable[[Column, Column], Column], size: float, sums: dict[str, Column]) -> DataFrame:
    """The shapes that have points, with sums over these.

    Points of one place are summed before the join and shapes of one form are
    joined once, so no pair of a shape and a point is made where places repeat.
    """
    places = points.groupBy(point_geom).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    found = spatial_pairs(shapes.select(shape_geom).distinct(), places, shape_geom, point_geom, predicate, size)
    return shapes.join(found.groupBy(shape_geom).agg(*[F.sum(n).alias(n) for n in sums]), shape_geom).select(*shapes.columns, *sums)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are spread: the big side draws a salt, the small side is repeated.

    ``how`` is inner, left, left_semi, left_anti, right or full.  Rows of the
    repeated side that match nothing come from an anti join of their own, as
    each of their copies would be unmatched with most salts.
    """
    a = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    b = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    kept = {"right": "inner", "right_outer": "inner", "full": "left", "outer": "left", "full_outer": "left"}.get(how, how)
    joined = a.join(b, [*on, "_salt"], kept).drop("_salt")
    if kept == how:
        return joined
    alone = small.join(big.select(*on).distinct(), on, "left_anti")
    return joined.unionByName(alone.select(*[alone[n] if n in small.columns else F.lit(None).cast(joined.schema[n].dataType).alias(n) for n in joined.columns]))
