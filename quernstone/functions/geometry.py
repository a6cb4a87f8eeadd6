"""Plane geometry with PostGIS semantics, as built-in expressions.

A geometry is struct<kind, rings, srid>: ``kind`` is point, line or polygon,
``rings`` an array of arrays of struct<x, y, z, m> (a point and a line have one;
a polygon its shell, closed, then its holes).  Predicates read x and y only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.arith import guard

POINT, LINE, POLYGON = "point", "line", "polygon"


def _double(v: Column | float | None) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("double")


def place(x: Column | float, y: Column | float, z: Column | float | None = None, m: Column | float | None = None) -> Column:
    return F.struct(_double(x).alias("x"), _double(y).alias("y"), _double(z).alias("z"), _double(m).alias("m"))


def _geometry(kind: str, rings: Column, srid: int = 0) -> Column:
    return F.struct(F.lit(kind).alias("kind"), rings.alias("rings"), F.lit(srid).alias("srid"))


def st_makepoint(x: Column | float, y: Column | float, z: Column | float | None = None, m: Column | float | None = None) -> Column:
    return _geometry(POINT, F.array(F.array(place(x, y, z, m))))


def line(places: list[Column] | Column) -> Column:
    return _geometry(LINE, F.array(F.array(*places) if isinstance(places, list) else places))


def polygon(*rings: list[Column] | Column) -> Column:
    return _geometry(POLYGON, F.array(*[F.array(*r) if isinstance(r, list) else r for r in rings]))


def st_setsrid(g: Column, srid: Column | int) -> Column:
    return g.withField("srid", (F.lit(srid) if isinstance(srid, int) else srid).cast("int"))


def _same_srid(a: Column, b: Column, value: Column) -> Column:
    return guard(a["srid"] == b["srid"], value, "operation on mixed SRID geometries")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates a value once and names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- bounding boxes: struct<xmin, ymin, xmax, ymax>, as of single-precision boxes without their rounding ----
def box2df(g: Column) -> Column:
    every = F.flatten(g["rings"])
    side = lambda f, k: f(F.transform(every, lambda p: p[k]))
    return F.struct(side(F.array_min, "x").alias("xmin"), side(F.array_min, "y").alias("ymin"), side(F.array_max, "x").alias("xmax"), side(F.array_max, "y").alias("ymax"))


def box_overlaps(a: Column, b: Column) -> Column:
    """a && b of boxes."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def box_contains(a: Column, b: Column) -> Column:
    """a ~ b of boxes."""
    return (a["xmin"] <= b["xmin"]) & (a["ymin"] <= b["ymin"]) & (a["xmax"] >= b["xmax"]) & (a["ymax"] >= b["ymax"])


def geometry_overlaps(a: Column, b: Column) -> Column:
    """a && b: their boxes share a place."""
    return _same_srid(a, b, box_overlaps(box2df(a), box2df(b)))


def geometry_contains(a: Column, b: Column) -> Column:
    """a ~ b: a's box holds b's."""
    return _same_srid(a, b, box_contains(box2df(a), box2df(b)))


def geometry_within(a: Column, b: Column) -> Column:
    """a @ b."""
    return geometry_contains(b, a)


def st_expand(g: Column, d: Column | float) -> Column:
    """The box of a geometry, larger by d on each side, as a polygon."""
    d = _double(d)

    def build(b: Column) -> Column:
        x0, y0, x1, y1 = b["xmin"] - d, b["ymin"] - d, b["xmax"] + d, b["ymax"] + d
        return F.array(F.array(place(x0, y0), place(x0, y1), place(x1, y1), place(x1, y0), place(x0, y0)))

    return F.struct(F.lit(POLYGON).alias("kind"), let(box2df(g), build).alias("rings"), g["srid"].alias("srid"))


# ---- segments ------------------------------------------------------------------
def _segments(g: Column) -> Column:
    """array<struct<a, b>> of all lines and rings; a point is a segment of no length."""
    of_ring = lambda r: F.when(F.size(r) > 1, F.transform(F.slice(r, F.lit(2), F.size(r)), lambda p, i: F.struct(r[i].alias("a"), p.alias("b")))).otherwise(F.transform(r, lambda p: F.struct(p.alias("a"), p.alias("b"))))
    return F.flatten(F.transform(g["rings"], of_ring))


def _side(a: Column, b: Column, p: Column) -> Column:
    """Sign of the turn a -> b -> p: 1 left, -1 right, 0 on the line."""
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def _on(a: Column, b: Column, p: Column) -> Column:
    """p lies on the segment."""
    return (_side(a, b, p) == 0) & p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def _crossing(s: Column, t: Column) -> Column:
    """Two segments cross in a place inside of both."""
    return (_side(s["a"], s["b"], t["a"]) * _side(s["a"], s["b"], t["b"]) < 0) & (_side(t["a"], t["b"], s["a"]) * _side(t["a"], t["b"], s["b"]) < 0)


def _near(s: Column, t: Column) -> Column:
    """The boxes of two segments share a place, without which the segments don't."""
    apart = lambda k: (F.greatest(s["a"][k], s["b"][k]) < F.least(t["a"][k], t["b"][k])) | (F.greatest(t["a"][k], t["b"][k]) < F.least(s["a"][k], s["b"][k]))
    return ~(apart("x") | apart("y"))


def _meet(s: Column, t: Column) -> Column:
    """Two segments share a place."""
    return _near(s, t) & (_crossing(s, t) | _on(s["a"], s["b"], t["a"]) | _on(s["a"], s["b"], t["b"]) | _on(t["a"], t["b"], s["a"]) | _on(t["a"], t["b"], s["b"]))


def _to_segment(a: Column, b: Column, p: Column) -> Column:
    """Distance of a place from a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.when(size > 0, size)))).otherwise(F.lit(0.0))
    return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)


def _pairs(a: Column, b: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Whether any segment of a and any of b pass a test."""
    return let(_segments(b), lambda of_b: F.exists(_segments(a), lambda s: F.exists(of_b, lambda t: test(s, t))))


# ---- places and polygons -----------------------------------------------------------
def location(g: Column, p: Column) -> Column:
    """1 inside of a polygon, 0 on its boundary, -1 outside (or in a hole)."""

    def odd(ring: Column) -> Column:
        edges = F.transform(F.slice(ring, F.lit(2), F.size(ring)), lambda q, i: F.struct(ring[i].alias("a"), q.alias("b")))
        crosses = lambda e: ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & (F.when(e["b"]["y"] > e["a"]["y"], _side(e["a"], e["b"], p)).otherwise(-_side(e["a"], e["b"], p)) > 0)
        return F.size(F.filter(edges, crosses)) % 2

    edge = F.exists(_segments(g), lambda s: _on(s["a"], s["b"], p))
    inside = F.aggregate(F.transform(g["rings"], odd), F.lit(0), lambda n, x: n + x) % 2 == 1
    return F.when(edge, 0).when(inside, 1).otherwise(-1)


def _first(g: Column) -> Column:
    return g["rings"][0][0]


def intersects(a: Column, b: Column) -> Column:
    """The two share a place."""
    held = lambda g, h: (g["kind"] == POLYGON) & (location(g, _first(h)) >= 0)
    return _same_srid(a, b, _pairs(a, b, _meet) | held(a, b) | held(b, a))


def st_distance(a: Column, b: Column) -> Column:
    """Least distance of two geometries; 0 where they meet."""
    ends = lambda s, t: F.least(_to_segment(s["a"], s["b"], t["a"]), _to_segment(s["a"], s["b"], t["b"]), _to_segment(t["a"], t["b"], s["a"]), _to_segment(t["a"], t["b"], s["b"]))
    least = let(_segments(b), lambda of_b: F.array_min(F.flatten(F.transform(_segments(a), lambda s: F.transform(of_b, lambda t: ends(s, t))))))
    return F.when(intersects(a, b), F.lit(0.0)).otherwise(least)


def st_dwithin(a: Column, b: Column, d: Column | float) -> Column:
    return st_distance(a, b) <= _double(d)


def _middle(s: Column) -> Column:
    return place((s["a"]["x"] + s["b"]["x"]) / 2, (s["a"]["y"] + s["b"]["y"]) / 2)


def _parts(a: Column, b: Column) -> Column:
    """Places in the middle of what b's segments are cut to by the boundary of a."""

    def cut(t: Column, of_a: Column) -> Column:
        dx, dy = t["b"]["x"] - t["a"]["x"], t["b"]["y"] - t["a"]["y"]

        def at(s: Column) -> Column:
            ex, ey = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
            turn = dx * ey - dy * ex
            crossing = ((s["a"]["x"] - t["a"]["x"]) * ey - (s["a"]["y"] - t["a"]["y"]) * ex) / F.when(turn != 0, turn)
            size = dx * dx + dy * dy
            ends = F.transform(F.array(s["a"], s["b"]), lambda p: F.when(_on(t["a"], t["b"], p) & (size > 0), ((p["x"] - t["a"]["x"]) * dx + (p["y"] - t["a"]["y"]) * dy) / F.when(size > 0, size)))
            return F.concat(F.array(F.when(_meet(s, t), crossing)), ends)

        stops = F.filter(F.flatten(F.transform(F.filter(of_a, lambda s: _near(s, t)), at)), lambda x: x.isNotNull() & (x > 0) & (x < 1))
        order = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), stops)))
        middle = lambda x, i: (x + order[i]) / 2
        return F.transform(F.transform(F.slice(order, F.lit(2), F.size(order)), middle), lambda m: place(t["a"]["x"] + m * dx, t["a"]["y"] + m * dy))

    return let(_segments(a), lambda found: F.flatten(F.transform(_segments(b), lambda t: cut(t, found))))


def _boundary_ends(g: Column) -> Column:
    """The ends of a line that isn't closed."""
    ring = g["rings"][0]
    first, last = ring[0], F.element_at(ring, -1)
    same = (first["x"] == last["x"]) & (first["y"] == last["y"])
    return F.when(same, F.slice(ring, 1, 0)).otherwise(F.array(first, last))


def _same_place(p: Column, q: Column) -> Column:
    return (p["x"] == q["x"]) & (p["y"] == q["y"])


def st_contains(a: Column, b: Column) -> Column:
    """No place of b lies outside of a, and one lies inside of it (polygons: on the boundary alone isn't contained)."""

    def by_polygon(where: Column) -> Column:
        # all parts of b inside or on the edge; a hole of a that lies in b would leave a part of b outside
        hole = F.exists(F.slice(a["rings"], F.lit(2), F.size(a["rings"])), lambda r: F.exists(r, lambda p: (b["kind"] == POLYGON) & (location(b, p) == 1)))
        return F.forall(where, lambda x: x >= 0) & (F.exists(where, lambda x: x == 1) | (b["kind"] == POLYGON)) & ~hole

    in_polygon = let(F.transform(_parts(a, b), lambda p: location(a, p)), by_polygon)
    on_line = lambda p: F.exists(_segments(a), lambda s: _on(s["a"], s["b"], p))
    ends = F.when(a["kind"] == LINE, _boundary_ends(a)).otherwise(F.slice(a["rings"][0], 1, 0))
    in_line = F.when(b["kind"] == POINT, on_line(_first(b)) & ~F.exists(ends, lambda p: _same_place(p, _first(b)))).when(b["kind"] == LINE, F.forall(_parts(a, b), on_line)).otherwise(F.lit(False))
    same = (b["kind"] == POINT) & _same_place(_first(a), _first(b))
    return _same_srid(a, b, F.when(a["kind"] == POLYGON, in_polygon).when(a["kind"] == LINE, in_line).otherwise(same))


def st_crosses(a: Column, b: Column) -> Column:
    """Lines: they meet in places only, inside of both.  Line and polygon: parts of the line lie inside and outside."""

    def inside_and_out(shape: Column, path: Column) -> Column:
        return let(F.transform(_parts(shape, path), lambda p: location(shape, p)), lambda w: F.exists(w, lambda x: x == 1) & F.exists(w, lambda x: x == -1))

    along = F.exists(_parts(a, b), lambda p: F.exists(_segments(a), lambda s: _on(s["a"], s["b"], p)))
    own = lambda g, p: ~F.exists(_boundary_ends(g), lambda e: _same_place(e, p))
    touch = lambda g, h: F.exists(F.flatten(g["rings"]), lambda p: own(g, p) & own(h, p) & F.exists(_segments(h), lambda s: _on(s["a"], s["b"], p)))
    lines = (_pairs(a, b, _crossing) | touch(a, b) | touch(b, a)) & ~along
    kinds = lambda x, y: (a["kind"] == x) & (b["kind"] == y)
    return _same_srid(a, b, F.when(kinds(LINE, LINE), lines).when(kinds(LINE, POLYGON), inside_and_out(b, a)).when(kinds(POLYGON, LINE), inside_and_out(a, b)).otherwise(F.lit(False)))


def st_relate(a: Column, b: Column) -> Column:
    """The nine-intersection text of a point with a point, line or polygon (either order), and of polygons that don't overlap in part.

    Null for other pairs.
    """
    kinds = lambda x, y: (a["kind"] == x) & (b["kind"] == y)

    def point_in(g: Column, p: Column, turned: bool) -> Column:
        closed = F.size(_boundary_ends(g)) == 0
        edge = F.exists(_boundary_ends(g), lambda e: _same_place(e, p))
        on = F.exists(_segments(g), lambda s: _on(s["a"], s["b"], p))
        end = lambda whole, tail: F.concat(F.lit(whole), F.when(closed, F.lit("F")).otherwise(F.lit("0")), F.lit(tail))
        line_, where = (end("0FFFFF1", "2"), end("FF0FFF1", "2")), location(g, p)
        if turned:
            in_line, at_end, off_line = F.concat(F.lit("0F1FF"), F.when(closed, "F").otherwise("0"), F.lit("FF2")), F.lit("FF10F0FF2"), F.concat(F.lit("FF1FF"), F.when(closed, "F").otherwise("0"), F.lit("0F2"))
            shape = F.when(where == 1, "0F2FF1FF2").when(where == 0, "FF20F1FF2").otherwise("FF2FF10F2")
        else:
            in_line, at_end, off_line = line_[0], F.lit("F0FFFF102"), line_[1]
            shape = F.when(where == 1, "0FFFFF212").when(where == 0, "F0FFFF212").otherwise("FF0FFF212")
        return F.when(g["kind"] == LINE, F.when(edge, at_end).when(on, in_line).otherwise(off_line)).otherwise(shape)

    points = F.when(_same_place(_first(a), _first(b)), "0FFFFFFF2").otherwise("FF0FFF0F2")
    apart = F.when(~intersects(a, b), "FF2FF1212")
    return _same_srid(a, b, F.when(kinds(POINT, POINT), points).when(a["kind"] == POINT, point_in(b, _first(a), False)).when(b["kind"] == POINT, point_in(a, _first(b), True)).when(kinds(POLYGON, POLYGON), apart))


def st_linecrossingdirection(a: Column, b: Column) -> Column:
    """How line b crosses line a: 0 not at all, -1 or 1 once to a's left or right, -2 or 2 several times and ending left or right, -3 or 3 several times and ending on the side it began, first to the left or right."""
    turns = F.flatten(F.transform(_segments(b), lambda t: F.transform(F.filter(_segments(a), lambda s: _crossing(s, t)), lambda s: -_side(s["a"], s["b"], t["b"]).cast("int"))))

    def judge(t: Column) -> Column:
        total, n, first = F.aggregate(t, F.lit(0), lambda x, y: x + y), F.size(t), F.get(t, F.lit(0))
        return F.when(n == 0, 0).when(n == 1, first).when(total == 0, 3 * first).when(F.abs(total) == 1, 2 * total).otherwise(0)

    return let(turns, judge)
