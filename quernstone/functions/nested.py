"""JSON, network address, box and geometry functions as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.arith import guard

# ---- JSON -------------------------------------------------------------------
def json_ref(doc: Column, path: str | int) -> Column:
    """doc ->> key or doc ->> index; an index below zero counts from the end."""
    if isinstance(path, int):
        if path >= 0:
            return F.get_json_object(doc, f"$[{path}]")
        items = F.from_json(doc, "array<string>")
        return F.get(items, F.size(items) + path)
    if set(path) & set("'?*\\") or not path:  # what a quoted step of a path can't hold
        return F.try_element_at(F.from_json(doc, "map<string,string>"), F.lit(path))
    return F.get_json_object(doc, f"$['{path}']")


def json_exists(doc: Column, key: str) -> Column:
    """doc ? key."""
    return F.array_contains(F.json_object_keys(doc), key)


def json_number(doc: Column, path: str | int, kind: str) -> Column:
    """(doc ->> key)::kind, fused."""
    return json_ref(doc, path).cast(kind)


# ---- network addresses (IPv4 and IPv6 as 32 hexadecimal digits and a prefix) -----
def inet(text: Column) -> Column:
    """struct<family, addr (hexadecimal), bits> of an address in text form."""
    host, bits = F.substring_index(text, "/", 1), F.when(F.instr(text, "/") > 0, F.substring_index(text, "/", -1).cast("int"))
    four = F.concat(*[F.lpad(F.lower(F.hex(F.split(host, "[.]")[i].cast("int"))), 2, "0") for i in range(4)])
    head, tail = F.substring_index(host, "::", 1), F.when(F.instr(host, "::") > 0, F.substring_index(host, "::", -1)).otherwise(F.lit(""))
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    left, right = groups(head), groups(tail)
    padded = F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)
    six = F.lower(F.array_join(F.transform(padded, lambda g: F.lpad(g, 4, "0")), ""))
    is_six = F.instr(host, ":") > 0
    family = F.when(is_six, F.lit(6)).otherwise(F.lit(4))
    return F.struct(family.alias("family"), F.when(is_six, six).otherwise(four).alias("addr"), F.coalesce(bits, F.when(is_six, F.lit(128)).otherwise(F.lit(32))).alias("bits"))


def _binary(addr: Column) -> Column:
    """Address digits as a string of bits."""
    return F.array_join(F.transform(F.split(addr, "(?!^)"), lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), "")


def inet_contains(a: Column, b: Column, strict: bool = False) -> Column:
    """a >>= b (or a >> b): b's network lies within a's."""
    same = F.substr(_binary(a["addr"]), F.lit(1), a["bits"]) == F.substr(_binary(b["addr"]), F.lit(1), a["bits"])
    longer = b["bits"] > a["bits"] if strict else b["bits"] >= a["bits"]
    return (a["family"] == b["family"]) & longer & same


def inet_overlaps(a: Column, b: Column) -> Column:
    return inet_contains(a, b) | inet_contains(b, a)


def inet_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by family, by the bits that both networks have, by prefix length, by address."""
    both = F.least(a["bits"], b["bits"])
    x, y = (F.substr(_binary(v["addr"]), F.lit(1), both) for v in (a, b))
    order = lambda p, q: F.when(p < q, -1).when(p > q, 1)
    return F.coalesce(order(a["family"], b["family"]), order(x, y), order(a["bits"], b["bits"]), order(a["addr"], b["addr"]), F.lit(0))


def macaddr(text: Column) -> Column:
    """A hardware address in any usual form, as six lower-case pairs with colons; these compare as the addresses do."""
    digits = F.lower(F.regexp_replace(text, "[^0-9A-Fa-f]", ""))
    return guard(F.length(digits) == 12, F.concat_ws(":", *[F.substring(digits, 2 * i + 1, 2) for i in range(6)]), "invalid input syntax for type macaddr")


def macaddr_trunc(mac: Column) -> Column:
    """Last three bytes set to zero."""
    return F.concat(F.substring(mac, 1, 9), F.lit("00:00:00"))


def uuid(text: Column) -> Column:
    """A UUID in any usual form, as lower-case text with hyphens; these compare as the UUIDs do."""
    d = F.lower(F.regexp_replace(text, "[^0-9A-Fa-f]", ""))
    return guard(F.length(d) == 32, F.concat_ws("-", *[F.substring(d, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), "invalid input syntax for type uuid")


# ---- boxes (cube): struct<ll, ur> of arrays -------------------------------------
def cube(ll: Column, ur: Column) -> Column:
    return F.struct(F.zip_with(ll, ur, lambda a, b: F.least(a, b)).alias("ll"), F.zip_with(ll, ur, lambda a, b: F.greatest(a, b)).alias("ur"))


def cube_contains(a: Column, b: Column) -> Column:
    lo = F.forall(F.zip_with(a["ll"], b["ll"], lambda x, y: x <= y), lambda x: x)
    hi = F.forall(F.zip_with(a["ur"], b["ur"], lambda x, y: x >= y), lambda x: x)
    return lo & hi


def cube_contained(a: Column, b: Column) -> Column:
    return cube_contains(b, a)


def cube_key(a: Column, dims: int = 16) -> Column:
    """Orders cubes as their comparison operators do: lower corners, upper corners (missing coordinates are zero), dimensions."""
    wide = lambda v: F.concat(v, F.array_repeat(F.lit(0.0), F.lit(dims) - F.size(v)))
    return F.struct(wide(a["ll"]).alias("ll"), wide(a["ur"]).alias("ur"), F.size(a["ll"]).alias("dims"))


def cube_ll_coord(a: Column, n: int) -> Column:
    """Zero beyond the dimensions of the cube."""
    return F.coalesce(F.get(a["ll"], F.lit(n - 1)), F.lit(0.0))


def cube_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two points."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


# ---- plane geometry: points as x, y; polygons as arrays of struct<x, y> -------------
def st_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def st_dwithin(x1: Column, y1: Column, x2: Column, y2: Column, d: Column | float) -> Column:
    d = F.lit(d) if isinstance(d, (int, float)) else d
    return st_distance(x1, y1, x2, y2) <= d


def st_contains(ring: Column, x: Column, y: Column) -> Column:
    """A point strictly inside a closed ring (first point repeated at its end), by crossing parity."""
    edges = F.sequence(F.lit(1), F.size(ring) - 1)

    def crosses(i: Column) -> Column:
        a, b = ring[i - 1], ring[i]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edges, crosses)) % 2 == 1


def box2d(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def st_expand(box: Column, d: float) -> Column:
    return F.struct((box["xmin"] - d).alias("xmin"), (box["ymin"] - d).alias("ymin"), (box["xmax"] + d).alias("xmax"), (box["ymax"] + d).alias("ymax"))


def box_overlaps(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def box_contains(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmin"]) & (a["ymin"] <= b["ymin"]) & (a["xmax"] >= b["xmax"]) & (a["ymax"] >= b["ymax"])


def st_crosses_segment(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """-1, 0 or 1: how segment a-b crosses segment c-d (from its right, not at all, from its left)."""
    side = lambda px, py, qx, qy, rx, ry: F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))
    c1, c2 = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)
    a1, a2 = side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    return F.when((c1 * c2 < 0) & (a1 * a2 < 0), c2).otherwise(F.lit(0.0)).cast("int")
