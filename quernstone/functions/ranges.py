"""Ranges with PostgreSQL semantics: struct<lower, upper, lower_inc, upper_inc, empty>, null bounds are infinite.

Discrete ranges (integers, dates) are kept in the canonical form [lower, upper).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.arith import guard


def make(low: Column, high: Column, bounds: str = "[)", step: Callable[[Column], Column] | None = None) -> Column:
    """A range with bounds "[)", "[]", "()" or "(]"; ``step`` gives the next value of a discrete type."""
    low_inc, high_inc = bounds[0] == "[", bounds[1] == "]"
    known = low.isNotNull() & high.isNotNull()
    first = low if step is None or low_inc else step(low)
    last = high if step is None or not high_inc else step(high)
    own_low, own_high = low_inc or step is not None, high_inc and step is None
    both = own_low and own_high
    empty = F.coalesce(first > last if both else first >= last, F.lit(False))
    value = _pack(first, last, F.lit(own_low), F.lit(own_high), empty)
    return guard(~known | (low <= high), value, "range lower bound must be less than or equal to range upper bound")


def _pack(low: Column, high: Column, low_inc: Column, high_inc: Column, empty: Column) -> Column:
    keep = lambda x: F.when(~empty, x)
    return F.struct(
        keep(low).alias("lower"), keep(high).alias("upper"), (~empty & low.isNotNull() & low_inc).alias("lower_inc"), (~empty & high.isNotNull() & high_inc).alias("upper_inc"), empty.alias("empty")
    )


def of_ints(low: Column, high: Column, bounds: str = "[)") -> Column:
    return make(low, high, bounds, lambda x: x + 1)


def of_dates(low: Column, high: Column, bounds: str = "[)") -> Column:
    return make(low, high, bounds, lambda x: F.date_add(x, 1))


# ---- order of bounds ------------------------------------------------------------
def _lower_cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two lower bounds: minus infinity first, an inclusive one before an exclusive one."""
    x, y = a["lower"], b["lower"]
    return F.when(x.isNull() | y.isNull(), y.isNull().cast("int") - x.isNull().cast("int")).when(x < y, -1).when(x > y, 1).otherwise(b["lower_inc"].cast("int") - a["lower_inc"].cast("int"))


def _upper_cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for two upper bounds: plus infinity last, an exclusive one before an inclusive one."""
    x, y = a["upper"], b["upper"]
    return F.when(x.isNull() | y.isNull(), x.isNull().cast("int") - y.isNull().cast("int")).when(x < y, -1).when(x > y, 1).otherwise(a["upper_inc"].cast("int") - b["upper_inc"].cast("int"))


def _ends_before(a: Column, b: Column) -> Column:
    """a's upper bound lies before b's lower bound, no value in both."""
    return F.coalesce((a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"])), F.lit(False))


def _touches(a: Column, b: Column) -> Column:
    """a's upper bound and b's lower bound meet, without a gap or a shared value."""
    return F.coalesce((a["upper"] == b["lower"]) & (a["upper_inc"] != b["lower_inc"]), F.lit(False))


def _filled(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"]


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: an empty range is the least, then by lower, then by upper bound."""
    lower = _lower_cmp(a, b)
    return F.when(a["empty"] | b["empty"], b["empty"].cast("int") - a["empty"].cast("int")).when(lower != 0, lower).otherwise(_upper_cmp(a, b))


# ---- operators --------------------------------------------------------------------
def contains_value(a: Column, v: Column) -> Column:
    """a @> v."""
    low = F.coalesce((a["lower"] < v) | ((a["lower"] == v) & a["lower_inc"]), F.lit(True))
    high = F.coalesce((a["upper"] > v) | ((a["upper"] == v) & a["upper_inc"]), F.lit(True))
    return F.when(v.isNotNull(), ~a["empty"] & low & high)


def contains(a: Column, b: Column) -> Column:
    """a @> b; every range contains the empty one."""
    return b["empty"] | (~a["empty"] & (_lower_cmp(a, b) <= 0) & (_upper_cmp(a, b) >= 0))


def overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return _filled(a, b) & ~_ends_before(a, b) & ~_ends_before(b, a)


def before(a: Column, b: Column) -> Column:
    """a << b (b >> a with the arguments changed)."""
    return _filled(a, b) & _ends_before(a, b)


def not_right_of(a: Column, b: Column) -> Column:
    """a &< b."""
    return _filled(a, b) & (_upper_cmp(a, b) <= 0)


def not_left_of(a: Column, b: Column) -> Column:
    """a &> b."""
    return _filled(a, b) & (_lower_cmp(a, b) >= 0)


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b."""
    return _filled(a, b) & (_touches(a, b) | _touches(b, a))


def _lowest(a: Column, b: Column) -> tuple[Column, Column]:
    first = _lower_cmp(a, b) <= 0
    return F.when(first, a["lower"]).otherwise(b["lower"]), F.when(first, a["lower_inc"]).otherwise(b["lower_inc"])


def _highest(a: Column, b: Column) -> tuple[Column, Column]:
    last = _upper_cmp(a, b) >= 0
    return F.when(last, a["upper"]).otherwise(b["upper"]), F.when(last, a["upper_inc"]).otherwise(b["upper_inc"])


def merge(a: Column, b: Column) -> Column:
    """range_merge: the smallest range that holds both."""
    (low, low_inc), (high, high_inc) = _lowest(a, b), _highest(a, b)
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(_pack(low, high, low_inc, high_inc, F.lit(False)))


def union(a: Column, b: Column) -> Column:
    """a + b; an error if values lie between them."""
    return guard(~_filled(a, b) | overlaps(a, b) | adjacent(a, b), merge(a, b), "result of range union would not be contiguous")


def intersection(a: Column, b: Column) -> Column:
    """a * b."""
    low_last, high_first = _lower_cmp(a, b) >= 0, _upper_cmp(a, b) <= 0
    pick = lambda first, name: F.when(first, a[name]).otherwise(b[name])
    return _pack(pick(low_last, "lower"), pick(high_first, "upper"), pick(low_last, "lower_inc"), pick(high_first, "upper_inc"), ~overlaps(a, b))


def difference(a: Column, b: Column) -> Column:
    """a - b; an error if b lies inside of a and would leave two parts."""
    starts, ends = _lower_cmp(a, b) < 0, _upper_cmp(a, b) > 0
    left = _pack(a["lower"], b["lower"], a["lower_inc"], ~b["lower_inc"], F.lit(False))
    right = _pack(b["upper"], a["upper"], ~b["upper_inc"], a["upper_inc"], F.lit(False))
    none = _pack(a["lower"], a["upper"], a["lower_inc"], a["upper_inc"], F.lit(True))
    value = F.when(~overlaps(a, b), a).when(starts, left).when(ends, right).otherwise(none)
    return guard(~(overlaps(a, b) & starts & ends), value, "result of range difference would not be contiguous")


def lower_inf(a: Column) -> Column:
    return ~a["empty"] & a["lower"].isNull()


def upper_inf(a: Column) -> Column:
    return ~a["empty"] & a["upper"].isNull()
