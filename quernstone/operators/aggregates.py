"""Aggregates with PostgreSQL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_exact(x: Column) -> Column:
    """sum(bigint) is numeric: no overflow."""
    return F.sum(x.cast("decimal(38,0)"))


def avg_exact(x: Column, scale: int = 16) -> Column:
    """avg of integers is numeric."""
    return (F.sum(x.cast("decimal(38,0)")) / F.count(x)).cast(f"decimal(38,{scale})")


def corr(y: Column, x: Column) -> Column:
    """NULL, not an error, where one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x2, y2 = F.when(both, x), F.when(both, y)
    # by the ends: merged partial variances of equal values can be above 0 by their rounding
    one = lambda v: F.max(v).cast("double") - F.min(v).cast("double") == 0
    flat = one(x2) | one(y2)
    return F.when(~flat, F.covar_pop(x, y) / (F.stddev_pop(x2) * F.stddev_pop(y2)))


def filtered(agg, x: Column, where: Column) -> Column:
    """agg(x) FILTER (WHERE where)."""
    return agg(F.when(where, x))


def hll_count(x: Column, error: float = 0.01) -> Column:
    """Approximate number of distinct values."""
    return F.approx_count_distinct(x, error)


def hll_sketch(x: Column) -> Column:
    """A mergeable sketch: per-day sketches can be kept and merged by ``hll_merge``."""
    return F.hll_sketch_agg(x)


def hll_merge(s: Column) -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(s))
