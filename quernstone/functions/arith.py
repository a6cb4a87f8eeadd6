"""Arithmetic and numeric functions with PostgreSQL semantics.

ANSI mode raises on overflow and division by zero; what Spark does differently
from PostgreSQL beyond that is wrapped here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guard(ok: Column, value: Column, message: str) -> Column:
    """``value`` where ``ok`` holds or is null, else an error."""
    return F.when(F.coalesce(ok, F.lit(True)), value).otherwise(F.raise_error(F.lit(message)))


def int_div(a: Column, b: Column) -> Column:
    """Integer division truncates towards zero."""
    wide_a, wide_b = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
    return ((wide_a - wide_a % wide_b) / wide_b).cast("long")


def round_int(x: Column, kind: str = "long") -> Column:
    """Casts of floats to integers round half to even."""
    return F.rint(x).cast(kind)


def dround(x: Column) -> Column:
    """round(double): half to even."""
    return F.rint(x)


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def ln(x: Column) -> Column:
    return guard(x > 0, F.ln(x), "cannot take logarithm of a non-positive number")


def log10(x: Column) -> Column:
    return guard(x > 0, F.log10(x), "cannot take logarithm of a non-positive number")


def sqrt(x: Column) -> Column:
    return guard(x >= 0, F.sqrt(x), "cannot take square root of a negative number")


def power(x: Column, y: Column) -> Column:
    ok = ~((x == 0) & (y < 0)) & ~((x < 0) & (y != F.floor(y)))
    return guard(ok, F.pow(x, y), "invalid argument for power function")


def asin(x: Column) -> Column:
    return guard(F.abs(x) <= 1, F.asin(x), "input is out of range")


def acos(x: Column) -> Column:
    return guard(F.abs(x) <= 1, F.acos(x), "input is out of range")


def exp(x: Column) -> Column:
    return guard(x < 709.78, F.exp(x), "value out of range: overflow")


def float2(x: Column) -> Column:
    """Nearest IEEE half-precision value, as a float: 11 significant bits, half to even."""
    a = F.abs(x.cast("double"))
    scale = F.greatest(F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1.0)))), F.lit(-14)).cast("double")
    unit = F.pow(F.lit(2.0), scale - 10)
    rounded = F.rint(a / unit) * unit
    value = F.when(rounded >= 65520, F.lit(float("inf"))).otherwise(rounded)
    return F.when(F.isnan(x.cast("double")), F.lit(float("nan"))).when(x < 0, -value).otherwise(value).cast("float")


def money(x: Column) -> Column:
    return x.cast("decimal(19,2)")
