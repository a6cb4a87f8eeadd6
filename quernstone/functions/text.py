"""Text functions with PostgreSQL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.arith import guard


def substr(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Places before the first count against the length; a negative length is an error."""
    start = F.lit(start) if isinstance(start, int) else start
    first = F.greatest(start, F.lit(1))
    if length is None:
        return F.substr(s, first, F.lit(2147483647))
    length = F.lit(length) if isinstance(length, int) else length
    rest = F.greatest(length + F.least(start - 1, F.lit(0)), F.lit(0))
    return guard(length >= 0, F.substr(s, first, rest), "negative substring length not allowed")


def bpchar(s: Column) -> Column:
    """char(n): trailing blanks don't take part in comparisons."""
    return F.rtrim(s)


def like_any(s: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | s.like(p)
    return out


def like_all(s: Column, patterns: list[str]) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & s.like(p)
    return out


def attribute(s: Column, key: str, outer: str, inner: str = "=") -> Column:
    """Value of ``key`` in a list like k1=v1;k2=v2 (true for a bare key, null if absent)."""
    parts = F.split(s, f"[{outer}]")
    hit = F.filter(parts, lambda p: (F.substring_index(p, inner, 1) == key))
    return F.when(F.size(hit) > 0, F.when(F.instr(hit[0], inner) > 0, F.substr(hit[0], F.lit(len(key) + 2))).otherwise(F.lit("true")))


def vcf_info(info: Column, key: str) -> Column:
    """Attribute of a VCF INFO field (separator ;)."""
    return attribute(info, key, ";")


def vcf_variant(fmt: Column, value: Column, key: str) -> Column:
    """Attribute of a VCF sample: the part of ``value`` at the place of ``key`` in ``fmt`` (separator :)."""
    at = F.array_position(F.split(fmt, ":"), key)
    return F.when(at > 0, F.get(F.split(value, ":"), (at - 1).cast("int")))
