"""Deterministic random columns: the same values for the same seed, row and limits, on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions import ranges

def _unit(key: Column, seed: int) -> Column:
    """Uniform in [0, 1): the first 52 bits of the MD5 digest of "key:seed", so any engine can give the same."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def _nulls(value: Column, key: Column, seed: int, percent: float) -> Column:
    return F.when(_unit(key, seed + 7919) * 100 >= percent, value) if percent else value


def random_int(key: Column, seed: int, low: int, high: int, null_percent: float = 0) -> Column:
    return _nulls((F.floor(_unit(key, seed) * (high - low + 1)) + low).cast("long"), key, seed, null_percent)


def random_float(key: Column, seed: int, low: float, high: float, null_percent: float = 0) -> Column:
    return _nulls(_unit(key, seed) * (high - low) + low, key, seed, null_percent)


def random_date(key: Column, seed: int, first: str, days: int, null_percent: float = 0) -> Column:
    return _nulls(F.date_add(F.lit(first).cast("date"), F.floor(_unit(key, seed) * days).cast("int")), key, seed, null_percent)


def random_timestamp(key: Column, seed: int, first: str, seconds: int, null_percent: float = 0) -> Column:
    us = F.floor(_unit(key, seed) * seconds * 1_000_000).cast("long")
    return _nulls(F.timestamp_micros(F.unix_micros(F.lit(first).cast("timestamp")) + us), key, seed, null_percent)


def random_text(key: Column, seed: int, prefix: str, choices: int, null_percent: float = 0) -> Column:
    return _nulls(F.concat(F.lit(prefix), F.floor(_unit(key, seed) * choices).cast("string")), key, seed, null_percent)


def random_inet(key: Column, seed: int, network: str = "192.168", null_percent: float = 0) -> Column:
    part = lambda s: F.floor(_unit(key, seed + s) * 256).cast("int").cast("string")
    return _nulls(F.concat_ws(".", F.lit(network), part(1), part(2)), key, seed, null_percent)


def random_time(key: Column, seed: int, null_percent: float = 0) -> Column:
    """Microseconds of the day."""
    return _nulls(F.floor(_unit(key, seed) * 86_400_000_000).cast("long"), key, seed, null_percent)


def random_timetz(key: Column, seed: int, null_percent: float = 0) -> Column:
    """struct<us, east>: a time of the day in a zone of whole hours."""
    east = (F.floor(_unit(key, seed + 1) * 27) - 12).cast("long") * 3600
    return _nulls(F.struct(F.floor(_unit(key, seed) * 86_400_000_000).cast("long").alias("us"), east.alias("east")), key, seed, null_percent)


def random_text_len(key: Column, seed: int, longest: int, null_percent: float = 0) -> Column:
    """Hexadecimal digits, 1 to ``longest`` of them."""
    n = F.floor(_unit(key, seed) * longest).cast("int") + 1
    digests = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 32).cast("int")), lambda i: F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), i.cast("string")))), "")
    return _nulls(F.substr(digests, F.lit(1), n), key, seed, null_percent)


def random_range(key: Column, seed: int, low: int, high: int, null_percent: float = 0) -> Column:
    """An integer range [a, b) with low <= a <= b <= high (int4range and int8range)."""
    a, b = random_int(key, seed, low, high), random_int(key, seed + 1, low, high)
    return _nulls(ranges.of_ints(F.least(a, b), F.greatest(a, b)), key, seed, null_percent)


def random_tsrange(key: Column, seed: int, first: str, seconds: int, null_percent: float = 0) -> Column:
    a, b = random_timestamp(key, seed, first, seconds), random_timestamp(key, seed + 1, first, seconds)
    return _nulls(ranges.make(F.least(a, b), F.greatest(a, b)), key, seed, null_percent)


def random_macaddr(key: Column, seed: int, null_percent: float = 0) -> Column:
    h = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 12)
    return _nulls(F.concat_ws(":", *[F.substring(h, 2 * i + 1, 2) for i in range(6)]), key, seed, null_percent)
