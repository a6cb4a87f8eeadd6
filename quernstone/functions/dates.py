"""Date and time functions with PostgreSQL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def extract(unit: str, ts: Column) -> Column:
    """EXTRACT(unit FROM timestamp); what Spark lacks or numbers differently is built here."""
    year = F.year(ts).cast("long")
    micros = F.unix_micros(ts.cast("timestamp"))
    if unit == "century":
        return F.ceil(year / F.lit(100.0)).cast("long")
    if unit == "millennium":
        return F.ceil(year / F.lit(1000.0)).cast("long")
    if unit == "decade":
        return F.floor(year / F.lit(10.0)).cast("long")
    if unit == "dow":
        return (F.dayofweek(ts) - 1).cast("long")
    if unit == "isodow":
        return (F.pmod(F.dayofweek(ts) + 5, F.lit(7)) + 1).cast("long")
    if unit == "isoyear":
        return F.extract(F.lit("YEAROFWEEK"), ts).cast("long")
    if unit == "epoch":
        return micros / F.lit(1_000_000.0)
    if unit == "julian":
        return F.datediff(ts, F.lit("1970-01-01").cast("date")) + F.lit(2440588.0) + time_us(ts) / F.lit(float(DAY_US))
    if unit in ("milliseconds", "microseconds"):
        us = F.pmod(micros, F.lit(60_000_000))
        return us / F.lit(1000.0) if unit == "milliseconds" else us
    if unit in ("timezone", "timezone_hour", "timezone_minute"):
        return F.lit(0).cast("long")  # the session zone is UTC
    simple = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "doy": F.dayofyear, "hour": F.hour, "minute": F.minute}
    if unit == "second":
        return F.pmod(micros, F.lit(60_000_000)) / F.lit(1_000_000.0)
    return simple[unit](ts).cast("long")


def time_us(ts: Column) -> Column:
    """Microseconds of the day."""
    return F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(DAY_US))


def time_add(us: Column, delta_us: Column | int) -> Column:
    """time + interval wraps at midnight."""
    return F.pmod(us + (F.lit(delta_us) if isinstance(delta_us, int) else delta_us), F.lit(DAY_US))


def overlaps(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """(a1, a2) OVERLAPS (b1, b2): half-open periods in either order; a point counts as inside."""
    s1, e1, s2, e2 = F.least(a1, a2), F.greatest(a1, a2), F.least(b1, b2), F.greatest(b1, b2)
    return F.when(s1 == s2, F.lit(True)).when(s1 > s2, s1 < e2).otherwise(s2 < e1)


def interval_negate(months: Column, days: Column, us: Column) -> tuple[Column, Column, Column]:
    """-interval: every part by itself."""
    return -months, -days, -us


def date_at_time(day: Column, us: Column) -> Column:
    """date + time is a timestamp."""
    return F.timestamp_micros(F.unix_date(day).cast("long") * F.lit(DAY_US) + us).cast("timestamp_ntz")


# ---- time with a zone: struct<us, east>, microseconds of the local day and seconds east of UTC ----
def timetz(us: Column, east: Column) -> Column:
    return F.struct(us.cast("long").alias("us"), east.cast("long").alias("east"))


def timetz_key(t: Column) -> Column:
    """Orders times with zones: by the moment, then the one further west first."""
    return F.struct((t["us"] - t["east"] * 1_000_000).alias("moment"), (-t["east"]).alias("west"))


def timetz_add(t: Column, delta_us: Column | int) -> Column:
    """timetz + interval wraps at local midnight and keeps its zone."""
    return timetz(time_add(t["us"], delta_us), t["east"])


def timetz_at(t: Column, east: Column | int) -> Column:
    """The same moment in another zone."""
    east = F.lit(east) if isinstance(east, int) else east
    return timetz(F.pmod(t["us"] + (east - t["east"]) * 1_000_000, F.lit(DAY_US)), east)


def date_at_timetz(day: Column, t: Column) -> Column:
    """date + timetz is a timestamp with time zone."""
    return F.timestamp_micros(F.unix_date(day).cast("long") * F.lit(DAY_US) + t["us"] - t["east"] * 1_000_000)


def extract_timetz(unit: str, t: Column) -> Column:
    """EXTRACT from a time with a zone."""
    parts = {
        "hour": F.floor(t["us"] / F.lit(3_600_000_000)), "minute": F.floor(F.pmod(t["us"], F.lit(3_600_000_000)) / F.lit(60_000_000)), "timezone": t["east"],
        "timezone_hour": F.signum(t["east"].cast("double")) * F.floor(F.abs(t["east"]) / 3600), "timezone_minute": F.signum(t["east"].cast("double")) * F.floor(F.pmod(F.abs(t["east"]), F.lit(3600)) / 60),
    }
    if unit in parts:
        return parts[unit].cast("long")
    us = F.pmod(t["us"], F.lit(60_000_000))
    more = {"second": us / F.lit(1_000_000.0), "milliseconds": us / F.lit(1000.0), "microseconds": us, "epoch": (t["us"] - t["east"] * 1_000_000) / F.lit(1_000_000.0)}
    return more[unit]


def date_diff_days(a: Column, b: Column) -> Column:
    """date - date is a number of days."""
    return F.datediff(a, b)


def interval_key(months: Column, days: Column, us: Column) -> Column:
    """Intervals compare with months of 30 days and days of 24 hours."""
    return ((months * 30 + days) * F.lit(DAY_US) + us).cast("decimal(38,0)")
