"""All registered queries of the analytics engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.plans import io, matrix, relational, scalar, star, surface, types

MODULES = (star, relational, scalar, matrix, io, surface, types)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        out.update(module.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out.update(module.ORACLES)
    return out
