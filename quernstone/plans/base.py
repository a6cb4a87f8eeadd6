"""How plans are registered: a query in Spark, and the SQL that an oracle runs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.session import pin, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_NAME = re.compile(rf"\b({'|'.join(TABLES)})\b(?!\s*\()")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the driver tables; a table's name in FROM or JOIN stands for its Parquet files."""
    pin(spark)
    used: set[str] = set()

    def place(m: re.Match) -> str:
        used.add(m[2])
        return f"{m[1]}{{{m[2]}}} AS {m[2]}" if not m[3] else f"{m[1]}{{{m[2]}}}{m[3]}"

    body = re.sub(rf"(\b(?:FROM|JOIN)\s+|,\s*)({'|'.join(TABLES)})\b(\s+(?:AS\s+)?(?!WHERE|JOIN|LEFT|RIGHT|FULL|INNER|CROSS|GROUP|ORDER|ON|USING|UNION|EXCEPT|INTERSECT|LIMIT|SEMI|ANTI|HAVING|WINDOW)[a-z]\w*)?(?=[\s,)]|$)", place, text)
    return spark.sql(body, **{name: table(spark, sf_dir, name) for name in used})


class Plans:
    """The queries and oracles of one module."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def same(self, name: str, text: str, oracle: str | None = None) -> None:
        """SQL that both engines read alike, or Spark's text with the oracle's."""
        self.queries[name] = lambda spark, sf_dir, text=text: run_sql(spark, sf_dir, text)
        self.oracles[name] = oracle or text

    def plan(self, oracle: str | None = None):
        """Decorator for a query in the DataFrame API."""

        def add(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(pin(spark), sf_dir)
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return add
