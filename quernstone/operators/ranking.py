"""Ranking within groups; a filter on the rank becomes a group limit below the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, kind: str = "row_number", name: str = "rn") -> DataFrame:
    rank = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[kind]
    return df.withColumn(name, rank().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col(name) <= k)


def distinct_on(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON (by): the first row of each group in the given order."""
    return top_per_group(df, by, order, 1, name="_first").drop("_first")
