"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import cut


def forest(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Each vertex's smallest reachable vertex (union by smaller root)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for u, v in pairs:
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a batch, edges become stars around each piece's smallest vertex."""
    for batch in batches:
        root = forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        rows = [(u, v) for u, v in root.items() if u != v]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(v, component) of every vertex of ``edges`` (u, v: long): its smallest reachable vertex.

    Alternating large-star and small-star steps: every step is one combined
    aggregation and one join, edges never multiply, and the number of rounds
    grows with the logarithm of a component's size.  A hub's edges are joined,
    not gathered, so a third of all vertices may hang on one.
    """
    now = cut(edges.mapInArrow(_local, "u bigint, v bigint").filter("u <> v").distinct())
    while True:
        # large star: neighbours above u go to the smallest around u
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each u and its lower neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        # done when every edge points to a vertex that has no edge of its own
        if new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and new.groupBy("u").count().filter("count > 1").isEmpty():
            break
        now = new
    return new.select(F.col("u").alias("v"), F.col("v").alias("component")).union(new.select(F.col("v"), F.col("v").alias("component")).distinct())
