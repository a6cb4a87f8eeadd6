import pytest
from pyspark.sql import types as T

from quernstone.llm.common import ship

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
WORDS = "the and of river stone light under garden winter music bread silver morning forest letter window yellow paper seven dream quiet engine market travel branch copper".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", str(rng.randint(0, 99))]) for _ in range(n))


#: The rows that every operator must bear: nulls, empties, blanks, a very long text, copies, repeated rows.
HARD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n\x0b\x0c\r ", None, None, 8), (4, "one", "en", "a", 3), (None, "no id but some text here", "xx", "a", 24),
    (5, prose(5, 30_000), "en", "hot", None), (6, prose(6, 60), "de", "hot", None), (7, prose(6, 60), "de", "hot", None), (8, prose(8, 40), "fr", "hot", None), (8, prose(8, 40), "fr", "hot", None),
    (9, "\xa0 é ü 日本語 ​ \U0001f600 end", "es", "b", None), (10, "a\n\nb\n \na\r\nb", "en", "b", None),
]


@pytest.fixture(scope="session")
def hard(spark):
    ship(spark)
    # columns whose names the operators use inside
    return spark.createDataFrame(HARD, SCHEMA).selectExpr("*", "1 AS n", "2 AS tokens", "3 AS shard", "'x' AS words", "4 AS block", "5 AS rep", "6 AS piece", "7 AS item_id", "8 AS score")


@pytest.fixture(scope="session")
def none(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """The small driver tables."""
    ship(spark)
    d = "/root/testdata/sf0.001"
    return {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "pages", "benchmark")}
