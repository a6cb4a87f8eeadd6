"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix. [native]

Method.  With the rows of each input partition counted, the number of rows that
partition i sends to shard j is drawn from the multivariate hypergeometric law
with the shards' exact sizes as margins: the law that a uniform shuffle of all
rows has.  Each partition permutes its rows and deals them by its row of the
matrix; rows are exchanged; each shard permutes what it received and numbers it.

The second permutation is spread: a shard's rows fall into buckets by the
leading bits of a random key, buckets are numbered in order from their counts
and sorted on their own, so no task ever holds a shard.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.common import cut

#: Rows of the matrix in one Arrow batch: bounds what Python holds unpacked; results don't depend on it.
GROUPS = 4096
#: Rows in a bucket of the second permutation, on average; results don't depend on it.
BUCKET = 8192

_TWO_PI = decimal.Decimal("6.283185307179586476925286766559005768394338798750211641949889")
#: Numerators and denominators of Stirling's series in 1/n, 1/n^3, ...
_STIRLING = ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188), (-691, 360360), (1, 156), (-3617, 122400), (43867, 244188), (-174611, 125400))


def log_factorial(n: int) -> decimal.Decimal:
    """ln n!, off by less than 10^-30 below 10^20."""
    with decimal.localcontext(prec=60):
        if n < 256:
            return decimal.Decimal(math.factorial(n)).ln()
        x = decimal.Decimal(n)
        return (x + decimal.Decimal("0.5")) * x.ln() - x + _TWO_PI.ln() / 2 + sum(decimal.Decimal(a) / (b * x ** (2 * k + 1)) for k, (a, b) in enumerate(_STIRLING))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric draw by one method at any size: ratio of uniforms (HRUA).

    Acceptance compares in double precision; where its rounding could decide, in
    60 digits.  So only the uniforms' 53 bits are between a draw and the law.
    """
    total, less = good + bad, min(good, bad)
    m, more = min(draws, total - draws), total - less
    if not m or not less:
        x = 0
    else:
        share = less / total
        whole, rest = divmod(m * less, total)
        spread = math.sqrt((total - m) * m * share * (1 - share) / (total - 1) + 0.5)
        width = 1.7155277699214135 * spread + 0.8989161620588988
        mode = (m + 1) * (less + 1) // (total + 2)

        def weight(x: int, log=lambda n: math.lgamma(n + 1)):
            return log(x) + log(less - x) + log(m - x) + log(more - m + x)

        top = weight(mode)
        while True:
            u, v = rng.random(), rng.random()
            if not u:
                continue
            x = whole + math.floor(rest / total + 0.5 + width * (v - 0.5) / u)
            if not 0 <= x <= min(m, less):
                continue
            here = weight(x)
            gap = top - here - 2 * math.log(u)
            if abs(gap) <= 1e-14 * (top + here) + 1e-12:  # lgamma is good to 1e-15
                with decimal.localcontext(prec=60):
                    gap = weight(mode, log_factorial) - weight(x, log_factorial) - 2 * decimal.Decimal(u).ln()
            if gap >= 0:
                break
    if good > bad:
        x = m - x
    return good - x if m < draws else x


def matrix_rows(counts: Iterable[int], n: int, shards: int, seed: int) -> Iterator[list[int]]:
    """Rows that each partition sends to each shard, one partition at a time; ``n`` is the sum of ``counts``."""
    rng = np.random.default_rng(seed)
    room = [n // shards + (j < n % shards) for j in range(shards)]
    for count in counts:
        row, left, rest = [], count, sum(room)
        for j in range(shards):
            rest -= room[j]
            x = hypergeometric(rng, room[j], rest, left) if left else 0
            row.append(x)
            left -= x
        room = [a - b for a, b in zip(room, row, strict=True)]
        yield row


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard; shard sizes differ by one at most."""
    return list(matrix_rows(counts, sum(counts), shards, seed))


def shuffle_into_shards(rows: DataFrame, shards: int = 8, seed: int = 20240601) -> DataFrame:
    """All columns of ``rows`` and ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in each shard).

    Nulls, repeated rows and ties need no care: rows are dealt by position.  An
    empty table gives no rows; own columns named ``shard`` or ``slot`` are
    replaced.  The result is the same for the same partitions and seed, and no step
    switches to another method by the number of rows or partitions.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    rows = cut(rows.withColumn("_q_at", F.monotonically_increasing_id()).withColumn("_q_part", F.spark_partition_id()))
    # one number a partition, packed: less than Spark's scheduler holds of it
    parts = rows.groupBy("_q_part").count().toArrow().sort_by("_q_part")
    part, counts = parts["_q_part"].to_numpy(), parts["count"].to_numpy()
    n = int(counts.sum())
    matrix = matrix_rows(map(int, counts), n, shards, seed)
    schema = pa.schema([("_q_part", pa.int32()), ("_q_upto", pa.list_(pa.int64()))])
    packed = []
    for at in range(0, max(1, len(part)), GROUPS):  # an empty table: one empty batch
        block = part[at : at + GROUPS]
        packed.append(pa.record_batch([pa.array(block, pa.int32()), pa.array([np.cumsum(next(matrix)) for _ in block], pa.list_(pa.int64()))], schema=schema))
    deal = spark.createDataFrame(pa.Table.from_batches(packed, schema))
    # local permutation: a sort within the partition, of which the low bits of the running number are the ranks
    rank = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    local = rows.sortWithinPartitions(F.xxhash64("_q_at", F.lit(seed)), "_q_at").withColumn("_q_rank", rank)
    sent = (
        local.join(F.broadcast(deal), "_q_part")  # a row a partition
        .withColumn("shard", F.size(F.filter("_q_upto", lambda c: c <= F.col("_q_rank"))))
        .drop("_q_upto", "_q_rank", "_q_part")
    )
    bits = max(1, math.ceil(math.log2(max(2, n / shards / BUCKET))))
    sent = sent.withColumn("_q_key", F.xxhash64("_q_at", F.lit(seed + 1))).withColumn("_q_bucket", F.shiftrightunsigned("_q_key", 64 - bits))
    before = Window.partitionBy("shard").orderBy("_q_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "_q_bucket").count().select("shard", "_q_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_q_before"))
    own = Window.partitionBy("shard", "_q_bucket").orderBy("_q_key", "_q_at")
    numbered = sent.withColumn("_q_own", F.row_number().over(own) - 1).join(offsets, ["shard", "_q_bucket"])
    names = [c for c in rows.columns if not c.startswith("_q_")]
    return numbered.select(*names, "shard", (F.col("_q_before") + F.col("_q_own")).alias("slot"))


def digest(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every document, without moving its text.

    ``size`` is the UTF-8 length (null: 0) plus 1 and ``text_crc32`` the checksum
    of the text; the law is ``rows``, so ``grown_shard`` is null.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    narrow = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = shuffle_into_shards(narrow, shards)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
