"""What the operators of this subpackage share: table access, checkpoints, words."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space that separates words: space and \x09-\x0D.
WS = "\\x20\\x09-\\x0D"


_shipped: set[str] = set()

#: Documents in a batch that goes to a Python worker: bounds what JVM and worker hold of it.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once per application, and bounds Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    folder = tempfile.mkdtemp(prefix="quernstone-")
    name = os.path.join(folder, "quernstone_src.zip")
    Path(name).write_bytes(data.getvalue())
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader opens the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals an input of fewer partitions than cores to all of them.

    A small file of one row group is one partition, whatever its size; inputs
    with enough partitions stay as they are and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a local session names none (tests) a temporary folder is set; on a
    cluster that is an error.
    """
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quernstone-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Checkpoint folders of this process, in the order they were made.
_made: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts lineage, survives lost executors."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    where = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if where.isDefined():
        _made.append(where.get())
    return out


def made() -> int:
    """A mark for ``forget``."""
    return len(_made)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders that no unread result depends on any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget_since(spark: SparkSession, mark: int) -> None:
    """Removes the checkpoints made since a mark, once what they were made for is written."""
    forget(spark, _made[mark:])
    del _made[mark:]


# ---------------------------------------------------------------- word hashes
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_WS = np.zeros(256, bool)
_IS_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_pow = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k < n (kept, doubled when too short)."""
    if len(_pow["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INV)):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _pow[key] = np.multiply.accumulate(run)
    return _pow["up"][:n], _pow["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are not ASCII white space."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _IS_WS[data], [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased; the same in any process."""
    if not text:
        return np.empty(0, np.uint64)
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    start, end = word_bounds(data)
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words give one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    h = np.full(n, np.uint64(min(len(w), k)))
    for i in range(min(k, len(w))):
        h = mix(h * _BASE + w[i : i + n])
    return np.unique(h)
