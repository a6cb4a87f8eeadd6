"""Toxicity: character n-gram linear classifier over naive-Bayes log-count ratios.

Method.  A text is the set of its hashed byte n-grams (lower case, n = 3..7,
over the whole text), each in two grades: it occurs, and it is dense (it recurs,
and often for the text's length).  From labelled texts the log-count ratio of
each graded n-gram between the classes is taken; presences are scaled by these
ratios and a logistic regression is fitted on them.  The two vectors collapse
into one weight per graded n-gram, so a score is one sum over the text's.

The training rows are a bounded sample: ``MAX_TOXIC`` and ``MAX_CLEAN`` rows by the
order of a hash, and of each kind only so many that their texts have MAX_CHARS
characters at most (a row that doesn't fit is left out).  The driver receives the
n-gram numbers of these rows, packed, and unpacks one row at a time; the fit keeps
four bytes for each of a row's chosen n-grams.  Every document is scored in one
narrow pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of the hashed feature space, and the n-gram lengths.
BITS, LENGTHS = 20, (3, 4, 5, 6, 7)
SIZE = 1 << BITS
#: An n-gram is dense with so many places and at least one in so many bytes.
DENSE_PLACES, DENSE_BYTES = 2, 600
#: Bounds of the training sample: rows, and characters of either kind.
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 3000, 8_000_000
#: An n-gram must be in so many training texts, and tell the classes apart so much.
LEAST_TEXTS, LEAST_RATIO = 8, 1.2
EPOCHS, L2 = 120, 1e-2
#: Rows of a step of the fit that are unpacked at once.
FIT_ROWS = 256


def hashes(text: str | None) -> np.ndarray:
    """n-gram numbers of a whole text, in the order of their places, with repeats."""
    if not text:
        return np.empty(0, np.uint32)
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    out, h = [], data
    for n in range(2, LENGTHS[-1] + 1):
        if len(data) < n:
            break
        h = h[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :]
        if n >= LENGTHS[0]:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            out.append(x >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def dense(count: np.ndarray, places: int) -> np.ndarray:
    """Which n-grams are dense, from their counts and the number of all places."""
    return (count >= DENSE_PLACES) & (count * (DENSE_BYTES * len(LENGTHS)) >= places)


def ngrams(text: str | None) -> np.ndarray:
    """Sorted distinct n-gram numbers of a whole text; dense ones again, SIZE higher."""
    h = hashes(text)
    found, count = np.unique(h, return_counts=True)
    return np.concatenate((found, found[dense(count, len(h))] + SIZE)).astype(np.int32)


def encode(grams: np.ndarray) -> bytes:
    """Sorted distinct numbers as compressed differences."""
    return zlib.compress(np.diff(grams, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def decode(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int32)


class Encoded:
    """Encoded sets, decoded one at a time: the driver never holds more than one decoded."""

    def __init__(self, sets: list[bytes]):
        self.sets = sets

    def __len__(self) -> int:
        return len(self.sets)

    def __iter__(self) -> Iterator[np.ndarray]:
        return map(decode, self.sets)


class Weights:
    """A bias and a weight per graded n-gram number; weights travel as two short arrays."""

    def __init__(self, at: np.ndarray, value: np.ndarray, bias: float):
        self.at, self.value, self.bias = at, value, bias


def fit(rows: list[np.ndarray] | Encoded, labels: np.ndarray, prior: float) -> Weights:
    """Weights from labelled n-gram sets; ``prior`` is the share of label 1 among all labelled rows."""
    y = np.asarray(labels, np.float64)
    size = 2 * SIZE
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    none = Weights(np.empty(0, np.int64), np.empty(0, np.float32), float(np.log(prior / (1 - prior))))
    if not len(y) or y.min() == y.max():
        return none
    pos, neg = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for r, label in zip(rows, y, strict=True):
        (pos if label else neg)[r] += 1
    use = np.flatnonzero(pos + neg >= LEAST_TEXTS)
    p, q = (pos[use] + 1.0) / (y.sum() + 2), (neg[use] + 1.0) / (len(y) - y.sum() + 2)
    ratio = np.log(p / q)
    use, r = use[np.abs(ratio) >= LEAST_RATIO], ratio[np.abs(ratio) >= LEAST_RATIO]
    if not len(use):
        return none
    number = np.full(size, -1, np.int32)
    number[use] = np.arange(len(use))
    blocks, held = [], []  # (first row, lengths, feature numbers) of FIT_ROWS rows each
    for k, row in enumerate(rows):
        x = number[row]
        held.append(x[x >= 0])
        if len(held) == FIT_ROWS or k == len(rows) - 1:
            blocks.append((k + 1 - len(held), np.array([len(x) for x in held]), np.concatenate(held)))
            held = []
    w, b = np.ones(len(use)) * 0.05, 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for t in range(1, EPOCHS + 1):
        value, gw, gb = r * w, np.zeros(len(use)), 0.0
        for first, sizes, which in blocks:
            own = slice(first, first + len(sizes))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            z = np.bincount(doc, value[which], len(sizes)) + b
            g = balance[own] * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[own]) / len(y)
            gw += np.bincount(which, g[doc], len(use))
            gb += g.sum()
        gw = r * gw + L2 * w
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        step = 0.02 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (np.sqrt(vb) + 1e-8)
    return Weights(use, (w * r).astype(np.float32), float(b + 0.5 * np.log(prior / (1 - prior))))


class Scorer:
    """Scores texts from the counts of the n-grams that have a weight."""

    def __init__(self, weights: Weights):
        used = np.unique(weights.at % SIZE)
        self.slot = np.full(SIZE, len(used), np.int32)
        self.slot[used] = np.arange(len(used))
        self.value, self.bias = np.zeros((2, len(used))), weights.bias
        self.value[weights.at // SIZE, self.slot[weights.at % SIZE]] = weights.value

    def __call__(self, text: str | None) -> float:
        h = hashes(text)
        count = np.bincount(self.slot[h], minlength=self.value.shape[1] + 1)[:-1]
        at = np.flatnonzero(count)
        z = self.bias + float(self.value[0, at].sum() + self.value[1, at[dense(count[at], len(h))]].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fold(id_col: Column) -> Column:
    """Remainder that decides what is held out: crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Weights:
    """Fits on labelled rows that aren't held out.

    Labels other than 0 and 1, null ids and labels without a document are left
    out; of an id with labels of both kinds the label 1 counts, of an id with
    several texts one of them.  Without two classes the score is the bias.
    """
    usable = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    pick = None
    for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        pick = part if pick is None else pick.unionByName(part)
    # MAX_TOXIC + MAX_CLEAN pairs of numbers at most
    pick = pick.groupBy("doc_id").agg(F.max("y").alias("y"))
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    sizes = source.select("doc_id", F.length("text").alias("n")).join(F.broadcast(pick), "doc_id").groupBy("doc_id", "y").agg(F.max("n").alias("n"))
    left, taken = {0: MAX_CHARS, 1: MAX_CHARS}, []
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # a row per picked document
        if (r["n"] or 0) <= left[r["y"]]:
            left[r["y"]] -= r["n"] or 0
            taken.append((r["doc_id"], r["y"]))
    pick = docs.sparkSession.createDataFrame(taken, T.StructType([T.StructField("doc_id", pick.schema["doc_id"].dataType), T.StructField("y", T.IntegerType())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [encode(ngrams(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["doc_id", "y", "grams"])

    id_type = pick.schema["doc_id"].dataType.simpleString()
    found = source.join(F.broadcast(pick), "doc_id").select("doc_id", "y", "text").mapInArrow(run, f"doc_id {id_type}, y int, grams binary")
    rows = found.groupBy("doc_id", "y").agg(F.min("grams").alias("grams")).select("y", "grams").collect()  # one text of each id
    rows.sort(key=lambda r: (r["y"], r["grams"]))  # the same order, whatever the partitions
    total = max(1, sum(counts.values()))
    return fit(Encoded([r["grams"] for r in rows]), np.array([r["y"] for r in rows]), counts.get(1, 0) / total)


def classify(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every document.

    Null and empty texts have no n-grams and get the score of the bias; null ids
    and repeated rows pass through; an empty table gives no rows; other columns
    are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast((weights.at, weights.value, weights.bias))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(Weights(*held.value))
        for batch in batches:
            scores = [score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    src = docs.select(docs[id_col].alias("doc_id"), (fold(docs[id_col]) == 0).alias("held_out"), docs[text_col].alias("text"))
    return src.mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    return classify(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)


def filtered(docs: DataFrame, weights: Weights, text_col: str = "text") -> DataFrame:
    """The documents, all columns, that score below one half; one narrow pass.

    A null or empty text has the score of the bias, like in ``classify``; ids are
    not read, repeated rows stay or go alike; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast((weights.at, weights.value, weights.bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(Weights(*held.value))
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
