"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Method.  Every 3-word sequence of a test item is a seed.  A first pass counts in
how many documents each occurs; those in few are rare.  Where a rare seed occurs
in a document, the item is aligned with the words around it by Smith-Waterman;
edited and paraphrased copies score by what still agrees in order.  Common seeds
(a passage that thousands of documents copied has no others) take an exact way
round: the words that item and window share bound the score of any alignment,
and only where that bound reaches the least score the two are aligned.  So
rarity decides about cost, never about the result: every window with a seed that
aligns well enough is found.

Items are used in blocks of BLOCK_ITEMS and BLOCK_CHARS at most, or about so (a
hash deals them); a block's tables go to the executors, and each block is two
narrow passes over all documents.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SEED = 3
#: A seed is rare in so many documents at most, or in this share of them.
RARE_DOCS, RARE_SHARE = 20, 1e-4
#: Test items of a block, and their characters.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 4 << 20
#: Alignment: scores, and what counts as a copy (share of the best possible score, words that agree).
MATCH, MISMATCH, GAP = 2, -1, 1
LEAST_SCORE, LEAST_WORDS = 0.5, 8

_PUNCTUATION = string.punctuation.encode()


def words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCTUATION).split() if text else []


class Items:
    """Tables of a block of test items."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        texts = [words(r[1]) for r in rows]
        self.number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.texts = [np.array([self.number[w] for w in t], np.int64) for t in texts]
        self.bags = [np.unique(t, return_counts=True) for t in self.texts]
        found = [(self.key(t), np.full(len(t) - SEED + 1, i)) for i, t in enumerate(self.texts) if len(t) >= SEED]
        key = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        owner = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        self.owner = owner[once]
        self.keys, self.first = np.unique(key[once], return_index=True)
        self.first = np.append(self.first, len(self.owner))
        self.rare = np.ones(len(self.keys), bool)

    def encode(self, text: str | None) -> np.ndarray:
        """Item word numbers of a document's words, -1 for all others."""
        w = words(text)
        return np.fromiter(map(self.number.get, w, repeat(-1)), np.int64, len(w))

    def key(self, ids: np.ndarray) -> np.ndarray:
        size = len(self.number) + 1
        return (ids[:-2] * size + ids[1:-1]) * size + ids[2:]

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seeds that occur in a document: their numbers and places."""
        none = np.empty(0, np.int64)
        if len(ids) < SEED or not len(self.keys):
            return none, none
        known = ids >= 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
        if not len(at):
            return none, none
        size = len(self.number) + 1
        key = (ids[at] * size + ids[at + 1]) * size + ids[at + 2]
        k = np.searchsorted(self.keys, key)
        k[k == len(self.keys)] = 0
        found = self.keys[k] == key
        return k[found], at[found]

    def weigh(self, documents: np.ndarray, n_docs: int) -> None:
        """Rare seeds, from the number of documents that hold each."""
        self.rare = documents <= max(RARE_DOCS, RARE_SHARE * n_docs)

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, bool]]:
        """(item, place in the document, whether the seed is rare) of each seed that occurs."""
        seed, at = self.places(ids)
        rare = self.rare[seed].tolist()
        return [(int(self.owner[o]), place, r) for k, place, r in zip(seed.tolist(), at.tolist(), rare, strict=True) for o in range(self.first[k], self.first[k + 1])]

    def bound(self, item: int, passage: np.ndarray) -> int:
        """Most words that any alignment of an item with a passage can agree in."""
        own, times = self.bags[item]
        at = np.searchsorted(own, passage)
        at[at == len(own)] = 0
        return int(np.minimum(np.bincount(at[own[at] == passage], minlength=len(own)), times).sum())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment: (score, agreeing words, start, end in the passage); memory grows with the passage only."""
    m = len(passage)
    place = np.arange(m + 1)
    slope = place * GAP
    score, start, same = np.zeros(m + 1, np.int64), place.copy(), np.zeros(m + 1, np.int64)
    best = (0, 0, 0, 0)
    for word in item:
        agree = passage == word
        diagonal, down = score[:-1] + np.where(agree, MATCH, MISMATCH), score[1:] - GAP
        own, own_start, own_same = np.zeros(m + 1, np.int64), place.copy(), np.zeros(m + 1, np.int64)
        straight = diagonal >= down
        top = np.where(straight, diagonal, down)
        on = top > 0
        own[1:] = np.where(on, top, 0)
        own_start[1:] = np.where(on, np.where(straight, start[:-1], start[1:]), place[1:])
        own_same[1:] = np.where(on, np.where(straight, same[:-1] + agree, same[1:]), 0)
        # words of the passage left out: each cell may come from one to the left
        raised = own + slope
        run = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == run, place, 0))
        score, start, same = run - slope, own_start[source], own_same[source]
        end = int(score.argmax())
        if score[end] > best[0]:
            best = (int(score[end]), int(same[end]), int(start[end]), end)
    return best


def matches(items: Items, text: str | None) -> list[tuple]:
    """(item number, share of the best score, agreeing words, first and last word) of each copied item."""
    ids = items.encode(text)
    by_item: dict[int, list[tuple[int, bool]]] = {}
    for item, at, rare in items.hits(ids):
        by_item.setdefault(item, []).append((at, rare))
    out = []
    for item, places in sorted(by_item.items()):
        t = items.texts[item]
        n, best = len(t), None
        places.sort()
        lo = 0
        for k in range(1, len(places) + 1):
            if k == len(places) or places[k][0] - places[k - 1][0] > 2 * n:
                left, right = max(0, places[lo][0] - 2 * n), min(len(ids), places[k - 1][0] + SEED + 2 * n)
                window = ids[left:right]
                if any(r for _, r in places[lo:k]) or items.bound(item, window) >= max(LEAST_SCORE * n, min(LEAST_WORDS, n)):
                    score, same, start, end = align(t, window)
                    found = (score / (MATCH * n), same, left + start, left + end)
                    if best is None or found[:2] > best[:2]:
                        best = found
                lo = k
        if best and best[0] >= LEAST_SCORE and best[1] >= min(LEAST_WORDS, n):
            out.append((item, *best))
    return out


def prepared(docs: DataFrame, items: DataFrame, item_col: str, item_text_col: str, text_col: str) -> Iterator[Items]:
    """The blocks of items with their rare seeds, from counts over all documents."""
    items = items.select(items[item_col].alias("item_id"), items[item_text_col].alias("text")).filter("text is not null").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        block = Items(sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r)))  # BLOCK_ITEMS rows and BLOCK_CHARS, about
        if not len(block.keys):
            continue
        tables = docs.sparkSession.sparkContext.broadcast(block)

        def count(batches: Iterable[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            block = tables.value
            total = np.zeros(len(block.keys) + 1, np.int64)  # documents with each seed, all documents
            for batch in batches:
                for t in batch.column(0):
                    total[np.unique(block.places(block.encode(t.as_py()))[0])] += 1
                total[-1] += batch.num_rows
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["seed", "n"])

        # a row per seed of the block at most: two integers each
        sums = docs.select(docs[text_col].alias("text")).mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
        held = np.zeros(len(block.keys) + 1, np.int64)
        held[sums["seed"].to_numpy()] = sums["n"].to_numpy()
        tables.unpersist()
        block.weigh(held[:-1], int(held[-1]))
        yield block


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and item that it copies: ids, score (share of the best possible), agreeing words, first and last word.

    Null and empty texts and items of fewer than three words match nothing;
    repeated documents are reported as often as they occur; repeated items once,
    items of one id and several texts once for each text; null ids are reported
    as they are; empty tables give no rows; other columns are not read.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    item_arrow = to_arrow_type(items.schema[item_col].dataType)
    schema = f"doc_id {id_type}, item_id {item_type}, score double, n_matched int, first_word int, last_word int"
    source, out = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), None
    for block in prepared(docs, items, item_col, item_text_col, text_col):
        tables = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            block = tables.value
            for batch in batches:
                rows, found = [], []
                for k, t in enumerate(batch.column(1)):
                    for m in matches(block, t.as_py()):
                        rows.append(k)
                        found.append(m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int32())),
                        pa.array([block.ids[m[0]] for m in found], item_arrow),
                        pa.array([m[1] for m in found], pa.float64()),
                        *(pa.array([m[c] for m in found], pa.int32()) for c in (2, 3, 4)),
                    ],
                    names=["doc_id", "item_id", "score", "n_matched", "first_word", "last_word"],
                )

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def filtered(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, all columns, that copy no item; one narrow pass a block, no join.

    Rows with a null or empty text stay, repeated rows stay or go alike; ids are
    not read; an empty table gives no rows, an empty list of items keeps all.
    """
    at, out = docs.columns.index(text_col), docs
    for block in prepared(docs, items, item_col, item_text_col, text_col):
        tables = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not matches(tables.value, t.as_py()) for t in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
