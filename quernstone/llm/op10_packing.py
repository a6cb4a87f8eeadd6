"""Bound-certified repacking: best-fit decreasing under dual-feasible bounds.

Method.  Documents become pieces of at most ``capacity`` tokens.  Pieces are
dealt to partitions of bounded size; each partition is packed by best-fit
decreasing, and dual-feasible functions give a lower bound on the bins that its
pieces need.  A partition whose count meets its bound is certified: it keeps
its bins, but for the least filled one.  A partition with a gap is packed once
more by subset sums; if the gap stays, it keeps its full
bins and gives the pieces of its worst filled ones (an eighth of its pieces at
most) to an exchange: the given pieces of eight partitions meet in one
partition of the next level, which is packed again.  The number of partitions
falls by eight a level and no partition ever grows beyond the first ones' size.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import cut
from quernstone.llm.units import SPECIAL, Units

CAPACITY = 2048
#: Pieces in a partition of the first level, on average.
BLOCK = 16_384
#: Partitions that meet in one of the next level.
FAN = 8
#: A bin with so many free tokens or fewer counts as full.
SLACK = 2


# ------------------------------------------------------------------ tokens
class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes."""

    def __init__(self, vocab: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocab), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("quernstone", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
        self.special = self.pack([len(ranks)])
        self.units = Units(lambda s: self.pack(self.encode(s)))

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        return self.special.join(b"".join(self.units.of(part)) for part in text.split(SPECIAL))


_encoders: dict[str, Encoder] = {}


def encoder(vocab: str) -> Encoder:
    if vocab not in _encoders:
        _encoders[vocab] = Encoder(vocab)
    return _encoders[vocab]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, cut only where too long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocab), Encoder.pack([end_id])
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if at == 0 else capacity
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


# ------------------------------------------------------------------ packing
def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin of each item, its place in the bin, and each bin's free room."""
    order = np.argsort(-sizes, kind="stable")
    where, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set if some bin has r tokens of room
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        rest = mask >> size
        if rest:
            room = size + ((rest & -rest).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        where[i], place[i] = b, capacity - room
        free[b] = left = room - size
        if left:
            if not by_room[left]:
                mask |= 1 << left
            by_room[left].append(b)
    return where, place, np.array(free, np.int64)


def fill_by_sums(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin by bin: the largest item left, and of the others a set whose sum comes nearest to the room.

    Sums are bits of an integer; large sizes are tried first, so that small ones
    are left for later bins.  The same results as ``best_fit_decreasing``.
    """
    left: dict[int, list[int]] = {}
    for i in np.argsort(-sizes, kind="stable").tolist():
        left.setdefault(int(sizes[i]), []).append(i)
    order = sorted(left, reverse=True)
    where, place, free = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    while order:
        room = capacity - order[0]
        taken = [order[0]]
        reach, goal = [1], 1 << room
        steps = []
        for k, size in enumerate(order):
            if size > room:
                continue
            for _ in range(min(len(left[size]) - (k == 0), room // size, 4)):
                steps.append(size)
                reach.append((reach[-1] | reach[-1] << size) & (2 * goal - 1))
                if reach[-1] & goal:
                    break
            if reach[-1] & goal:
                break
        rest = reach[-1].bit_length() - 1
        for k in range(len(steps) - 1, -1, -1):
            if not reach[k] >> rest & 1:
                taken.append(steps[k])
                rest -= steps[k]
        at = 0
        for size in taken:
            i = left[size].pop()
            where[i], place[i] = len(free), at
            at += size
            if not left[size]:
                del left[size]
                order.remove(size)
        free.append(capacity - at)
    return where, place, np.array(free, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best of several dual-feasible-function bounds on the number of bins (exact integers)."""
    if not len(sizes):
        return 0
    hist = np.bincount(sizes, minlength=capacity + 1).astype(object)
    size = np.arange(capacity + 1)
    best = -(-int(sizes.sum()) // capacity)
    # threshold functions: over capacity-e counts whole, under e counts nothing
    count, total = np.cumsum(np.bincount(sizes, minlength=capacity + 1)), np.cumsum(np.bincount(sizes, minlength=capacity + 1) * size)
    for e in range(1, capacity // 2 + 1):
        big = int(count[capacity] - count[capacity - e])
        middle = int(total[capacity - e] - total[e - 1])
        best = max(best, big + -(-middle // capacity))
    # rounding functions u_k: x if (k+1)x is whole, else floor((k+1)x)/k
    for k in range(1, 25):
        scaled, rem = np.divmod((k + 1) * size, capacity)
        value = np.where(rem == 0, k * size, scaled * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((hist * value).sum()) // (k * capacity)))
    return int(best)


def pack_block(sizes: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(bin, place, kept) per item, the block's bins and the bound that certifies them where both are equal."""
    where, place, free = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(free) > bound:
        again = fill_by_sums(sizes, capacity)
        if len(again[2]) < len(free):
            where, place, free = again
    certified = len(free) == bound
    kept_bin = np.ones(len(free), bool)
    if not last and len(free):
        worst = np.argsort(-free, kind="stable")
        if certified:
            kept_bin[worst[0]] = free[worst[0]] <= SLACK
        else:
            items = np.bincount(where, minlength=len(free))[worst]
            give = (free[worst] > SLACK) & (np.cumsum(items) <= max(len(sizes) // FAN, int(items[0])))
            kept_bin[worst[give]] = False
    return where, place, kept_bin[where], len(free), bound


_OUT = "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, level int, block_bins bigint, block_bound bigint, kept boolean, block bigint"


def _packer(capacity: int, level: int, last: bool):
    def run(group: pa.Table) -> pa.Table:
        # a fixed order of the rows: a recomputed task packs alike
        group = group.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = group.column("length").to_numpy()
        block = group.column("block")[0].as_py()
        where, place, kept, bins, bound = pack_block(sizes, capacity, last)
        n = len(sizes)
        return pa.table(
            {
                **{c: group.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
                "sequence_id": pa.array(((block * 16 + level) << 24) + where, pa.int64()),
                "offset": pa.array(place, pa.int64()),
                "level": pa.array(np.full(n, level), pa.int32()),
                "block_bins": pa.array(np.full(n, bins), pa.int64()),
                "block_bound": pa.array(np.full(n, bound), pa.int64()),
                "kept": pa.array(kept, pa.bool_()),
                "block": pa.array(np.full(n, block // FAN), pa.int64()),
            }
        )

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``, and the certificate of the partition that packed them.

    ``level`` is that of the partition, ``block_bins`` and ``block_bound`` are the
    bins that it needed and the least that any packing of its pieces needs.
    No piece is cut, dropped or given twice.  Repeated rows are packed each on
    their own, null ids are kept, an empty table gives no rows.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {_OUT}"
    rows = cut(rows)
    n = rows.count()
    blocks = max(1, -(-n // block))
    # dealt by position, not by value: copies of a document don't meet in one block
    todo = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    done, level = None, 0
    while True:
        last = blocks == 1
        packed = todo.groupBy("block").applyInArrow(_packer(capacity, level, last), schema)
        if not last:
            packed = cut(packed)
        kept = packed.filter("kept").drop("kept", "block")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        todo = packed.filter("not kept").select("doc_id", "piece", "start", "length", "ids_crc32", "block")
        blocks, level = -(-blocks // FAN), level + 1


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, block: int = BLOCK, vocab: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Tokens of all texts packed into few sequences of at most ``capacity``.

    A null text is an empty one (its end token only).  Only texts longer than a
    sequence are cut; their first piece takes what is left over.
    """
    return pack(pieces(docs, id_col, text_col, capacity, 0, vocab), capacity, block)
