"""Near-duplicate documents by a chosen-path set similarity join.

Method.  A document is the set of its 5-word shingles, embedded as TOKENS
minwise tokens (one-permutation hashing, densified).  In each of several
independent trees a node holds documents; a document goes on to the children
named by the BRANCH tokens of its own that come first in an order chosen by the
node.  Similar documents choose the same child with high probability, others
part.  A node with at most SMALL documents is a leaf: its documents are compared
exhaustively, first by their tokens, and what may be a link by the full sets.
Trees are repeated until a pair at the threshold is missed with a probability
below one in ten thousand (if tokens were independent).

Branching can't part documents that are nearly all alike: two children would
each hold nearly all of them.  So a large child with more than DENSE of its
parent's documents is *dense* and branches no further.  In dense nodes hubs are
chosen, documents with many alike ones in a sample, and every document is
verified, by the full sets, against the hub it agrees with most; links make
pieces.  Then only what isn't in a node's largest piece is compared with the
rest of the node, in pairs of blocks.  A group of n copies that are linked with
few hubs costs rows in proportion to n; what no hub links is compared with all
of its node, exactly, which is quadratic in the number of such documents.  The
sample only chooses hubs: no link is lost by it.

Connections matter, not pairs: documents with equal sets are one vertex from
the start; a leaf verifies a pair only if no link between their pieces is known
yet; and all trees but the first only look at leaves that still hold two pieces
of the graph.  So nothing is ever emitted by pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import cut, mix, shingle_hashes
from quernstone.llm.components import components

WORDS, PERCENT = 5, 85
TOKENS, TREES, BRANCH = 128, 6, 2
#: Documents in a leaf.
SMALL = 2048
#: A large child with more than this share of its parent is dense; so is all that is large after LEVELS.
DENSE, LEVELS = 0.7, 40
#: Rounds of hubs in dense nodes, hubs of a node and round, and about so many documents to choose them from.
ROUNDS, HUBS, SAMPLE, HUB_ALIKE = 3, 4, 64, 0.8
#: Shingles whose sets one task holds at a time (8 bytes each): leaves with more are compared in blocks.
GRAMS = 4 << 20
#: Token agreement below this can't be a link (five deviations under the threshold).
LEAST_ALIKE, LEAST_ALIKE_SHORT, SHORT_SET = 0.69, 0.58, 64

_EDGES = (np.arange(TOKENS + 1, dtype=np.float64) * (2.0**64 / TOKENS)).astype(object)
_STARTS = np.array([int(x) for x in _EDGES[:-1]], np.uint64)
_FILL = mix(np.arange(1, 4097, dtype=np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + np.arange(TOKENS, dtype=np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F)) % np.uint64(TOKENS)


# ------------------------------------------------------------------ sketches
def tokens(h: np.ndarray) -> np.ndarray:
    """TOKENS minwise tokens (uint32) of a sorted distinct set of 64-bit hashes."""
    at = np.searchsorted(h, _STARTS)
    ends = np.append(at[1:], len(h))
    has = at < ends
    out = np.zeros(TOKENS, np.uint64)
    out[has] = h[at[has]]
    empty = np.flatnonzero(~has)
    for k in range(len(_FILL)):  # an empty bin borrows from a bin of its own random order
        if not len(empty):
            break
        source = _FILL[k, empty].astype(np.int64)
        ok = has[source]
        out[empty[ok]] = mix(out[source[ok]] + empty[ok].astype(np.uint64))
        empty = empty[~ok]
    if len(empty):
        out[empty] = mix(h[0] + empty.astype(np.uint64))
    return (mix(out) >> np.uint64(32)).astype(np.uint32)


def digest(h: np.ndarray) -> bytes:
    """128 bits of a set."""
    return int(mix(h).sum(dtype=np.uint64)).to_bytes(8, "little") + int(mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)).to_bytes(8, "little") + len(h).to_bytes(4, "little")


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dig, tok = [], [], []
            for t in batch.column(1):
                h = shingle_hashes(t.as_py(), WORDS)
                n.append(len(h))
                dig.append(digest(h) if len(h) else None)
                tok.append(tokens(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dig, pa.binary()), pa.array(tok, pa.binary())], names=["doc", "n", "digest", "tokens"])

    return docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text")).mapInArrow(run, "doc bigint, n bigint, digest binary, tokens binary")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The full sets of the wanted documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [shingle_hashes(t.as_py(), WORDS).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["doc", "grams"])

    source = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].alias("text"))
    return source.join(wanted.hint("shuffle_hash"), "doc", "left_semi").mapInArrow(run, "doc bigint, grams binary")


# ------------------------------------------------------------------ branching
def chosen(sketch: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Children (rows x BRANCH) of documents (rows x TOKENS) at their nodes (rows)."""
    place = np.arange(TOKENS, dtype=np.uint64) << np.uint64(32)
    order = mix((sketch.astype(np.uint64) | place[None, :]) ^ mix(node)[:, None])
    return np.partition(order, BRANCH - 1, axis=1)[:, :BRANCH]


def _first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roots = mix(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            sketch = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, TOKENS)
            docs = part.column(0).to_numpy()
            for tree in range(TREES):
                nodes = chosen(sketch, np.full(len(docs), roots[tree])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs) * BRANCH, tree, np.int32)), pa.array(nodes.ravel()), pa.array(np.repeat(docs, BRANCH))], names=["tree", "node", "doc"])


def _next(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            sketch = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint32).reshape(-1, TOKENS)
            nodes = chosen(sketch, part.column(1).to_numpy().view(np.uint64)).view(np.int64)
            twice = [pa.array(np.repeat(part.column(k).to_numpy(), BRANCH)) for k in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([twice[0], pa.array(nodes.ravel()), *twice[1:]], names=["tree", "node", "doc", "above"])


_ROW = "tree int, node bigint, doc bigint"


def leaves(reps: DataFrame) -> DataFrame:
    """(tree, node, doc, dense) of all leaves and dense nodes with at least two documents."""
    above = F.lit(reps.count())
    rows = cut(reps.select("doc", "tokens").mapInArrow(_first, _ROW)).withColumn("above", above)
    done = None
    for level in range(LEVELS + 1):
        counts = rows.groupBy("node").count().filter("count > 1")
        rows = cut(rows.join(counts, "node").select("tree", "node", "doc", "above", "count"))
        dense = F.lit(level == LEVELS) | (F.col("count") > DENSE * F.col("above"))
        here = rows.select("tree", "node", "doc", "count", (dense & (F.col("count") > SMALL)).alias("dense"))
        ends = here.filter((F.col("count") <= SMALL) | F.col("dense")).select("tree", "node", "doc", "dense")
        done = ends if done is None else done.unionByName(ends)
        large = here.filter((F.col("count") > SMALL) & ~F.col("dense"))
        if large.isEmpty():
            break
        rows = large.select("tree", "node", "doc", F.col("count").alias("above")).join(reps.select("doc", "tokens"), "doc").select("tree", "node", "doc", "above", "tokens").mapInArrow(_next, f"{_ROW}, above bigint").distinct()
    return done


# ------------------------------------------------------------------ dense nodes
def choose_hubs(short: np.ndarray) -> list[int]:
    """Rows of a sample that together are alike with most of it, the best first; a row alone is no hub."""
    alike = np.stack([(short == s).mean(axis=1) >= HUB_ALIKE for s in short])
    left, found = np.ones(len(short), bool), []
    while len(found) < HUBS:
        counts = (alike & left[None, :]).sum(axis=1)
        k = int(counts.argmax())
        if counts[k] < 2:
            break
        found.append(k)
        left &= ~alike[k]
    return found


def _hubs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, doc, n, short) of samples, sorted by node -> one row a node with its hubs, side by side."""

    def work(leaf: pa.RecordBatch) -> pa.RecordBatch | None:
        shorts = leaf.column(3).to_pylist()
        at = choose_hubs(np.frombuffer(b"".join(shorts), np.uint8).reshape(-1, TOKENS))
        if not at:
            return None
        docs, n = leaf.column(1).to_numpy()[at], leaf.column(2).to_numpy()[at]
        row = [leaf.column(0).slice(0, 1), pa.array([docs.tolist()], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64())), pa.array([b"".join(shorts[k] for k in at)], pa.binary())]
        return pa.RecordBatch.from_arrays(row, names=["node", "hubs", "hub_n", "hub_short"])

    return by_leaf(batches, work)


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, n, short, hubs, hub_n, hub_short) -> (doc, hub, alike): the hub that a document agrees with most."""
    for batch in batches:
        docs, best, share = [], [], []
        for doc, n, short, hubs, hub_n, hub_short in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            sizes = np.array(hub_n)
            agree = (np.frombuffer(hub_short, np.uint8).reshape(-1, TOKENS) == np.frombuffer(short, np.uint8)).mean(axis=1)
            fit = (np.array(hubs) != doc) & (100 * np.minimum(n, sizes) >= PERCENT * np.maximum(n, sizes)) & (agree >= least_alike(np.minimum(n, sizes)))
            if fit.any():
                k = int(np.where(fit, agree, -1).argmax())
                docs.append(doc)
                best.append(hubs[k])
                share.append(float(agree[k]))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(best, pa.int64()), pa.array(share, pa.float64())], names=["doc", "hub", "alike"])


def _attach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, member, doc, hub, grams), a part's hub first -> verified links (u, v) of members with their hub."""
    part, own = None, None
    for batch in batches:
        u, v = [], []
        for p, member, doc, hub, grams in zip(*(batch.column(k) for k in range(5)), strict=True):
            if not member.as_py():
                part, own = p.as_py(), np.frombuffer(grams.as_buffer(), np.uint64)
            elif part == p.as_py() and linked(own, np.frombuffer(grams.as_buffer(), np.uint64)):
                u.append(doc.as_py())
                v.append(hub.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def nodes_of_pieces(rows: DataFrame) -> DataFrame:
    """Per node of (node, doc, piece): its largest piece, and the numbers of documents in it and not in it; nodes of one piece are left out."""
    sizes = rows.groupBy("node", "piece").count()
    return sizes.groupBy("node").agg(F.max_by("piece", F.struct("count", "piece")).alias("most"), F.max("count").alias("inside"), (F.sum("count") - F.max("count")).alias("others")).filter("others > 0")


def with_pieces(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """(node, doc, piece) from (node, doc) and what is known of pieces (doc, component)."""
    if known is None:
        return rows.select("node", "doc", F.col("doc").alias("piece"))
    return rows.join(known, "doc", "left").select("node", "doc", F.coalesce("component", "doc").alias("piece"))


def hub_links(dense: DataFrame, light: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) of the documents of dense nodes (node, doc) with hubs, in rounds."""
    rows = cut(dense.join(light, "doc").select("node", "doc", "n", "short"))
    links = known = None
    for turn in range(ROUNDS):
        nodes = cut(nodes_of_pieces(with_pieces(rows, known)))
        if nodes.filter(F.col("others") > SMALL // 2).isEmpty():
            break
        open_ = rows.join(nodes.filter(F.col("others") > SMALL // 2).hint("shuffle_hash"), "node")
        if known is not None:
            open_ = open_.join(known, "doc", "left").filter(F.coalesce("component", "doc") != F.col("most"))
        chance = F.pmod(F.xxhash64("doc", "node", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        sample = open_.filter(chance * F.greatest(F.col("others"), F.lit(1)) < SAMPLE).select("node", "doc", "n", "short")
        hubs = cut(sample.repartition("node").sortWithinPartitions("node", "doc").mapInArrow(_hubs, "node bigint, hubs array<bigint>, hub_n array<bigint>, hub_short binary"))
        met = open_.select("node", "doc", "n", "short").join(hubs, "node").select("doc", "n", "short", "hubs", "hub_n", "hub_short").mapInArrow(_meet, "doc bigint, hub bigint, alike double")
        pairs = cut(met.groupBy("doc").agg(F.max_by("hub", F.struct("alike", "hub")).alias("hub")))
        # a hub's members are dealt over parts of bounded size; its set goes along to each
        parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / (SMALL // 2)).cast("long").alias("parts"))
        members = pairs.join(parts, "hub").select(F.xxhash64("hub", F.pmod(F.xxhash64("doc"), F.col("parts"))).alias("part"), F.lit(1).alias("member"), "doc", "hub")
        leads = parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("k")).select(F.xxhash64("hub", "k").alias("part"), F.lit(0).alias("member"), F.col("hub").alias("doc"), "hub")
        both = members.union(leads).join(sets, "doc").select("part", "member", "doc", "hub", "grams")
        new = both.repartition("part").sortWithinPartitions("part", "member", "doc").mapInArrow(_attach, "u bigint, v bigint")
        links = cut(new if links is None else new.union(links))
        known = cut(components(links).select(F.col("v").alias("doc"), "component"))
    return links


def blocks(dense: DataFrame) -> DataFrame:
    """Leaves (node, doc, piece) of dense nodes (tree, node, doc, piece): what isn't in a node's largest piece, with all of it."""
    half = SMALL // 2
    nodes = nodes_of_pieces(dense)
    rows = dense.join(nodes.hint("shuffle_hash"), "node")
    other = F.ceil(F.col("others") / half).cast("long")
    inner = F.ceil(F.col("inside") / half).cast("long")
    rows = rows.select("tree", "node", "doc", "piece", (F.col("piece") == F.col("most")).alias("is_in"), other.alias("other"), inner.alias("inner"), F.xxhash64("doc", "node").alias("h"))
    rows = rows.withColumn("own", F.pmod("h", F.when(F.col("is_in"), F.col("inner")).otherwise(F.col("other"))))
    # blocks of others meet each other and every block of the largest piece
    met = F.when(F.col("is_in"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("other") - 1), lambda k: F.xxhash64("node", F.lit("in"), k, "own"))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("other") - 1), lambda k: F.xxhash64("node", F.lit("out"), F.least(k, "own"), F.greatest(k, "own"))),
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("inner") - 1), lambda k: F.xxhash64("node", F.lit("in"), "own", k)),
        )
    )
    return rows.select("tree", F.explode(met).alias("node"), "doc", "piece")


# ------------------------------------------------------------------ leaves
def by_leaf(batches: Iterable[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Applies ``work`` to the rows of each leaf; rows come sorted by their first column."""
    held: list[pa.RecordBatch] = []

    def finish() -> Iterator[pa.RecordBatch]:
        if held:
            out = work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held.clear()
            if out is not None and out.num_rows:
                yield out

    for batch in batches:
        node = batch.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)])) if len(node) else np.array([0])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and held[0].column(0)[0].as_py() != int(node[lo]):
                yield from finish()
            held.append(batch.slice(lo, hi - lo))
    yield from finish()


def least_alike(n: np.ndarray) -> np.ndarray:
    return np.where(n < SHORT_SET, LEAST_ALIKE_SHORT, LEAST_ALIKE)


def alike_rows(i: int, short: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Later rows that may be linked with row i, and their token agreement (one byte a token)."""
    rest = np.arange(i + 1, len(n))
    fit = rest[100 * np.minimum(n[i], n[rest]) >= PERCENT * np.maximum(n[i], n[rest])]
    share = (short[fit] == short[i]).mean(axis=1) if len(fit) else np.empty(0)
    ok = share >= least_alike(np.minimum(n[i], n[fit]))
    return fit[ok], share[ok]


def _active(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a leaf that may be linked with a row of another piece of it (node, tree, doc, n, short, piece)."""

    def work(leaf: pa.RecordBatch) -> pa.RecordBatch | None:
        n, pieces = leaf.column(3).to_numpy(), leaf.column(5).to_numpy()
        short = np.frombuffer(b"".join(leaf.column(4).to_pylist()), np.uint8).reshape(len(n), TOKENS)
        on = np.zeros(len(n), bool)
        for i in range(len(n) - 1):
            fit, _ = alike_rows(i, short, n)
            fit = fit[pieces[fit] != pieces[i]]
            if len(fit):
                on[i] = True
                on[fit] = True
        if not on.any():
            return None
        keep = pa.array(np.flatnonzero(on))
        return pa.RecordBatch.from_arrays([leaf.column(k).take(keep) for k in range(4)], names=["node", "tree", "doc", "n"])

    return by_leaf(batches, work)


def active(found: DataFrame, light: DataFrame) -> DataFrame:
    """(node, tree, doc, n) of the rows of leaves (tree, node, doc, piece) that may be linked."""
    rows = found.join(light, "doc").select("node", "tree", "doc", "n", "short", "piece")
    return rows.repartition("node").sortWithinPartitions("node", "doc").mapInArrow(_active, "node bigint, tree int, doc bigint, n bigint").distinct()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = common(a, b)
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def shared_places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of every shingle that at least two sets hold, sorted by column, and the number of columns."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    return row[order], column[order], int(shared.sum())


def all_linked(row: np.ndarray, column: np.ndarray, width: int, n: np.ndarray) -> np.ndarray:
    """Which pairs of sets are linked, from the sizes of all intersections (products of 0/1 matrices)."""
    both = np.zeros((len(n), len(n)), np.float32)
    for lo in range(0, width, 4096):
        a, b = np.searchsorted(column, (lo, lo + 4096))
        part = np.zeros((len(n), min(4096, width - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        both += part @ part.T
    count = both.astype(np.int64)  # exact: sizes are below 2 ** 24
    return (count > 0) & (100 * count >= PERCENT * (n[:, None] + n[None, :] - count))


def joined(linked_rows: np.ndarray, pieces: np.ndarray) -> list[tuple[int, int]]:
    """Edges between pieces (larger, smaller) from a matrix of linked rows, a star for each component."""
    seen, edges = np.zeros(len(pieces), bool), []
    for i in range(len(pieces)):
        if seen[i]:
            continue
        seen[i] = True
        group, ahead = [i], [i]
        while ahead:
            k = ahead.pop()
            new = np.flatnonzero((linked_rows[k] | (pieces == pieces[k])) & ~seen)
            seen[new] = True
            group.extend(new.tolist())
            ahead.extend(new.tolist())
        held = np.unique(pieces[group])
        edges += [(p, int(held[0])) for p in held[1:].tolist()]
    return edges


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the pieces that verified links make of a leaf (node, doc, piece, grams)."""

    def one_by_one(sets: list[np.ndarray], pieces: np.ndarray, every: np.ndarray) -> list[tuple[int, int]]:
        root = {p: p for p in pieces.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges = []
        for _, i, j in every[np.argsort(every[:, 0], kind="stable")]:
            a, b = find(int(pieces[int(i)])), find(int(pieces[int(j)]))
            if a != b and linked(sets[int(i)], sets[int(j)]):
                root[max(a, b)] = min(a, b)
                edges.append((max(a, b), min(a, b)))
        return edges

    def work(leaf: pa.RecordBatch) -> pa.RecordBatch | None:
        pieces = leaf.column(2).to_numpy()
        sets = [np.frombuffer(g.as_buffer(), np.uint64) for g in leaf.column(3)]
        n = np.array([len(s) for s in sets])
        short = np.stack([tokens(s).astype(np.uint8) for s in sets])
        pairs = []
        for i in range(len(n) - 1):
            fit, share = alike_rows(i, short, n)
            use = pieces[fit] != pieces[i]
            pairs.append(np.column_stack((-share[use], np.full(use.sum(), i), fit[use])).astype(np.float32))
        every = np.concatenate(pairs) if pairs else np.empty((0, 3), np.float32)
        edges = None
        if len(every) > 8 * len(n):  # many pairs alike: all intersections at once where that is the cheaper way
            row, column, width = shared_places(sets)
            if len(n) ** 2 * width * 2e-11 < len(every) * 2e-5:
                edges = joined(all_linked(row, column, width, n), pieces)
        if edges is None:
            edges = one_by_one(sets, pieces, every)
        if not edges:
            return None
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["u", "v"])

    return by_leaf(batches, work)


def bounded(rows: DataFrame) -> DataFrame:
    """Leaves (node, doc, n, piece) whose sets take too much memory become pairs of blocks, each a leaf."""
    half = F.lit(GRAMS // 2)
    large = cut(rows.groupBy("node").agg(F.ceil(F.sum("n") / half).cast("long").alias("blocks")).filter("blocks > 2"))
    if large.isEmpty():
        return rows.select("node", "doc", "piece")
    split = rows.join(large.hint("shuffle_hash"), "node", "left").withColumn("own", F.pmod(F.xxhash64("doc", "node"), F.col("blocks")))
    ids = F.when(F.col("blocks").isNull(), F.array("node")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.xxhash64("node", F.least(k, "own"), F.greatest(k, "own"))))
    return split.select(F.explode(ids).alias("node"), "doc", "piece")


def leaf_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges between pieces, from active rows (node, doc, n, piece)."""
    met = bounded(rows).join(sets, "doc").select("node", "doc", "piece", "grams")
    return met.repartition("node").sortWithinPartitions("node", "doc").mapInArrow(_links, "u bigint, v bigint")


def short_tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each token: enough to estimate agreement."""
    for batch in batches:
        low = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, TOKENS).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in low], pa.binary())], names=["doc", "n", "short"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Two documents are linked if 100 * |A and B| >= 85 * |A or B| for their shingle
    sets (64-bit hashes).  Null, empty and blank texts have no set and are linked
    with nothing.  Rows that repeat a doc_id are one vertex of the graph and come
    back as often.  A null doc_id is linked with nothing (component null, kept).
    An empty table gives no rows; other columns are not read.
    """
    sigs = cut(sketches(docs, id_col, text_col))
    usable = sigs.filter("n > 0 and doc is not null")
    first = usable.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    copies = cut(usable.select("doc", "digest").join(first.filter("copies > 1"), "digest").filter("doc <> rep").select(F.col("doc").alias("u"), F.col("rep").alias("v")).distinct())
    reps = usable.select("doc", "n", "tokens").join(copies.select(F.col("u").alias("doc")).distinct(), "doc", "left_anti")
    found = leaves(reps)
    light = reps.select("doc", "n", "tokens").mapInArrow(short_tokens, "doc bigint, n bigint, short binary")
    near = cut(active(found.filter("not dense").select("tree", "node", "doc", F.col("doc").alias("piece")), light))
    dense = cut(found.filter("dense").select("tree", "node", "doc"))
    any_dense = not dense.isEmpty()
    wanted = near.select("doc").union(dense.select("doc")) if any_dense else near.select("doc")
    sets = cut(full_sets(docs, wanted.distinct(), id_col, text_col))
    links = hub_links(dense.filter("tree = 0").select("node", "doc"), light, sets) if any_dense else None
    # the first tree links most of each group, the others see only leaves that hold more than one piece
    for trees in ("tree = 0", "tree > 0"):
        known = None if links is None else cut(components(links).select(F.col("v").alias("doc"), "component"))
        rows = near.filter(trees).select("node", "doc", "n", F.col("doc").alias("piece"))
        if known is not None:
            rows = rows.drop("piece").join(known, "doc", "left").select("node", "doc", "n", F.coalesce("component", "doc").alias("piece"))
        if any_dense:
            pieces = dense.filter(trees).withColumn("piece", F.col("doc"))
            if known is not None:
                pieces = pieces.drop("piece").join(known, "doc", "left").select("tree", "node", "doc", F.coalesce("component", "doc").alias("piece"))
            more = cut(blocks(pieces))
            alike = active(more, light).select("node", "doc", "n")
            rows = rows.union(alike.join(more.select("doc", "piece").distinct(), "doc").select("node", "doc", "n", "piece"))
        open_ = rows.groupBy("node").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).filter("a <> b").select("node")
        new = leaf_links(rows if known is None else rows.join(open_, "node", "left_semi"), sets)
        stars = None if known is None else known.filter("doc <> component").select(F.col("doc").alias("u"), F.col("component").alias("v"))
        links = cut(new if stars is None else new.union(stars))
    final = components(links.union(copies))
    out = sigs.select("doc", "n").join(final.select(F.col("v").alias("doc"), "component"), "doc", "left")
    own = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc"), F.lit(True)).alias("kept"))
