"""Operators 3, 6, 7 and 10 and the pipeline: hard rows, empty tables and brute force."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import prose  # noqa: F401
from quernstone.llm import op03_decontamination as o3
from quernstone.llm import op06_sharding as o6
from quernstone.llm import op07_near_dedup as o7
from quernstone.llm import op10_packing as o10
from quernstone.llm.components import components, forest
from tests_llm_helpers import tokenizer  # noqa: F401


# ---- 3 ------------------------------------------------------------------------------
def test_op3_edited_copies(spark, hard, none):
    rng = random.Random(1)
    items = [(i, prose(1000 + i, 40)) for i in range(6)]
    rows = []
    for i in range(30):
        words = prose(2000 + i, 200).split()
        if i < 6:  # exact
            words[50:50] = items[i][1].split()
        elif i < 12:  # every ninth word replaced, one dropped
            w = ["changed" if k % 9 == 4 else x for k, x in enumerate(items[i - 6][1].split())]
            del w[rng.randrange(len(w))]
            words[100:100] = [x.upper() + "," for x in w]
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS item_id", "1 AS score")
    bench = spark.createDataFrame([*items, items[0], (90, None), (91, ""), (92, "two words")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted((r["doc_id"], r["item_id"]) for r in o3.contamination(docs, bench).collect())
    assert got == sorted([(i, i) for i in range(6)] + [(i + 6, i) for i in range(6)])
    assert sorted(r["doc_id"] for r in o3.filtered(docs, bench).collect()) == list(range(12, 30))
    assert o3.contamination(hard, bench).count() == 0 and o3.filtered(hard, bench).count() == hard.count()
    assert o3.contamination(none, bench).count() == 0 and o3.contamination(docs, bench.limit(0)).count() == 0


def test_op3_alignment_by_hand():
    def slow(a, b):
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i, j] = max(0, table[i - 1, j - 1] + (o3.MATCH if a[i - 1] == b[j - 1] else o3.MISMATCH), table[i - 1, j] - o3.GAP, table[i, j - 1] - o3.GAP)
        return table.max()

    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(-1, 5, rng.integers(1, 40))
        score, same, start, end = o3.align(a, b)
        assert score == slow(a, b) and 0 <= start <= end <= len(b) and same <= end - start


def test_op3_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(o3, "BLOCK_ITEMS", 2)
    items = [(i, prose(500 + i, 30)) for i in range(7)]
    docs = spark.createDataFrame([(i, prose(900 + i, 50) + " " + t) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in o3.contamination(docs, bench).collect()) == [(i, i) for i in range(7)]


def edited(rng, words, rate):
    out = []
    for w in words:
        u = rng.random()
        out += [f"x{rng.randrange(999)}"] if u < rate * 0.6 else [] if u < rate * 0.8 else [w, f"y{rng.randrange(999)}"] if u < rate else [w]
    return out


@pytest.mark.parametrize("rare_docs", [20, 0])
def test_op3_like_brute_force_without_seeds(spark, monkeypatch, rare_docs):
    """Every pair aligned without seeds; with no seed counted as rare, the exact way round must give the same."""
    monkeypatch.setattr(o3, "RARE_DOCS", rare_docs)
    rng = random.Random(11)
    items = [(i, prose(3000 + i, rng.choice([5, 12, 25, 60]))) for i in range(8)]
    rows = []
    for i in range(60):
        w = prose(4000 + i, 120).split()
        for _ in range(i % 3):
            at = rng.randrange(len(w))
            w[at:at] = edited(rng, rng.choice(items)[1].split(), rng.choice([0, 0.1, 0.2]))
        rows.append((i, " ".join(w)))
    rows += [(100 + i, "same start " + items[0][1] + f" end {i}") for i in range(30)]  # a passage that many copied: all its seeds are common
    block, want = o3.Items(items), set()
    for i, text in rows:
        ids = block.encode(text)
        for k, t in enumerate(block.texts):
            score, same, _, _ = o3.align(t, ids)
            if score >= o3.LEAST_SCORE * o3.MATCH * len(t) and same >= min(o3.LEAST_WORDS, len(t)):
                want.add((i, items[k][0]))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in o3.contamination(docs, bench).collect()} == want and len(want) > 60


def test_op3_recall_by_edits():
    rng = random.Random(12)
    items = [(i, prose(6000 + i, 40)) for i in range(50)]
    block = o3.Items(items)
    for rate, least in ((0.1, 1.0), (0.2, 0.95), (0.3, 0.9)):
        texts = [" ".join(prose(7000 + i, 80).split() + edited(rng, t.split(), rate) + prose(8000 + i, 80).split()) for i, t in items]
        assert sum(i in {m[0] for m in o3.matches(block, t)} for i, t in enumerate(texts)) >= least * len(items), rate


def test_op3_bound_is_no_less_than_any_alignment():
    rng = np.random.default_rng(3)
    block = o3.Items([(0, "a b c a d e f g h a")])
    for _ in range(100):
        passage = rng.integers(-1, len(block.number), rng.integers(1, 60))
        score, same, _, _ = o3.align(block.texts[0], passage)
        assert same <= block.bound(0, passage) and score <= o3.MATCH * block.bound(0, passage)


def test_op3_other_id_types(spark, hard):
    docs = spark.createDataFrame([(None, prose(9100, 60)), (b"k", prose(9100, 60)), (b"k", prose(9100, 60))], "doc_id binary, text string")
    bench = spark.createDataFrame([(None, prose(9100, 60))], "item_id decimal(5,2), text string").union(spark.createDataFrame([(1.5, prose(9100, 60))], "item_id double, text string").selectExpr("cast(item_id as decimal(5,2))", "text"))
    assert o3.contamination(docs, bench).count() == 6


# ---- 6 ------------------------------------------------------------------------------
def test_op6_exact_and_gapless(hard, small, none):
    for docs in (hard, small["documents"]):
        texts = sorted((zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1, str(r["doc_id"])) for r in docs.collect())
        rows = o6.digest(docs).collect()
        assert sorted((r["text_crc32"], r["size"], str(r["doc_id"])) for r in rows) == texts
        slots = collections.defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert r["law"] == "rows" and r["grown_shard"] is None
        sizes = [len(slots[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert o6.digest(none).count() == 0


@pytest.mark.parametrize("groups", [4096, 3])
def test_op6_more_partitions_than_groups(spark, monkeypatch, groups):
    monkeypatch.setattr(o6, "GROUPS", groups)
    docs = spark.range(0, 1000, 1, 11).withColumn("text", F.col("id").cast("string")).filter("id < 700 or id > 800")
    rows = o6.shuffle_into_shards(docs, 8, 5).collect()
    assert sorted(r["id"] for r in rows) == [*range(700), *range(801, 1000)]
    sizes = collections.Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert [r["id"] for r in sorted(own, key=lambda r: r["slot"])] != sorted(r["id"] for r in own)  # permuted again


def test_op6_deals_each_partition_at_random(spark):
    """A partition's rows go to shards in no order of their places."""
    first = collections.Counter(r["shard"] for s in range(60) for r in o6.shuffle_into_shards(spark.range(0, 40, 1, 2), 2, s).filter("id = 0").collect())
    assert min(first.values()) >= 15


def test_op6_no_switch_by_partitions(spark, monkeypatch):
    """However many partitions there are, each deals to all shards, and the sizes of blocks and buckets change nothing."""
    docs = spark.range(0, 800, 1, 8).withColumn("part", F.spark_partition_id())
    want = None
    for groups, bucket in ((4096, 8192), (3, 8192), (1, 8)):
        monkeypatch.setattr(o6, "GROUPS", groups)
        monkeypatch.setattr(o6, "BUCKET", bucket)
        got = sorted(tuple(r) for r in o6.shuffle_into_shards(docs, 4, 5).collect())
        want = want or got
        assert got == want
        sent = collections.Counter((part, shard) for _, part, shard, _ in got)
        assert len(sent) == 32 and 8 <= min(sent.values()) and max(sent.values()) <= 45  # 100 rows a partition: 25 on average


def test_op6_one_sampler_at_all_sizes(monkeypatch):
    """Small draws follow the exact law, none takes a sampler that only some sizes have, and exact comparison changes nothing."""

    class Uniforms:  # no other draws than these
        def __init__(self, seed):
            self.random = np.random.default_rng(seed).random

    for good, bad, draws in ((7, 3, 4), (3, 7, 6), (1, 1, 1), (30, 70, 20), (70, 30, 85)):
        rng = Uniforms(4)
        got = collections.Counter(o6.hypergeometric(rng, good, bad, draws) for _ in range(20_000))
        for x in range(draws + 1):
            assert abs(got[x] / 20_000 - math.comb(good, x) * math.comb(bad, draws - x) / math.comb(good + bad, draws)) < 0.015
    edges = [(0, 5, 3), (5, 0, 3), (3, 4, 0), (3, 4, 7), (0, 0, 0)]
    assert [o6.hypergeometric(Uniforms(0), *e) for e in edges] == [0, 3, 0, 3, 0]
    sizes = [(400, 600, 300), (6 * 10**8, 3 * 10**8, 10**6), (6 * 10**8, 7 * 10**8, 10**6), (5 * 10**10, 6 * 10**10, 10**9)]
    plain = [o6.hypergeometric(Uniforms(s), *size) for size in sizes for s in range(30)]
    monkeypatch.setattr(o6.math, "lgamma", lambda x: 1e30)  # every comparison is left to 60 digits
    assert [o6.hypergeometric(Uniforms(s), *size) for size in sizes for s in range(30)] == plain


def test_op6_keeps_columns(hard):
    out = o6.shuffle_into_shards(hard, 3)
    assert set(out.columns) == set(hard.columns) | {"slot"} and out.count() == hard.count()


def test_op6_matrix_margins_and_law():
    m = o6.communication_matrix([10, 0, 25, 7], 4, 1)
    assert [sum(r) for r in m] == [10, 0, 25, 7] and sorted(sum(c) for c in zip(*m, strict=True)) == [10, 10, 11, 11]
    rng = np.random.default_rng(0)
    big = [o6.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(400)]
    assert abs(np.mean(big) - 300_000) < 100 and 380 < np.std(big) < 540
    few = collections.Counter(o6.communication_matrix([2, 2], 2, s)[0][0] for s in range(3000))
    assert abs(few[1] / 3000 - 2 / 3) < 0.04  # hypergeometric: 1/6, 2/3, 1/6


def test_op6_uniform(spark):
    hits = collections.Counter((r["shard"], r["slot"]) for s in range(40) for r in o6.shuffle_into_shards(spark.range(0, 16, 1, 4), 4, s).filter("id = 3").collect())
    assert len(hits) >= 12


# ---- 7 ------------------------------------------------------------------------------
def sets_by_hand(text):
    w = [x.encode() for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components_by_hand(rows):
    sets = {i: sets_by_hand(t or "") for i, t in rows}
    ids, edges = sorted(sets), []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                edges.append((a, b))
    root = forest(edges)
    return {i: (len(s), root.get(i, i)) for i, s in sets.items()}


def copies(seed, n, edits):
    rng, base = random.Random(seed), prose(seed, n).split()
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(n)] = f"edit{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("small_leaf", [2048, 8])
def test_op7_like_brute_force(spark, small, monkeypatch, small_leaf):
    monkeypatch.setattr(o7, "SMALL", small_leaf)
    rows = [(1000 + i, prose(i, 20 + i)) for i in range(30)]
    base = prose(77, 120).split()
    for i in range(60):  # a group of near copies, many of them linked over others only
        rng, w = random.Random(i), list(base)
        for _ in range(i % 5):
            w[rng.randrange(120)] = f"e{i}"
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000 + i, "Same Text of the whole lot here" if i % 2 else "same text of the WHOLE lot here") for i in range(20)]
    rows += [(4000 + i, "four words are here" if i < 2 else "three words here") for i in range(4)] + [(5000, None), (5001, ""), (5002, " \n")]
    if small_leaf == 2048:
        rows += [(r["doc_id"], r["text"]) for r in small["documents"].collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = components_by_hand(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in o7.near_duplicates(docs).collect()}
    assert got == want


def test_op7_hard_rows(hard, none):
    rows = o7.near_duplicates(hard).collect()
    assert len(rows) == hard.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[7][0][1:] == (6, False) and len(by[8]) == 2 and all(x[1:] == (8, True) for x in by[8]) and by[None] == [(2, None, True)]
    assert o7.near_duplicates(none).count() == 0


def test_op7_tokens_estimate():
    rng = np.random.default_rng(5)
    for n, j in ((1, 1.0), (12, 0.8), (400, 0.9), (5000, 0.5)):
        shared = rng.integers(0, 2**63, max(1, int(2 * n * j / (1 + j))), dtype=np.uint64)
        a, b = (np.unique(np.concatenate((shared, rng.integers(0, 2**63, n - len(shared), dtype=np.uint64) if n > len(shared) else shared[:0])) * np.uint64(2)) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((o7.tokens(a) == o7.tokens(b)).mean() - true) < 0.25


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1400)] + [(2000, 2000 + i) for i in range(1, 300)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    want = forest(edges)
    assert got == {v: c for v, c in want.items() if any(x != y and v in (x, y) for x, y in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 10 -----------------------------------------------------------------------------
def check_packing(docs, rows, tokenizer, capacity=2048):
    want = collections.Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_op10_packs_all(hard, small, none, tokenizer):
    check_packing(hard, o10.pack_documents(hard).collect(), tokenizer)
    docs = small["documents"]
    rows = o10.pack_documents(docs).collect()
    assert check_packing(docs, rows, tokenizer) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert o10.pack_documents(none).count() == 0


def test_op10_exchange_levels(small, tokenizer):
    docs = small["documents"]
    rows = o10.pack(o10.pieces(docs), block=25).collect()
    assert check_packing(docs, rows, tokenizer) <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_op10_certificates(small):
    rows = o10.pack(o10.pieces(small["documents"]), block=25).collect()
    assert all(r["block_bins"] >= r["block_bound"] >= 1 for r in rows) and any(r["block_bins"] == r["block_bound"] for r in rows)
    bins = {r["sequence_id"] for r in rows}
    assert len(bins) >= o10.lower_bound(np.array([r["length"] for r in rows]), 2048) and max(r["level"] for r in rows) >= 1


def test_op10_bound_and_bfd():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 2049, 400), np.full(50, 1100), np.array([1025] * 10 + [1023] * 10), np.full(9, 700), np.array([2048]), rng.integers(600, 760, 100)):
        bound = o10.lower_bound(sizes, 2048)
        where, place, free = o10.best_fit_decreasing(sizes, 2048)
        assert -(-sizes.sum() // 2048) <= bound <= len(free)
        assert all(2048 - free[b] == sizes[where == b].sum() for b in range(len(free))) and free.min() >= 0
        where, place, again = o10.fill_by_sums(sizes, 2048)
        assert bound <= len(again) and all(2048 - again[b] == sizes[where == b].sum() for b in range(len(again)))
        for b in range(len(again)):
            at = np.sort(place[where == b])
            assert at[0] == 0 and (np.diff(at) > 0).all()
    assert o10.lower_bound(np.full(50, 1100), 2048) == 50 and o10.lower_bound(np.full(9, 700), 2048) == 5


# ---- pipeline -------------------------------------------------------------------------
def test_pipeline_like_brute_force(spark, tokenizer):
    import corpus_pipeline as p
    from quernstone.llm import op02_toxicity as o2
    from quernstone.llm import op05_secrets as o5

    d = "/root/testdata/sf0.001"
    docs, labels, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    score = o2.Scorer(o2.train(docs, labels))
    rows = {i: t for i, t in rows.items() if score(t) < 0.5}
    comp = components_by_hand(list(rows.items()))
    rows = {i: t for i, t in rows.items() if comp[i][1] == i}
    bench = [(r["item_id"], o3.words(r["text"])) for r in items.collect()]

    def copied(text):
        w = b" " + b" ".join(o3.words(text)) + b" "
        return any(b" " + b" ".join(x) + b" " in w for _, x in bench)

    rows = {i: o5.redact_text(t) for i, t in rows.items() if not copied(t)}
    out = p.run(spark, d).collect()
    kept = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    check_packing(kept, out, tokenizer)


def test_stages_bear_hard_rows(spark, hard, none, tmp_path):
    import corpus_pipeline as p

    for docs in (hard, none):
        for name, stage in p.STAGES:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()


def test_near_dedup_stage_keeps_rows_without_id(spark):
    import corpus_pipeline as p

    rows = [(None, prose(1, 30)), (None, prose(2, 30)), (1, prose(3, 30)), (1, prose(3, 30)), (2, prose(4, 30)), (3, prose(4, 30)), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in p.near_dedup(spark, docs, "").collect()) == ["1", "2", "4", "None", "None"]


def test_near_dedup_stage_of_one_id_and_several_texts(spark):
    """A text that is like no other stays, whatever stands under its id; the same rows stay each time."""
    import corpus_pipeline as p

    rows = [(1, prose(1, 40), "z"), (5, prose(1, 40), "b"), (5, prose(5, 40), "b"), (5, prose(5, 40), "a"), (6, prose(6, 40), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (1, 4):
        got = p.near_dedup(spark, docs.repartition(n), "").collect()
        texts = [r["text"] for r in got]
        assert sorted(texts) == sorted({prose(k, 40) for k in (1, 5, 6)}) and [r["source"] for r in got if r["text"] == prose(5, 40)] == ["a"]


def test_run_removes_what_it_needs_no_more(spark, tmp_path):
    import os

    import corpus_pipeline as p
    from quernstone.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    p.run(spark, "/root/testdata/sf0.001").count()
    new = [x for x in os.listdir(folder) if x not in before]
    assert [os.listdir(f"{folder}/{x}") for x in new if x.startswith("pipeline-")] == [["secrets"]]
    assert sum(x.startswith("rdd-") for x in new) <= 3  # of the last stage, whose result isn't read when run() returns


def test_op7_large_groups_make_rows_in_proportion(spark, monkeypatch):
    """A group of near copies that branching can't part: rows of all steps stay in proportion, results are exact."""
    monkeypatch.setattr(o7, "SMALL", 64)
    monkeypatch.setattr(o7, "SAMPLE", 32)
    made, real = [], o7.cut

    def count(df):
        out = real(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(o7, "cut", count)
    base = prose(31, 150).split()
    rows = []
    for i in range(1200):
        rng, w = random.Random(i), list(base)
        for _ in range(1 if i < 900 else 4):  # linked with all others, or with few
            w[rng.randrange(150)] = f"e{i}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in o7.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: c for i, (_, c) in components_by_hand(rows).items()}
    assert max(made) <= 120 * len(rows)


def test_op7_splits_leaves_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(o7, "GRAMS", 3000)
    rows = [(i, copies(5, 400, i % 7)) for i in range(30)] + [(100 + i, prose(i, 300)) for i in range(10)]
    got = {r["doc_id"]: r["component_id"] for r in o7.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in components_by_hand(rows).items()}


def test_op7_all_intersections_at_once():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 60)).astype(np.uint64)) for _ in range(40)]
    n = np.array([len(s) for s in sets])
    found = o7.all_linked(*o7.shared_places(sets), n)
    assert all(bool(found[i, j]) == o7.linked(sets[i], sets[j]) for i in range(40) for j in range(40))
    pieces = np.array([0, 1, 2, 3, 3, 5])
    near = np.zeros((6, 6), bool)
    near[0, 2] = near[2, 0] = near[1, 3] = near[3, 1] = True
    assert sorted(o7.joined(near, pieces)) == [(2, 0), (3, 1)]
