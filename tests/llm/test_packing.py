"""Plans against exhaustive search; pieces against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from sparkloom.llm import packing as P
from sparkloom.llm import queries as Q
from sparkloom.llm.queries import WORD_BPE


def exact(lengths, capacity):
    """Least number of bins, by search over assignments."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in {bins[i]: i for i in range(len(bins))}.values():
            if bins[b] + lengths[k] <= capacity:
                bins[b] += lengths[k]
                go(k + 1, bins)
                bins[b] -= lengths[k]
        bins.append(lengths[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best


def holds(plan, counts, capacity):
    used = Counter()
    for filling, bins in plan:
        assert sum(n * t for n, t in filling) <= capacity and bins > 0
        for n, t in filling:
            used[n] += t * bins
    assert used == Counter({k: v for k, v in counts.items() if v})


def test_small_plans_are_the_best():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 20, 37])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
        counts = Counter(lengths)
        packed = P.complete_bins(dict(counts), capacity)
        holds(packed.plan, counts, capacity)
        assert P.total_bins(packed.plan) == exact(lengths, capacity)
        assert packed.completed and packed.proven and packed.lower_bound <= P.total_bins(packed.plan)


def test_better_than_best_fit():
    """Best fit opens a bin too many; completion finds the plan without it."""
    better = 0
    rng = random.Random(11)
    for _ in range(60):
        lengths = [rng.randint(20, 70) for _ in range(rng.randint(10, 24))]
        counts = Counter(lengths)
        packed, fit = P.complete_bins(dict(counts), 100), P.best_fit_decreasing(dict(counts), 100)
        holds(packed.plan, counts, 100)
        assert packed.completed and P.total_bins(packed.plan) <= P.total_bins(fit)
        better += P.total_bins(packed.plan) < P.total_bins(fit)
    assert better > 2
    assert P.total_bins(P.complete_bins({6: 2, 5: 2, 4: 2, 3: 4, 2: 2}, 10).plan) == 5


def test_large_plans_are_at_the_lower_bound():
    rng = random.Random(8)
    counts = Counter(min(2048, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(20_000))
    packed = P.complete_bins(counts, 2048)
    holds(packed.plan, counts, 2048)
    assert packed.completed and packed.proven and packed.branchings > 100
    assert P.total_bins(packed.plan) == packed.lower_bound == -(-sum(k * v for k, v in counts.items()) // 2048)


def test_search_that_is_cut_off_gives_the_incumbent():
    counts = {k: 3 for k in range(1, 60)}
    packed = P.complete_bins(counts, 100, nodes=2)
    assert (packed.branchings, packed.completed) == (2, False)
    assert packed.plan == P.best_fit_decreasing(counts, 100)


def test_lower_bounds_hold():
    rng = random.Random(3)
    for _ in range(80):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        by_length = np.bincount(lengths, minlength=21)
        assert -(-sum(lengths) // 20) <= P.lower_bound(by_length) <= exact(lengths, 20)


def test_the_query_is_packed_by_completion(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = {r["length"]: r["count"] for r in P.token_pieces(docs, WORD_BPE).groupBy("length").count().collect()}
    packed = P.complete_bins(counts, 2048)
    assert packed.completed and packed.proven and packed.branchings >= len([k for k in counts if k < 2048]) // 2
    found = Q.op9_best_fit_packing(spark, sf_dir).collect()
    assert len({r["sequence_id"] for r in found}) == P.total_bins(packed.plan) == packed.lower_bound


def test_pieces_fill_sequences(spark, sf_dir):
    extra = [(900_001, None), (900_002, ""), (900_003, "word " * 9000), (900_003, "word " * 9000), (None, "no id")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    docs = docs.selectExpr("*", "1 AS length", "'x' AS bucket")
    found = P.pack_documents(docs, WORD_BPE).collect()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    expected = Counter()
    for row in docs.collect():
        ids = np.array([*tokenizer.encode(row["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[row["doc_id"], piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    bound = -(-sum(r["length"] for r in found) // 2048)
    assert len(bins) <= bound + 1


def test_no_documents(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORD_BPE).collect() == []
