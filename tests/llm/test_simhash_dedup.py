"""Anchor covering against all pairs; fingerprints against a plain count of bits."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sparkloom.llm import simhash_dedup as S


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(k)] = min(doc, least.get(root(k), doc))
    return sorted(((doc, least.get(root(k))) for k, (doc, _) in enumerate(rows)), key=str)


TEXTS = [None, "", " \t\n", "one", "one two", "ONE TWO", "One two three", "one two three four", "Émile A B c d e", "a\x1cb c d e f g", "x " * 3000]


def test_fingerprints():
    for text in TEXTS:
        assert S.fingerprint(text and text.encode()) == plain_fingerprint(text)


def test_codes_cover_and_meet():
    rng = np.random.default_rng(3)
    for distance in (0, 1, 3, 5, 7):
        for _ in range(60):
            x = rng.integers(0, 1 << 64, dtype=np.uint64)
            y = x
            for bit in rng.permutation(64)[:distance]:
                y ^= np.uint64(1) << np.uint64(bit)
            meets = False
            for code in S.covering(distance):
                _, at_x, home = code.anchors(np.array([x]))
                _, at_y, _ = code.anchors(np.array([y]))
                assert home.sum() == 1
                meets |= bool({*at_x[home]} & {*at_y})
            assert meets


def near_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 40, 200]))] for _ in range(6)]
    out = []
    for _ in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(" ".join(text))
    return out


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = S.near_duplicates(docs).collect()
    prints = [(doc, plain_fingerprint(text)) for doc, text in rows]
    assert sorted((r["doc_id"], r["fp"] % 2**64) for r in found if r["doc_id"] is not None) == sorted(p for p in prints if p[0] is not None)
    assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=str) == plain_components(prints)


def test_against_all_pairs(spark):
    check(spark, [*enumerate(near_texts(1, 150)), *((1000 + k, t) for k, t in enumerate(TEXTS)), (None, "one two"), (None, "alone here now ok"), (5, "repeated row of a doc"), (5, "repeated row of a doc")])


def test_heavy_anchors_are_dealt(spark):
    rows = [*enumerate(near_texts(2, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fps = S.fingerprints(docs).select("fp").distinct()
    one = {(r["node"], r["root"]) for r in S.components(S.links(fps)).collect()}
    for cell in (1, 3, 20):
        assert one == {(r["node"], r["root"]) for r in S.components(S.links(fps, cell=cell)).collect()} and one


def test_groups_over_many_batches(monkeypatch):
    monkeypatch.setattr(S, "CELL", 2)
    rng = np.random.default_rng(5)
    anchor = np.sort(rng.integers(0, 9, 300))
    fp = rng.permutation(300).astype(np.int64) % 64 | anchor << 40
    home = rng.random(300) < 0.4
    rows = pa.table([pa.array(anchor), pa.array(np.zeros(300, np.int32)), pa.array(home), pa.array(fp)], names=["anchor", "cell", "home", "fp"])
    pairs = lambda size: {p for b in S._meet(2)(rows.to_batches(max_chunksize=size)) for p in zip(*(c.to_pylist() for c in b.columns))}
    want = plain_roots([(x, y) for i, x in enumerate(fp) for j, y in enumerate(fp) if home[i] and anchor[i] == anchor[j] and x != y and int(x ^ y).bit_count() <= 2])
    for size in (1, 7, 300):
        assert plain_roots(pairs(size)) == want and want


def plain_roots(edges):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for x, y in edges:
        a, b = sorted((find(int(x)), find(int(y))))
        root[b] = a
    return {x: find(x) for x in root}


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string, fp string")).collect() == []


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 900), (900, 950)], "a long, b long")
    assert {(r["node"], r["root"]) for r in S.components(edges).collect()} == {(k, 0) for k in range(201)} | {(n, 900) for n in (900, 950, 1000)}


def test_hubs_are_dealt(spark):
    edges = spark.createDataFrame([(5, k) for k in range(6, 900)] + [(2000 + k, 899) for k in range(50)], "a long, b long")
    assert {r["root"] for r in S.components(edges).collect()} == {5}


def test_one_of_each_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 9, "x"), (2, "a b c d", 8, "y"), (3, "e f g h", 7, "z")], "doc_id long, text string, fp int, component_id string")
    assert S.one_of_each(docs).columns == docs.columns
    assert {r["doc_id"] for r in S.one_of_each(docs).collect()} == {1, 3}


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_one_of_each_of_odd_ids(spark, monkeypatch, few):
    """One row a component, whatever doc_ids are null or repeated; no text is lost."""
    monkeypatch.setattr(S, "FEW_GONE", few)
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "other text stands here"), (3, "a b c d"), (None, "none of its kind at all"), (None, "none of its kind at all"), (None, "a b c d"), (4, "last one of the lot"), (4, "and yet another with that id")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, nth int")
    found = S.one_of_each(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == sorted([(1, "a b c d"), (3, "other text stands here"), (0, "none of its kind at all"), (4, "last one of the lot"), (4, "and yet another with that id")])
    assert S.one_of_each(docs).columns == docs.columns
