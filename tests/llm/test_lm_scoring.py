"""Word scores by brute force; the context tree against a plain recursive one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lm_scoring as L
from sparkloom.llm import queries as Q


def kt(zeros, ones):
    """Sequential Krichevsky-Trofimov probability, as a log."""
    out, a, b = 0.0, 0, 0
    for bit in [0] * zeros + [1] * ones:
        out += math.log(((b if bit else a) + 0.5) / (a + b + 1))
        a, b = a + (not bit), b + bit
    return out


def test_kt():
    for a in range(0, 40, 7):
        for b in range(0, 30, 5):
            assert abs(float(L.kt_log(np.array([a]), np.array([b]))[0]) - kt(a, b)) < 1e-9


class PlainTree:
    def __init__(self, texts, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for t in texts:
            line = b"\n" * depth + t
            for k in range(depth, len(line)):
                for j in range(8):
                    prefix = (1 << j) | line[k] >> (8 - j)
                    for d in range(depth + 1):
                        self.counts[line[k - d : k], prefix][line[k] >> (7 - j) & 1] += 1
        self.children = defaultdict(list)
        for context, prefix in list(self.counts):
            if context:
                self.children[context[1:], prefix].append((context, prefix))
        self.memo = {}

    def weighted(self, node):
        if node not in self.memo:
            own = kt(*self.counts[node])
            if len(node[0]) == self.depth:
                self.memo[node] = own
            else:
                self.memo[node] = float(np.logaddexp(own, sum(map(self.weighted, self.children[node])))) - math.log(2)
        return self.memo[node]

    def log10(self, context, byte):
        out = 0.0
        for j in range(8):
            prefix, bit = (1 << j) | byte >> (8 - j), byte >> (7 - j) & 1
            p = None
            for d in range(self.depth, -1, -1):
                node = (context[len(context) - d :], prefix)
                if node in self.counts:
                    c = self.counts[node]
                    own = (c[bit] + 0.5) / (sum(c) + 1)
                    w = math.exp(kt(*c) - math.log(2) - self.weighted(node))
                    p = own if p is None else w * own + (1 - w) * p
            out += math.log10(0.5 if p is None else p)
        return out


def test_tree_is_context_tree_weighting():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abca ") for _ in range(rng.randrange(1, 60))).encode() + b"\n" for _ in range(6)]
    depth = 2
    keys = L.gram_keys(texts, depth)
    grams = []
    for d in range(depth + 1):
        found, n = np.unique(keys & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True)
        grams.append((found, n))
    plain, scorer = PlainTree(texts, depth), L.Scorer(grams)
    fresh = [b"abc zzz abca\n", b"\n", "é".encode() + b"\n"]
    for t in texts + fresh:
        line = b"\n" * depth + t
        expected = sum(plain.log10(line[k - depth : k], line[k]) for k in range(depth, len(line)))
        assert abs(scorer.scores([t])[0] - expected) < 1e-4
    assert np.allclose(scorer.scores(texts + fresh), [scorer.scores([t])[0] for t in texts + fresh], atol=1e-4)


def test_predictions_sum_to_one():
    keys = L.gram_keys([b"some text of letters\n" * 3], 3)
    grams = [np.unique(keys & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True) for d in range(4)]
    for context in (b"ext", b"zzz", b"\n\n\n", b"\xff\x00e"):
        asked = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs((10 ** L.ContextTree(grams).log10(asked)).sum() - 1) < 1e-9


def test_long_texts_in_parts(monkeypatch):
    whole = np.concatenate(list(L._parts(b"abcdefghij" * 9, 3)))
    monkeypatch.setattr(L, "_FLUSH", 7)
    assert (np.concatenate(list(L._parts(b"abcdefghij" * 9, 3))) == whole).all()


def expected_base(rows, held):
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None]
    c = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(k, held(k), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for k, t in rows]


def check(spark, rows, held, column, monkeypatch=None):
    docs = spark.createDataFrame(rows, "doc_id smallint, text string").selectExpr("*", "'q' AS word", "1 AS score")
    found = L.score_documents(docs, column, depth=3).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found), key=key)
    want = sorted(expected_base(rows, held), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    assert all(r["score"] < 0 for r in found)


def test_words_by_head_and_by_join(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the", "The", f"rare{rng.randrange(500)}", "x" * 70, "y" * 90 + "é", "Y" * 90 + "É"]) for _ in range(rng.randrange(30)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, " \n"), (7, "twice the"), (7, "twice the"), (None, "no id the")]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    column = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    check(spark, rows, held, column)
    monkeypatch.setattr(L, "HEAD_WORDS", 0)
    monkeypatch.setattr(L.head_words, "__defaults__", (0,))
    check(spark, rows, held, column)


def test_long_frequent_words_are_in_the_head(spark):
    docs = spark.createDataFrame([(k, "-" * 70 + " other " + "z" * 500) for k in range(30)], "doc_id long, text string")
    head, _ = L.head_words(L.count_words(docs))
    assert len(head) == 4 and L.word_key(b"-" * 70) in head and max(map(len, head)) <= L.HEAD_BYTES


def test_query_scores_are_the_plain_trees(spark, sf_dir):
    """The query's model against the plain tree, at texts that are short enough for it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 400")
    lines = [(r["doc_id"], L.normal_text(L.normal_words((r["text"] or "").encode()))) for r in docs.collect()]
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    plain = PlainTree([t for k, t in lines if not held(k)], L.DEPTH)
    some = lines
    want = {k: sum(plain.log10((b"\n" * L.DEPTH + t)[j : j + L.DEPTH], t[j]) for j in range(len(t))) for k, t in some}
    got = {r["doc_id"]: r["score"] for r in L.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()}
    assert len(some) > 5 and np.allclose([got[k] for k in want], list(want.values()), atol=1e-2)


def test_nothing_to_learn_from(spark):
    check(spark, [(1, "a b"), (2, None)], lambda k: True, F.lit(True))
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).collect() == []


def test_model_beats_words_on_held_out_rows(spark):
    found = Q.op8_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").selectExpr("sum(base_score) AS base", "sum(score) AS own").first()
    assert found["own"] > 0.97 * found["base"]  # negative numbers: fewer bits


@pytest.mark.parametrize("entries", [0, 40, 1 << 22])
def test_whole_tree_with_any_head(spark, monkeypatch, entries):
    monkeypatch.setattr(L, "_SLICE", 50)
    rng = random.Random(8)
    rows = [(k, "".join(rng.choice("abcab é") for _ in range(rng.randrange(1, 90)))) for k in range(40)]
    rows += [(40, None), (41, "zzz xq"), (2, rows[2][1]), (2, rows[2][1])]
    held = lambda k: k % 4 == 1
    depth = 3
    lines = [(k, L.normal_text(L.normal_words((t or "").encode()))) for k, t in rows]
    plain = PlainTree([t for k, t in lines if not held(k)], depth)
    want = sorted((k, sum(plain.log10((b"\n" * depth + t)[j : j + depth], t[j]) for j in range(len(t)))) for k, t in lines)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["score"]) for r in L.score_documents(docs, F.col("doc_id") % 4 == 1, depth=depth, entries=entries).collect())
    assert [k for k, _ in got] == [k for k, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-3)
