"""Token counts, decontamination and URL filters against plain versions."""

import random
import re
import time

import pytest
from tokenizers import models

from sparkloom.llm import decontaminate as D
from sparkloom.llm import queries as Q
from sparkloom.llm import token_counts as T
from sparkloom.llm import url_filter as U

# Token counts


def word_piece(first, continuing):
    vocabulary = {"[UNK]": 0}
    for piece in [*first, *("##" + c for c in continuing)]:
        vocabulary.setdefault(piece, len(vocabulary))
    return models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6)


def plain_counts(model, text):
    words = [w for run in (text or "").encode().split() for w in T._PART.findall(run.decode())]
    found = [model.tokenize(w) for w in words]
    return len(words), sum(map(len, found)), sum(f[0].value == "[UNK]" for f in found)


def test_automaton_on_small_vocabularies():
    rng = random.Random(2)
    for _ in range(2000):
        piece = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
        first, continuing = {piece() for _ in range(5)}, {piece() for _ in range(5)}
        word = "".join(rng.choice("abbaac"[: rng.choice([5, 6])]) for _ in range(rng.randint(1, 14)))
        found = word_piece(sorted(first), sorted(continuing)).tokenize(word)
        assert T.LongestMatch(first, continuing).count(word) == (-1 if found[0].value == "[UNK]" else len(found))


def test_counts_of_documents(spark, sf_dir):
    pieces = T.sentence_pieces(Q.PIECES)
    model = word_piece(*pieces)
    odd = [(-1, None), (-2, ""), (-3, " \t"), (-4, "a,b--c\x1cd"), (-5, "日本 ﷺ \U0001f600"), (-6, "ab" * 1500), (-1, None)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    found = T.count_tokens(docs.selectExpr("*", "1 AS n_tokens"), *pieces).collect()
    want = [(r["doc_id"], *plain_counts(model, r["text"])) for r in docs.collect()]
    assert sorted(map(tuple, found)) == sorted(want)
    assert T.count_tokens(docs.limit(0), *pieces).collect() == []
    assert [tuple(r) for r in T.count_tokens(docs.where("doc_id = -4"), [], []).collect()] == [(-4, 6, 6, 6)]


# Decontamination


def plain_tiled(doc, item, match):
    """Greedy string tiling by trying every pair of places."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best, found = match - 1, []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_i[i + n] and free_d[d + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, d)]
                elif n == best and n >= match:
                    found.append((i, d))
        if not found:
            return covered
        for i, d in found:
            if all(free_i[i : i + best]) and all(free_d[d : d + best]):
                free_i[i : i + best] = free_d[d : d + best] = [False] * best
                covered += best


def test_tiling():
    rng = random.Random(7)
    for _ in range(400):
        doc, item = ([rng.randrange(4) for _ in range(rng.randrange(30))] for _ in range(2))
        assert D.tiled(doc, item, 3) == plain_tiled(doc, item, 3)


ITEM = "the quick brown fox jumps over the lazy dog while nine old wizards quietly mix potions near a river bank"


def leaked(spark, texts, items, **how):
    docs = spark.createDataFrame([(k, t, 1, "k") for k, t in enumerate(texts)], "doc_id long, text string, item_id int, text_key string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id smallint, text string")
    rows = D.leaks(docs, bench, **how).collect()
    kept = {r["doc_id"] for r in D.keep_clean(docs, bench, **how).collect()}
    assert D.keep_clean(docs, bench, **how).columns == docs.columns
    assert kept == set(range(len(texts))) - {r["doc_id"] for r in rows}
    return sorted((r["doc_id"], r["item_id"], r["covered_words"]) for r in rows)


def test_tiling_of_repeated_words_is_quick():
    began = time.perf_counter()
    assert D.tiled([1] * 2000, [1] * 2000, 5) == 2000
    assert time.perf_counter() - began < 0.1
    began = time.perf_counter()
    assert D.tiled([1, 2] * 1000, [2, 1] * 400, 5) == 800
    assert time.perf_counter() - began < 0.1


def texts_and_leaks():
    words = ITEM.split()
    filler = "unrelated words that stand around it " * 30
    texts = [
        filler + ITEM + " " + filler,  # whole
        ITEM.upper().replace(" ", ",\n"),  # other case and marks
        " ".join(words[10:] + ["and"] + words[:10]),  # reordered
        " ".join(words[:10]),  # half
        " ".join(words[:9] + ["red"] + words[10:]),  # one word changed
        " ".join(sorted(words)),  # same words only
        None, "", filler, ITEM, ITEM,
    ]
    return texts, [(0, 0, 20), (1, 0, 20), (2, 0, 20), (4, 0, 19), (9, 0, 20), (10, 0, 20)]


@pytest.mark.parametrize("filter_bits", [1 << 27, 64])
def test_leaks_of_a_large_benchmark(spark, monkeypatch, filter_bits):
    monkeypatch.setattr(D, "BLOCK_WORDS", 0)
    monkeypatch.setattr(D, "FILTER_BITS", filter_bits)
    texts, expected = texts_and_leaks()
    items = [ITEM, "", None, "one two", "stand around", ITEM, "nothing of the kind here at all"]
    assert leaked(spark, texts, items) == sorted([*expected, *((d, 5, n) for d, _, n in expected), (0, 4, 2), (8, 4, 2)])


def test_leaks(spark):
    texts, expected = texts_and_leaks()
    assert leaked(spark, texts, [ITEM]) == expected
    assert leaked(spark, texts, [ITEM, "", None, "one two"]) == expected
    assert leaked(spark, texts, [ITEM, "nothing of the kind here at all", ITEM]) == sorted(expected + [(d, 2, n) for d, _, n in expected])
    assert leaked(spark, texts, ["one two", "stand around"]) == [(0, 1, 2), (8, 1, 2)]  # shorter than a seed: whole
    assert leaked(spark, texts, []) == [] and leaked(spark, [], [ITEM]) == []


@pytest.mark.parametrize("block", [500_000, 10])
def test_leaks_query(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)  # 10: the way of a large benchmark
    docs = {r["doc_id"]: D.words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: D.words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for i, item in items.items():
        seeds = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
        for d, words in docs.items():
            if seeds & {tuple(words[k : k + 5]) for k in range(len(words) - 4)}:
                number = {}
                ids = [[number.setdefault(w, len(number)) for w in x] for x in (words, item)]
                if plain_tiled(*ids, 5) >= 0.8 * len(item):
                    want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in Q.op5_decontaminate(spark, sf_dir).collect()} == want and want


# URL filters


def plain_verdict(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.action), default=None)
    return host, path, best and best.host + best.path, best.action if best else default


URLS = [
    None, "", "no mark", "http://", "http://COM", "HTTP://a.Example.COM/en/7", "http://example.com/en/71?x=/de/", "http://example.com/en", "http://example.com/en/", "http://badexample.com/en/7", "https://x.org/es/#a?b", "https://x.org?/es/", "ftp://a.b.example.net/de/8/9", "http://example.net/de/7",
    "a://b://c/en/", "http://com:80/en/", "http://..com/en/x", "http://Éx.com/en/\n", "http://net/de/" + "x" * 5000,
]


@pytest.mark.parametrize("most, hot", [(100_000, 1 << 20), (0, 1 << 20), (0, 3)])
def test_url_rules(spark, monkeypatch, most, hot):
    monkeypatch.setattr(U, "MAX_TRIE_RULES", most)
    rng = random.Random(3)
    rules = [*Q.URL_RULES, U.UrlRule("block", "com", ""), U.UrlRule("allow", "com", ""), U.UrlRule("allow", "a.example.com", "/en"), U.UrlRule("block", "x.com", "/a/b")]
    urls = URLS + [f"http://{'.'.join(rng.choice(['a', 'x', 'example', 'com', 'net']) for _ in range(rng.randint(1, 4)))}/{'/'.join(rng.choice(['a', 'b', 'en', 'de', '7', '8']) for _ in range(rng.randint(0, 3)))}" for _ in range(400)]
    urls += ["http://example.com/en/7"] * 200  # one URL in a quarter of the rows
    df = spark.createDataFrame([(k, u, 1, "c", k, "p", -k) for k, u in enumerate(urls)], "page_id long, url string, host int, url_verdict string, __url int, __parts string, __Key int")
    for given in (rules, spark.createDataFrame(rules, "action string, host string, path string")):
        found = U.judge_urls(df, given, hot_host=hot)
        assert sorted(found.columns) == sorted(df.columns)
        rows = found.collect()
        assert len(rows) == len(urls)
        for r in rows:
            k = r["page_id"]
            assert (r["__url"], r["__parts"], r["__Key"]) == (k, "p", -k)
            assert tuple(r["url_verdict"]) == plain_verdict(urls[k], rules), urls[k]


def test_long_urls_are_linear():
    trie = U.UrlTrie([U.UrlRule("block", "com", "/aaa"), U.UrlRule("allow", "com", "/a")])
    began = time.perf_counter()
    for _ in range(20):
        assert trie.match(*U.split_url("http://com/" + "a" * 1_000_000)).path == "/aaa"
        assert trie.match(*U.split_url("http://" + "a." * 200_000 + "com/" + "a/" * 200_000)).path == "/a"
    assert time.perf_counter() - began < 10


def test_url_rules_on_nothing(spark, monkeypatch):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(df, Q.URL_RULES).collect() == []
    one = spark.createDataFrame([("http://a.com/",)], "url string")
    assert tuple(U.judge_urls(one, [], default="block").first()["url_verdict"]) == ("a.com", "/", None, "block")
    none = spark.createDataFrame([], "action string, host string, path string")
    assert tuple(U.judge_urls(one, none).first()["url_verdict"]) == ("a.com", "/", None, "allow")
    monkeypatch.setattr(U, "MAX_TRIE_RULES", -1)
    assert tuple(U.judge_urls(one, none).first()["url_verdict"]) == ("a.com", "/", None, "allow")
    assert U.judge_urls(df, Q.URL_RULES).collect() == []
