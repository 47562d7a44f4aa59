"""Exact round trips of the coder and of files; checksums; the cached encoder against the library."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import token_files as T
from sparkloom.llm import word_ids
from sparkloom.llm.queries import WORD_BPE

ENCODER = word_ids.WordEncoder(open(WORD_BPE).read())
PLAIN = Tokenizer.from_file(WORD_BPE)


def library(text):
    return np.array(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet="aAéÉİǅß'’.,!|$ \n\t \u001ćΣσ9٣", max_size=40))
def test_encoder_is_the_library(text):
    assert ENCODER(text.encode()) == library(text)


def test_encoder_after_its_cache_overflows(monkeypatch):
    monkeypatch.setattr(word_ids, "CACHE_ENTRIES", 20)
    small = word_ids.WordEncoder(open(WORD_BPE).read())
    rng = random.Random(2)
    for _ in range(30):
        text = " ".join(f"word{rng.randrange(60)}{rng.choice(['', '.', '!!'])} Élan{rng.randrange(9)}" for _ in range(40))
        assert small(text.encode()) == library(text)


@pytest.mark.parametrize("n", [1, 511, 512, 513, 70_000, 140_000])
def test_coder_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
    coder = T.RangeCoder(T.scaled_frequencies(np.bincount(ids)))
    states, words, marks = coder.encode(ids)
    assert (coder.decode(n, states, words) == ids).all()
    step = T.CHECKPOINT * T.LANES
    for k in range(1, len(marks) // 8 // (T.LANES + 1) + 1):
        assert (coder.decode(n, states, words, marks, k) == ids[k * step :]).all()
    entropy = -sum(c / n * np.log2(c / n) for c in np.bincount(ids) if c)
    assert len(words) * 8 <= n * entropy * 1.01 + 64


def test_frequencies_sum_up_and_miss_nothing():
    counts = np.array([0, 1, 10**9, 0, 3, 1])
    found = T.scaled_frequencies(counts)
    assert found.sum() == T.SCALE and ((found > 0) == (counts > 0)).all()
    assert T.scaled_frequencies(np.zeros(4, np.int64)).sum() == 0


def check(spark, docs, path, end_id=1, key=0):
    T.write_token_files(docs, path, WORD_BPE, end_id)
    found = T.read_token_files(spark, path).collect()
    end = np.array([end_id], "<u4").tobytes()
    rows = [(r["doc_id"], library(r["text"] or "") + end) for r in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or key, zlib.crc32(r[1])))
    at, expected = 0, []
    for doc, ids in rows:
        expected.append((doc, at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in found), key=lambda r: r[1]) == expected


def test_files(spark, sf_dir, tmp_path):
    extra = [(None, "first of all"), (900_001, None), (900_002, ""), (900_003, "word! " * 9000), (900_004, "twice a"), (900_004, "twice b"), (900_004, "twice b")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    check(spark, docs.withColumn("shard", F.lit("x")).withColumn("ids", F.lit(1)), str(tmp_path / "files"))


def test_no_rows_and_one_row(spark, tmp_path):
    check(spark, spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    check(spark, spark.createDataFrame([(5, "a")], "doc_id long, text string"), str(tmp_path / "one"))


def test_ids_of_other_types(spark, tmp_path):
    rows = [("b", "one"), ("a", "two words"), (None, "none"), ("a", "two words"), ("é", "x"), ("a", "other")]
    check(spark, spark.createDataFrame([(r[0] or None, r[1]) for r in rows], "doc_id string, text string"), str(tmp_path / "text"), key="")
    check(spark, spark.createDataFrame([(k % 7, f"text {k}") for k in range(40)], "doc_id smallint, text string"), str(tmp_path / "small"))


def test_one_id_over_many_shards(spark, tmp_path):
    check(spark, spark.createDataFrame([(5, f"the same id {k % 40}") for k in range(120)] + [(k, "x") for k in range(30)], "doc_id long, text string"), str(tmp_path / "hot"))
    assert spark.read.parquet(f"{tmp_path}/hot/blocks").where("array_contains(doc_ids, 5L)").select("shard").distinct().count() > 1


def test_damage_is_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"some words {k} and more of them") for k in range(50)], "doc_id long, text string")
    T.write_token_files(docs, str(tmp_path / "good"), WORD_BPE, 1)
    blocks = spark.read.parquet(str(tmp_path / "good/blocks"))
    blocks.withColumn("ids_crc32", F.col("ids_crc32").bitwiseXOR(F.lit(1))).write.parquet(str(tmp_path / "bad/blocks"))
    for part in ("frequencies", "shards"):
        spark.read.parquet(str(tmp_path / "good" / part)).write.parquet(str(tmp_path / "bad" / part))
    with pytest.raises(Exception, match="checksum differs"):
        T.read_token_files(spark, str(tmp_path / "bad")).collect()


def test_cache_is_bounded_within_a_text(monkeypatch):
    monkeypatch.setattr(word_ids, "CACHE_ENTRIES", 20)
    small, text = word_ids.WordEncoder(open(WORD_BPE).read()), " ".join(f"w{k}x" for k in range(1000))
    assert small(text.encode()) == ENCODER(text.encode()) and len(small.pieces) <= 20
