"""The corpus pipeline against its operators' plain versions, stage by stage; the queries against their SQL."""

import random

import corpus_pipeline
import duckdb
import pytest

from sparkloom.llm import queries as Q
from tests.llm.test_simhash_dedup import plain_components, plain_fingerprint
from tests.test_queries import rows_of


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after = {r["doc_id"] for r in docs.collect()}
        assert after < set(before) or name == "quality classifier"
        if name == "near-duplicates":
            assert after == {d for d, c in plain_components([(d, plain_fingerprint(t)) for d, t in sorted(before.items())]) if d == c}
        if name == "decontamination":
            leaks = {r["doc_id"] for r in Q.op5_decontaminate(spark, sf_dir).collect()}
            assert after == set(before) - leaks
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == after
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)


def test_classifier_removes_bad_documents_that_the_rules_leave(spark, tmp_path):
    """All labelled bad documents have symbols and go by a rule; the planted ones have their words only."""
    rng = random.Random(4)
    good = "stone river walks under green light sings every morning slowly".split()
    bad = "prize bonus click today offer money claim winner instant reward".split()
    rows, labels = [], []
    for k in range(600):
        kind = "bad" if k % 3 == 0 else "planted" if k % 30 == 1 else "good"
        words = [rng.choice(good if kind == "good" else bad) for _ in range(rng.randrange(60, 120))]
        if kind == "bad":
            words[::6] = [w + "***" for w in words[::6]]
        rows.append((k, " ".join(words)))
        if kind != "planted":
            labels.append((k, int(kind == "good"), 0))
    labels += [(k, 1, 0) for k in range(10_000, 12_000)]  # of documents that aren't there
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.rules(spark, docs, str(tmp_path))
    before = {r["doc_id"] for r in left.collect()}
    assert all(k % 3 for k in before) and sum(k % 30 == 1 for k in before) > 15
    kept = {r["doc_id"] for r in corpus_pipeline.classifier(spark, left, str(tmp_path)).collect()}
    planted = {k for k in before if k % 30 == 1}
    assert not kept & planted and len(kept) >= 0.98 * len(before - planted)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = Q.queries()[name](spark, sf_dir)
    cursor = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(columns, cursor.fetchall())
