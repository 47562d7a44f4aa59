"""A corpus through five operators: rules, classifier, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; the side tables are read from ``sf_dir``. All stages but the last return
the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, packing, quality_classifier, quality_rules, simhash_dedup
from sparkloom.llm._common import table, written
from sparkloom.llm.queries import WORD_BPE


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents: the rules leave no bad ones to learn from.
    A document goes if bad is four times as likely as good."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"), least=0.2, learn_from=table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near-duplicates", near_dedup),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

#: Learned models, a compressor and a tokenizer: beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
