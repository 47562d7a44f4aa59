"""Bounded samples of labelled documents, to fit models on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_labels(labels: DataFrame, label: str = "quality", keep: Column | None = None) -> DataFrame:
    """doc_id and label (0 or 1), one row a document: the more frequent of its
    labels, 1 on a tie; rows with a null or another value don't count."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.where(keep) if keep is not None else rows
    return rows.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))


def sampled(labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` documents of each label, those of least hash, and
    how many labelled documents of each there are."""
    totals = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}  # two rows
    order = F.xxhash64(F.col("doc_id").cast("string"))
    first, second = (labels.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1))
    return first.union(second), totals


def with_sample(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The sampled documents' rows (doc_id, label, text); the sample is bounded, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
