"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on blocks of labelled good texts,
one on blocks of labelled bad texts. A text is compressed whole, in blocks of
``BLOCK`` bytes, once with either; (bad size - good size) / (bad size + good
size) says which it resembles, and a logistic curve fitted on other labelled
texts turns that into the probability of label 1.

Bounds, all parameters of ``fit``: ``per_class`` labelled documents of each
label are sampled by hash; half of them give up to ``blocks`` blocks of each
label to the dictionaries, the other half fit the curve, weighted to the shares
of the labels. All else is one pass over the rows without a shuffle; the
dictionaries (``dictionary_bytes`` each at most) go to all tasks.

Defined cases: null and empty texts score like a text of which nothing is
known, the curve's value at 0; with labels of one kind only, or none, every
text has the share of label 1 (0.5 without labels) as its score; labels of
documents that aren't there count for nothing; repeated rows score alike; an
empty table gives no rows; other columns pass through ``keep_good`` whatever
their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import checkpointed, free_names
from sparkloom.llm.labelled import document_labels, sampled, with_sample

PER_CLASS, BLOCKS, BLOCK, LEVEL, DICTIONARY_BYTES = 3000, 6000, 128, 3, 1 << 16


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -30, 30)))


class Compared:
    """Normalised size differences by two dictionaries."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.coders = []
        for content in (good, bad):
            if content:
                held = zstandard.ZstdCompressionDict(content)
                held.precompute_compress(level=LEVEL)
                self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes | None) -> float:
        if not text or len(self.coders) < 2:
            return 0.0
        good, bad = (sum(len(c.compress(text[k : k + BLOCK])) for k in range(0, len(text), BLOCK)) for c in self.coders)
        return (bad - good) / (bad + good)


#: The dictionaries last used and their name, so that the tasks of a Python worker share one pair.
_HELD: list[tuple[str, Compared]] = []


def _shared(name: str, good: bytes, bad: bytes) -> Compared:
    if not _HELD or _HELD[0][0] != name:
        _HELD.clear()  # before the next is built
        _HELD.append((name, Compared(good, bad)))
    return _HELD[0][1]


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            data = text.as_py() or b""
            parts = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(parts), pa.int32()), pa.array(parts, pa.binary())], names=["label", "block"])


def _differences(good: bytes, bad: bytes):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compared = _shared(name, good, bad)
        for texts in batches:
            yield pd.Series([compared.difference(t) for t in texts], dtype="float64")

    return F.pandas_udf(run, "double")


def _dictionary(blocks: list[bytes], size: int) -> bytes:
    """Trained if there is enough to train on, else the blocks as they are."""
    total = sum(map(len, blocks))
    try:
        return zstandard.train_dictionary(max(256, min(size, total // 10)), blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a little shrinkage of the slope."""
    scale = float(np.abs(x).mean()) or 1.0
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - np.array([1e-2, 0]) * w
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_class: int = PER_CLASS, blocks: int = BLOCKS, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """``keep``: which rows of ``labels`` may be learned from; labels of
    documents that ``docs`` lacks don't count."""
    present = docs.select("doc_id").distinct()
    sample, totals = sampled(checkpointed(document_labels(labels, keep=keep).join(present, "doc_id", "left_semi")), per_class)
    good, bad = totals.get(1, 0), totals.get(0, 0)
    if not good or not bad:
        share = (good + 0.5) / (good + bad + 1) if good + bad else 0.5
        return Model(b"", b"", 0.0, math.log(share / (1 - share)))
    rows = checkpointed(with_sample(docs, sample))
    teach = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)) == 0
    cut = rows.where(teach).select("label", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).mapInArrow(_blocks, "label int, block binary")
    found = {k: [bytes(r["block"]) for r in cut.where(F.col("label") == k).orderBy(F.xxhash64("block"), "block").limit(blocks).collect()] for k in (0, 1)}
    trained = [_dictionary(found[k], dictionary_bytes) if found[k] else b"" for k in (1, 0)]
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    seen = rows.where(~teach).select("label", _differences(*trained)(text).alias("x")).collect()  # at most 2 * per_class rows
    x, y = np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen], float)
    if not len(x) or len(set(y)) < 2:
        return Model(*trained, 0.0, math.log(good / bad))
    weight = np.where(y == 1, good / max(1, (y == 1).sum()), bad / max(1, (y == 0).sum()))
    return Model(*trained, *_logistic(x, y, weight / weight.mean()))


def score(model: Model, text: Column) -> Column:
    """Probability of label 1, from 0 to 1."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compared = _shared(name, model.good, model.bad)
        for texts in batches:
            yield pd.Series(model.probability(np.array([compared.difference(t) for t in texts], dtype="float64")))

    return F.pandas_udf(run, "double")(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, keep: Column | None = None, learn_from: DataFrame | None = None, **bounds: int) -> DataFrame:
    """``docs`` whose score is ``least`` or more. ``learn_from``: the labelled
    documents, where ``docs`` no longer has those that a stage before rejected."""
    model = fit(docs if learn_from is None else learn_from, labels, keep, **bounds)
    (name,) = free_names("score", beside=docs)
    scored = docs.withColumn(name, score(model, F.col("text")))
    return scored.where(F.col(name) >= least).select(*(F.col(f"`{c}`") for c in docs.columns))
