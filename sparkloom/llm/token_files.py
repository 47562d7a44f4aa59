"""Token-ID output: blocks coded by static range asymmetric numeral systems.

Files are Parquet rows, one row a block, in shards of ascending doc_id; Spark's
own writer commits them, so a lost executor leaves no half file. Shards are
Spark's range partitions by doc_id, then checksum, then place in the input, so
that one doc_id may span shards. A block holds whole documents and decodes
alone; where its shard begins in the row of all ids is kept in a table of one
row a shard:

* ``states`` and ``words``: the ids, dealt in turn to ``LANES`` coders that
  share one stream of 32-bit words;
* ``checkpoints``: the coders' states and place in the stream every
  ``CHECKPOINT`` steps, so that a block can be decoded from several points at
  once or read in part;
* ``ids_crc32``: checksum of the ids, held against what decodes.

All blocks share one table of token frequencies, counted over the whole
corpus and scaled to ``SCALE``; it has an entry per vocabulary item at most,
and is stored beside the blocks.

Defined cases: null and empty texts have the end id alone; rows with equal
doc_id follow each other in order of their ids' checksum; null doc_id comes
first; doc_id may have any type that Spark orders; no rows, no blocks; other
columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from sparkloom.llm._common import arrow_type, shuffle_width, written
from sparkloom.llm.word_ids import broadcast_tokenizer, encoder

LANES, CHECKPOINT, SCALE_BITS = 2048, 64, 22
SCALE = 1 << SCALE_BITS
#: Coder states lie in [LOW, LOW << 32).
LOW = 1 << 31
#: A block is closed at the end of the document that brings it to so many tokens.
BLOCK_TOKENS = 1 << 19
#: Tokens that a shard is to have, about.
SHARD_TOKENS = 1 << 23
BLOCK = "shard int, block int, start long, doc_ids array<{}>, n_tokens array<int>, ids_crc32 long, n_words long, states binary, words binary, checkpoints binary"


def scaled_frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of sum ``scale``, at least 1 where ``counts`` is positive."""
    present = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(present):
        share = counts[present] / counts[present].sum() * (scale - len(present))
        out[present] = 1 + np.floor(share).astype(np.int64)
        rest = scale - int(out.sum())
        first = present[np.argsort(-(share - np.floor(share)), kind="stable")[:rest]]
        out[first] += 1
    return out


class RangeCoder:
    """Encodes and decodes arrays of ids by one frequency table."""

    def __init__(self, frequencies: np.ndarray) -> None:
        self.f = frequencies.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """States, words and checkpoints; steps run backwards, so that decoding runs forwards."""
        n, steps = len(ids), -(-len(ids) // LANES)
        x = np.full(LANES, LOW, np.uint64)
        words, marks = [], []
        bits, top = np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS)
        for s in range(steps - 1, -1, -1):
            part = ids[s * LANES : (s + 1) * LANES]
            k = len(part)
            f, v = self.f[part], x[:k].copy()
            over = v >= (f << top)
            if over.any():
                words.append((v[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                v[over] >>= np.uint64(32)
            q, r = np.divmod(v, f)
            x[:k] = (q << bits) + r + self.start[part]
            if s and s % CHECKPOINT == 0:
                marks.append((sum(map(len, words)), x.copy()))
        stream = np.concatenate([w for w in reversed(words)]) if words else np.zeros(0, "<u4")
        held = b"".join(np.uint64(len(stream) - at).tobytes() + state.astype("<u8").tobytes() for at, state in reversed(marks))
        return x.astype("<u8").tobytes(), stream.tobytes(), held

    def decode(self, n: int, states: bytes, words: bytes, checkpoints: bytes = b"", first: int = 0) -> np.ndarray:
        """All ids, or those from checkpoint number ``first`` (1 is the first stored) on."""
        x, at, step = np.frombuffer(states, "<u8").astype(np.uint64), 0, 0
        if first:
            mark = np.frombuffer(checkpoints, "<u8")[(first - 1) * (LANES + 1) : first * (LANES + 1)]
            at, x, step = int(mark[0]), mark[1:].astype(np.uint64), first * CHECKPOINT
        stream = np.frombuffer(words, "<u4").astype(np.uint64)
        out = np.empty(n - step * LANES, np.uint32)
        mask, bits = np.uint64(SCALE - 1), np.uint64(SCALE_BITS)
        for o in range(0, len(out), LANES):
            k = min(LANES, len(out) - o)
            v = x[:k]
            slot = v & mask
            found = self.symbol[slot]
            out[o : o + k] = found
            v = self.f[found] * (v >> bits) + slot - self.start[found]
            low = np.flatnonzero(v < np.uint64(LOW))
            if len(low):
                v[low] = (v[low] << np.uint64(32)) | stream[at : at + len(low)]
                at += len(low)
            x[:k] = v
        return out


def _tokens(tokenizer: Broadcast, end_id: int, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer.value)
        end, at = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = [encode(t.as_py()) + end for t in batch.column(1).cast(pa.binary())]
            made = [batch.column(0), pa.array(range(at, at + len(ids)), pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([_narrow(i, width) for i in ids], pa.binary())]
            at += len(ids)
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "place", "n", "crc", "ids"])

    return run


def _narrow(ids: bytes, width: int) -> bytes:
    """``width`` bytes an id, for the table between tokenizing and coding."""
    if width == 2:
        return np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return np.frombuffer(ids, np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _wide(ids: bytes, width: int) -> np.ndarray:
    if width == 2:
        return np.frombuffer(ids, "<u2").astype("<u4")
    out = np.zeros((len(ids) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(ids, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u4")


def _histogram(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            ids = b"".join(batch.column(0).to_pylist())
            found = np.bincount(_wide(ids, width))
            if len(found) > len(counts):
                found, counts = counts, found
            counts[: len(found)] += found
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["id", "n"])

    return run


def _write_blocks(table: Broadcast, kind: pa.DataType, width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = RangeCoder(table.value), TaskContext.get().partitionId()
        block, at, size = 0, 0, 0
        held: list[np.ndarray] = []
        docs: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, at, size, held, docs
            ids = np.concatenate(held)
            states, words, marks = coder.encode(ids)
            keys = pa.concat_arrays(docs)
            row = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([at], pa.int64()), pa.ListArray.from_arrays([0, len(keys)], keys), pa.array([[len(h) for h in held]], pa.list_(pa.int32()))]
            row += [pa.array([zlib.crc32(ids.astype("<u4").tobytes())], pa.int64()), pa.array([len(words) // 4], pa.int64()), *(pa.array([x], pa.binary()) for x in (states, words, marks))]
            block, at, size, held, docs = block + 1, at + len(ids), 0, [], []
            return pa.RecordBatch.from_arrays(row, names=["shard", "block", "start", "doc_ids", "n_tokens", "ids_crc32", "n_words", "states", "words", "checkpoints"])

        for batch in batches:
            for k, ids in enumerate(batch.column(1)):
                held.append(_wide(ids.as_py(), width))
                docs.append(batch.column(0).slice(k, 1).cast(kind))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Tokenizes ``docs`` once and writes blocks to ``path``/blocks, where each
    shard starts to ``path``/shards and the frequency table to ``path``/frequencies."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = broadcast_tokenizer(spark, tokenizer_path)
    largest = max(*Tokenizer.from_str(held.value).get_vocab().values(), end_id)
    width = 2 if largest < 1 << 16 else 3 if largest < 1 << 24 else 4
    tokens = docs.select("doc_id", "text").mapInArrow(_tokens(held, end_id, width), f"doc_id {kind}, place long, n long, crc long, ids binary")
    ids = written(tokens, "ids")
    counted = ids.select("ids").mapInArrow(_histogram(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # vocabulary size at most
    counts = np.zeros(max((r["id"] for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    frequencies = scaled_frequencies(counts)
    shards = max(shuffle_width(spark), -(-int(counts.sum()) // SHARD_TOKENS))
    coded = spark.sparkContext.broadcast(frequencies)
    order = ["doc_id", "crc", "place"]  # nulls first
    dealt = ids.select(*order, "ids").repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    blocks = dealt.mapInArrow(_write_blocks(coded, arrow_type(docs, "doc_id"), width), BLOCK.format(kind))
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").select("shard", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    at, starts = 0, []
    for r in sizes.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():  # one row a shard
        starts.append((r["shard"], at))
        at += r["n"]
    spark.createDataFrame(starts, "shard int, shard_start long").coalesce(1).write.parquet(f"{path}/shards")
    table = [(int(i), int(frequencies[i])) for i in np.flatnonzero(frequencies)]
    spark.createDataFrame(table, "id int, frequency int").coalesce(1).write.parquet(f"{path}/frequencies")


def frequency_table(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("id int, frequency int").parquet(f"{path}/frequencies").collect()  # vocabulary size at most
    out = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["frequency"]
    return out


def _read_blocks(table: Broadcast, kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = RangeCoder(table.value)
        for batch in batches:
            for row in batch.to_pylist():
                n = sum(row["n_tokens"])
                ids = coder.decode(n, row["states"], row["words"]).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["ids_crc32"]:
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: checksum differs")
                stops = np.cumsum(row["n_tokens"])
                starts = stops - row["n_tokens"]
                parts = [ids[a:b].tobytes() for a, b in zip(starts, stops)]
                made = [pa.array(row["doc_ids"], kind), pa.array(row["shard_start"] + row["start"] + starts, pa.int64()), pa.array(row["n_tokens"], pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned
    32-bit integers) of every document, decoded and held against the checksums."""
    blocks = spark.read.parquet(f"{path}/blocks")
    field = blocks.schema["doc_ids"].dataType.elementType
    held = spark.sparkContext.broadcast(frequency_table(spark, path))
    blocks = blocks.join(F.broadcast(spark.read.parquet(f"{path}/shards")), "shard")  # one row a shard
    return blocks.mapInArrow(_read_blocks(held, to_arrow_type(field)), f"doc_id {field.simpleString()}, start long, n_tokens long, ids_crc32 long, ids binary")
