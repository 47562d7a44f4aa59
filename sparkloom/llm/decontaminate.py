"""Benchmark decontamination by greedy string tiling.

Texts are taken as words, runs of letters and digits in lower case. A document
and a benchmark item that share a seed, ``match`` words in a row, are tiled:
the longest common run of words that no tile covers yet is marked, again and
again, down to runs of ``match`` words. The length to search for shrinks from
tile to tile: it is found by halving, as words in common at one length are so
at all shorter ones; windows of that length are found by running Karp-Rabin
hashes and confirmed word by word. As tiles may lie in any order, passages that
were reordered are caught. An item leaks if tiles cover at least ``coverage``
of its words. Tiles of n words hold n - match + 1 seeds, so an item with fewer
seeds in a text than such coverage asks for isn't tiled.

A benchmark of up to ``BLOCK_WORDS`` words is broadcast, and one pass over the
documents finds seeds and tiles, without a shuffle. A larger one stays a Spark
table: its seeds go to all tasks as two bits each of a bit set of at most
``FILTER_BITS`` bits; windows of the documents that pass it are joined to the
seeds, hot seeds dealt, and only pairs of text and item that share seeds enough
are tiled, by what the seeds cover of the text. Copies of a text are tiled once
there. Neither way depends on the size of the documents' table, and no item or
document is left out in either.

Defined cases: items of fewer than ``match`` words have all their words as one
seed, and must be found whole; items without words never leak, as null and
empty ones; null and empty documents leak nothing; repeated documents and
repeated items are reported each; an empty benchmark or table gives no rows;
other columns pass through ``keep_clean`` whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import arrow_type, checkpointed, free_names, join_hot, written

MATCH, COVERAGE = 5, 0.8
BLOCK_WORDS = 500_000
FILTER_BITS = 1 << 27
#: Leaking texts up to which ``keep_clean`` broadcasts their keys.
FEW_GONE = 1 << 19
_WORD = re.compile(r"[^\W_]+")
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _windows(ids: list[int], size: int, free: list[bool]) -> Iterator[tuple[int, int]]:
    """(start, running hash) of each window of ``size`` words that are all free."""
    top, value, run = pow(_BASE, size, _PRIME), 0, 0
    for k, word in enumerate(ids):
        if not free[k]:
            value = run = 0
            continue
        value = (value * _BASE + word + 1) % _PRIME
        run += 1
        if run > size:
            value = (value - (ids[k - size] + 1) * top) % _PRIME
        if run >= size:
            yield k - size + 1, value


def _common(doc: list[int], item: list[int], size: int, free_d: list[bool], free_i: list[bool]) -> list[tuple[int, list[int]]]:
    """Windows of the item that the document has too: places in the item, and in the document."""
    places = defaultdict(list)
    for d, value in _windows(doc, size, free_d):
        places[value].append(d)
    found = [(i, places[value]) for i, value in _windows(item, size, free_i) if value in places]
    return [(i, at) for i, at in found if doc[at[0] : at[0] + size] == item[i : i + size]]


def tiled(doc: list[int], item: list[int], match: int) -> int:
    """Words of ``item`` that greedy string tiling covers."""
    free_d, free_i = [True] * len(doc), [True] * len(item)
    covered, most = 0, min(len(doc), len(item))
    while most >= match:
        found, least = _common(doc, item, match, free_d, free_i), match
        if not found:
            break
        while least < most:  # the longest: found at ``least``, not over ``most``
            size = (least + most + 1) // 2
            longer = _common(doc, item, size, free_d, free_i)
            if longer:
                found, least = longer, size
            else:
                most = size - 1
        tried: dict[int, int] = {}  # of a window's places in the document, those that are used up
        for i, at in found:
            if not free_i[i] or not free_i[i + least - 1]:
                continue
            k = tried.get(at[0], 0)
            while k < len(at) and not (free_d[at[k]] and free_d[at[k] + least - 1] and doc[at[k] : at[k] + least] == item[i : i + least]):
                k += 1
            tried[at[0]] = k
            if k < len(at):
                d = at[k]
                free_i[i : i + least] = free_d[d : d + least] = [False] * least
                covered += least
        most = least - 1
    return covered


class Benchmark:
    """One block of items, by seeds."""

    def __init__(self, items: list[tuple[object, list[str]]], match: int, coverage: float) -> None:
        self.match, self.coverage = match, coverage
        self.ids: dict[str, int] = {}
        self.items = [(key, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]) for key, words in items]
        self.seeds: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, (_, words) in enumerate(self.items):
            size = min(match, len(words))
            windows = Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if size else {}
            for seed, times in windows.items():
                self.seeds[size][seed].append((n, times))

    def leaks(self, text: str | None) -> Iterator[tuple[object, int, int]]:
        """(item, its words, words covered) for each item that leaks into ``text``."""
        words = words_of(text)
        get = self.ids.get
        ids = [get(w, 0) for w in words]
        found: dict[int, list[int]] = defaultdict(list)
        shared: Counter[int] = Counter()
        for size, seeds in self.seeds.items():
            met = set()
            for k, seed in enumerate(zip(*(ids[j:] for j in range(size)))):
                if seed in seeds:
                    new = seed not in met
                    met.add(seed)
                    for n, times in seeds[seed]:
                        found[n].append(k)
                        shared[n] += times if new else 0
        for n in sorted(found):
            key, item = self.items[n]
            size = min(self.match, len(item))
            if shared[n] * size < self.coverage * len(item):
                continue
            covered = tiled(self._around(ids, found[n], size), item, size)
            if covered >= self.coverage * len(item):
                yield key, len(item), covered

    @staticmethod
    def _around(ids: list[int], starts: list[int], size: int) -> list[int]:
        """The parts of a text that its seeds cover; unknown words between them."""
        out: list[int] = []
        end = 0
        for k in starts:
            if k > end and out:
                out.append(-1)
            out += ids[max(k, end) : k + size]
            end = max(end, k + size)
        return out


def _tile(block: Broadcast, match: int, coverage: float, item_type: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(block.value, match, coverage)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1)):
                for row in benchmark.leaks(text.as_py()):
                    at.append(k)
                    rows.append(row)
            item, n, covered = zip(*rows) if rows else ((), (), ())
            made = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, item_type), pa.array(n, pa.int64()), pa.array(covered, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "item_id", "item_words", "covered_words"])

    return run


def _items(kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                if words:
                    line = " ".join(words)
                    made = [batch.column(0).slice(k, 1), pa.array([hashlib.md5(line.encode("utf-8", "surrogatepass")).hexdigest()]), pa.array([len(words)], pa.int64()), pa.array([line])]
                    yield pa.RecordBatch.from_arrays(made, names=["item_id", "item", "n", "words"])

    return run


def _benchmark(benchmark: DataFrame) -> tuple[DataFrame, list[tuple[object, list[str]]] | None]:
    """item_id, item (a key of its words), n, words; and the items themselves if they are few enough for every task."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = written(benchmark.select("item_id", "text").mapInArrow(_items(arrow_type(benchmark, "item_id")), f"item_id {kind}, item string, n long, words string"), "benchmark")
    if (items.agg(F.sum("n")).first()[0] or 0) > BLOCK_WORDS:
        return items, None
    return items, [(r["item_id"], r["words"].split(" ")) for r in items.orderBy("item_id", "words").collect()]


class _WindowHashes:
    """Hashes of windows of words, modulo 2^64."""

    def __init__(self) -> None:
        self.held: dict[str, int] = {}

    def __call__(self, words: list[str], sizes: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        if len(self.held) > 500_000:
            self.held.clear()
        held = self.held
        for w in set(words).difference(held):
            held[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        ids = np.fromiter((held[w] for w in words), np.uint64, len(words))
        for size in sizes:
            if len(ids) >= size:
                out = np.zeros(len(ids) - size + 1, np.uint64)
                for j in range(size):
                    out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - size + 1 + j]
                yield size, out ^ (out >> np.uint64(29))


def _seeds(match: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WindowHashes()
        for batch in batches:
            for item, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = line.split(" ")
                for size, found in hashes(words, [min(match, len(words))]):
                    seeds = [" ".join(words[k : k + size]) for k in range(len(found))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(seeds)), pa.array(seeds), pa.array(found.view(np.int64)), pa.array([size] * len(seeds), pa.int32())], names=["item", "seed", "hash", "size"])

    return run


def _filter(seeds: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """Two bits of each seed, set; the mask of bit numbers; the seeds' sizes."""
    sizes = {r["size"]: r["count"] for r in seeds.groupBy("size").count().collect()}
    bits = min(FILTER_BITS, 1 << max(10, (64 * sum(sizes.values())).bit_length()))
    bit = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(bits - 1)))).alias("bit")
    words = seeds.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("set")).toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(bits >> 6, np.uint64)
    out[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return out, bits - 1, sorted(sizes)


def _hits(held: Broadcast):
    """Rows (text_key, at, size, seed) of the windows that pass the filter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask, sizes = held.value
        hashes, mask = _WindowHashes(), np.uint64(mask)
        isset = lambda at: (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                for size, found in hashes(words, sizes):
                    at = np.flatnonzero(isset(found & mask) & isset((found >> np.uint64(32)) & mask))
                    seeds = [" ".join(words[k : k + size]) for k in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array([size] * len(at), pa.int32()), pa.array(seeds, pa.string())], names=["text_key", "at", "size", "seed"])

    return run


def _tile_pairs(match: int, coverage: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, item, line, hits in zip(*(batch.column(k).to_pylist() for k in range(4))):
                words, end, part = line.split(" "), -1, []
                for hit in sorted(hits, key=lambda h: h["at"]):
                    seed = hit["seed"].split(" ")
                    if hit["at"] > end:
                        part.append(None)
                        end = hit["at"]
                    part += seed[end - hit["at"] :]
                    end = hit["at"] + len(seed)
                ids: dict = {None: -1}
                number = lambda some: [ids.setdefault(w, len(ids)) for w in some]  # noqa: B023, E731
                covered = tiled(number(part), number(words), min(match, len(words)))
                if covered >= coverage * len(words):
                    rows.append((key, item, len(words), covered))
            made = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["text_key", "item", "item_words", "covered_words"])

    return run


def _leaking_texts(docs: DataFrame, items: DataFrame, match: int, coverage: float) -> DataFrame:
    """text_key (md5 of the text), item, item_words, covered_words, for a benchmark of any size."""
    distinct = items.groupBy("item").agg(F.first("n").alias("n"), F.first("words").alias("words"))
    seeds = written(distinct.select("item", "words").mapInArrow(_seeds(match), "item string, seed string, hash long, size int"), "seeds")
    held = docs.sparkSession.sparkContext.broadcast(_filter(seeds))
    texts = docs.where("text IS NOT NULL").select(F.md5("text").alias("text_key"), "text")
    hits = written(texts.mapInArrow(_hits(held), "text_key string, at long, size int, seed string").distinct(), "hits")
    times = hits.groupBy("seed").agg(F.count("*").alias("times"))
    of_item = seeds.groupBy("seed", "item").agg(F.count("*").alias("places")).groupBy("seed").agg(F.collect_list(F.struct("item", "places")).alias("items"))
    by_seed = written(of_item.join(times, "seed"), "seeds-met")
    met = join_hot(hits, by_seed, "seed", "times", hits.count(), F.xxhash64("text_key"))
    pairs = met.select("text_key", "at", "size", "seed", F.explode("items").alias("i")).groupBy("text_key", F.col("i.item").alias("item"))
    pairs = pairs.agg(F.collect_list(F.struct("at", "seed")).alias("hits"), F.collect_set(F.struct("seed", "i.places")).alias("own"), F.first("size").alias("size"))
    shared = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["places"])
    pairs = written(pairs.select("text_key", "item", "hits", (shared * F.col("size")).alias("enough")), "pairs")
    by_item = written(distinct.join(pairs.groupBy("item").agg(F.count("*").alias("times")), "item"), "items-met")
    asked = join_hot(pairs, by_item, "item", "times", pairs.count(), F.xxhash64("text_key")).where(F.col("enough") >= F.lit(coverage) * F.col("n"))
    return written(asked.select("text_key", "item", "words", "hits").mapInArrow(_tile_pairs(match, coverage), "text_key string, item string, item_words long, covered_words long"), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and benchmark item that leaks into it:
    doc_id, item_id, item_words, covered_words, coverage."""
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items, few = _benchmark(benchmark)
    if few is not None:
        tile = _tile(docs.sparkSession.sparkContext.broadcast(few), match, coverage, arrow_type(benchmark, "item_id"))
        out = docs.select("doc_id", "text").mapInArrow(tile, f"doc_id {doc_kind}, item_id {item_kind}, item_words long, covered_words long")
    else:
        ids = items.groupBy("item").agg(F.collect_list("item_id").alias("item_ids"))
        found = _leaking_texts(docs, items, match, coverage).join(ids, "item")
        found = found.groupBy("text_key").agg(F.collect_list(F.struct("item_ids", "item_words", "covered_words")).alias("leaks"))
        rows = docs.where("text IS NOT NULL").select("doc_id", F.md5("text").alias("text_key"))
        times = rows.join(found, "text_key", "left_semi").groupBy("text_key").agg(F.count("*").alias("times"))
        by_text = written(found.join(times, "text_key"), "leaking-texts")
        met = join_hot(rows, by_text, "text_key", "times", docs.count(), F.xxhash64("doc_id"))
        one = met.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
        out = one.select("doc_id", F.explode("item_ids").alias("item_id"), "item_words", "covered_words")
    return out.withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def _clean(block: Broadcast, match: int, coverage: float):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        benchmark = Benchmark(block.value, match, coverage)
        for texts in batches:
            yield pd.Series([next(benchmark.leaks(t), None) is None for t in texts], dtype="bool")

    return F.pandas_udf(run, "boolean")


def keep_clean(docs: DataFrame, benchmark: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents into which an item leaks."""
    items, few = _benchmark(benchmark)
    if few is not None:
        return docs.where(_clean(docs.sparkSession.sparkContext.broadcast(few), match, coverage)(F.col("text")))
    gone = checkpointed(_leaking_texts(docs, items, match, coverage).select("text_key").distinct())
    (key,) = free_names("text_key", beside=docs)
    gone = gone.withColumnRenamed("text_key", key)
    kept = docs.withColumn(key, F.md5("text")).join(F.broadcast(gone) if gone.count() <= FEW_GONE else gone, key, "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
