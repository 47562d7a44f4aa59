"""Language-model scores: context-tree weighting over bytes, beside an add-one word model.

Both models learn from the training rows in full. A text is normalised first:
A-Z in lower case, words apart by one space, a line feed as its end.

**Context tree.** A byte is coded as eight binary decisions, each in the
context of up to ``DEPTH`` bytes before it. At every context a
Krichevsky-Trofimov estimate is kept, and the tree weights each context's own
estimate against the product of its children's (probability half each, as
context-tree weighting has it); a prediction mixes the estimates of all depths
on its path by these weights. A context unseen in training predicts as its
parent does. The score is the sum over bytes of the log10 probability.

Counts of byte sequences are a Spark table, and all of them are in the tree.
Contexts that share their last ``_TOP`` bytes make one subtree, which a task
builds and asks by itself, a slice of subtrees at a time; of it only sums for
the ``_TOP - 1`` bytes above are collected (65,536 contexts and bits at most).
So every sequence that any text has gets its probability, as a table. The
sequences that occur most (at most ``HEAD_GRAMS``) are broadcast with theirs;
all others meet theirs by the join that serves rare words.

**Words.** Counts of all training words are a Spark table. A word of over
``HEAD_BYTES`` bytes stands there as its SHA-256 behind a tab, which no word
has, so that words of any length are short keys. The words that occur most (at
most ``HEAD_WORDS``) are broadcast; all others meet their counts by a join, so
frequent words never load one task and rare ones never load the driver.

Defined cases: null and empty texts have the end alone; without training rows
every count is 0; repeated rows are scored and counted once each, rows with
null doc_id are kept; no rows, no rows; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import arrow_type, written

DEPTH, HEAD_GRAMS = 5, 1 << 22  # keys of depth + 1 bytes are joined as eight bytes: a depth of 5 at most
HEAD_WORDS, HEAD_BYTES = 1 << 18, 64
_END = b"\n"
_FLUSH = 1 << 21
_TOP = 2  # the levels above are few and go to all tasks
_SLICE = 1 << 17  # sequences whose subtrees are built at once


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only


def word_key(word: bytes) -> bytes:
    return word if len(word) <= HEAD_BYTES else b"\t" + hashlib.sha256(word).digest()


def normal_text(words: list[bytes]) -> bytes:
    return b" ".join(words) + _END


def gram_keys(texts: list[bytes], depth: int) -> np.ndarray:
    """For each byte of each text the number that it and the ``depth`` bytes before it make."""
    data = np.frombuffer(b"".join(_END * depth + t for t in texts), np.uint8)
    keys = np.zeros(max(0, len(data) - depth), np.uint64)
    for j in range(depth + 1):
        keys = (keys << np.uint64(8)) | data[j : len(data) - depth + j]
    if len(texts) == 1:
        return keys
    use = np.ones(len(keys), bool)
    at = 0
    for t in texts:
        use[max(0, at - depth) : at] = False  # keys that end in the padding
        at += len(t) + depth
    return keys[use]


def _lgamma(n: np.ndarray) -> np.ndarray:
    """ln gamma of positive numbers, by recurrence and Stirling's series."""
    n = np.asarray(n, float)
    shift, x = np.zeros_like(n), n.copy()
    for _ in range(8):
        low = x < 8
        shift[low] += np.log(x[low])
        x[low] += 1
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - math.log(math.pi) - _lgamma(zeros + ones + 1.0)


class _Level(NamedTuple):
    keys: np.ndarray  # context bytes, then the bits so far behind a leading one
    zeros: np.ndarray
    ones: np.ndarray
    own: np.ndarray  # weight of the context's own estimate


def _log10(bits: np.ndarray) -> np.ndarray:
    """log10 probability of bytes, from that of their eight bits; NaN is a half."""
    return np.log10(np.where(np.isnan(bits), 0.5, bits)).sum(axis=0)


class ContextTree:
    """Levels ``top`` and deeper, built from (keys, counts) of the byte sequences
    of ``top + 1`` bytes and more. ``below``: where deeper levels are elsewhere,
    nodes of the deepest level here and sums of their children's log weights."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], top: int = 0, below: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.top, self.depth = top, top + len(grams) - 1
        counted = []
        for keys, counts in grams:
            context, byte = keys.astype(np.uint64) >> np.uint64(8), keys.astype(np.uint64) & np.uint64(255)
            nodes = np.concatenate([(context << np.uint64(8)) | np.uint64(1 << j) | (byte >> np.uint64(8 - j)) for j in range(8)])
            bits = np.concatenate([(byte >> np.uint64(7 - j)) & np.uint64(1) for j in range(8)]).astype(bool)
            n = np.tile(counts.astype(float), 8)
            found, at = np.unique(nodes, return_inverse=True)
            counted.append((found, np.bincount(at, n * ~bits, len(found)), np.bincount(at, n * bits, len(found))))
            del nodes, bits, n, at
        self.levels: list[_Level] = []
        for d in range(self.depth, top - 1, -1):
            keys, zeros, ones = counted.pop()
            weighted = own = kt_log(zeros, ones)
            share = np.ones(len(keys))
            if below is not None:
                total = np.bincount(np.searchsorted(keys, below[0]), below[1], len(keys))
                weighted = np.logaddexp(own, total) - math.log(2)
                share = np.exp(np.clip(own - math.log(2) - weighted, -700, 0))
            if d:
                below = ((keys >> np.uint64(8)) & np.uint64((1 << 8 * (d - 1)) - 1)) << np.uint64(8) | (keys & np.uint64(255)), weighted
            self.levels.insert(0, _Level(keys, *(x.astype(np.float32) for x in (zeros, ones, share))))
        nodes, weights = below or (np.zeros(0, np.uint64), np.zeros(0))
        found, at = np.unique(nodes, return_inverse=True)
        #: ``below`` of the tree above, as far as these levels make it.
        self.above = found, np.bincount(at, weights, len(found))

    def mix(self, grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """``bits``, the probabilities of the eight bits by deeper contexts (NaN
        where none is known), mixed with those of these levels."""
        byte = grams & np.uint64(255)
        for j in range(8):
            node = np.uint64(1 << j) | (byte >> np.uint64(8 - j))
            bit = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
            p = bits[j]
            for level, d in zip(self.levels[::-1], range(self.depth, self.top - 1, -1)):
                if not len(level.keys):
                    continue
                key = (((grams >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)) << np.uint64(8)) | node
                at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
                zeros, ones, own = (x[at].astype(float) for x in level[1:])
                kt = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
                p = np.where(level.keys[at] == key, np.where(np.isnan(p), kt, own * kt + (1 - own) * p), p)
            bits[j] = p
        return bits

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each sequence of depth + 1 bytes."""
        return _log10(self.mix(grams, np.full((8, len(grams)), np.nan)))


class Scorer:
    """The tree as a whole, for training rows that fit one process."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.tree, self.depth = ContextTree(grams), len(grams) - 1

    def scores(self, lines: list[bytes]) -> list[float]:
        """log10 probability of each text."""
        return [sum(float(self.tree.log10(part).sum()) for part in _parts(line, self.depth)) for line in lines]


class HeadScorer:
    """A hash table of the most frequent sequences' log10 probabilities."""

    EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, self.EMPTY), np.zeros(1 << bits, np.float32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            slot, first = np.unique(at[left], return_index=True)
            free = self.keys[slot] == self.EMPTY
            put = left[first[free]]
            self.keys[slot[free]], self.values[slot[free]] = keys[put], values[put]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where there is none, and the places of these."""
        at = self._slot(keys)
        out = self.values[at].astype(np.float64)
        miss = np.flatnonzero(self.keys[at] != keys)
        at = at[miss]
        out[miss] = 0
        unseen = [np.zeros(0, np.int64)]
        while len(miss):
            gone = self.keys[at] == self.EMPTY
            unseen.append(miss[gone])
            miss, at = miss[~gone], (at[~gone] + 1) & self.mask
            hit = self.keys[at] == keys[miss]
            out[miss[hit]] = self.values[at[hit]]
            miss, at = miss[~hit], at[~hit]
        return out, np.concatenate(unseen)

    def scores(self, lines: list[bytes], depth: int) -> tuple[list[float], np.ndarray, np.ndarray, np.ndarray]:
        """What the head gives each text; and the rest: places of texts, keys, times."""
        sums = np.zeros(len(lines))
        rest = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        k = 0
        while k < len(lines):
            stop, size = k, 0
            while stop < len(lines) and (stop == k or size + len(lines[stop]) <= _FLUSH):
                size += len(lines[stop])
                stop += 1
            starts = np.cumsum([0, *map(len, lines[k : stop - 1])])
            for keys in _parts(lines[k], depth) if stop == k + 1 else [gram_keys(lines[k:stop], depth)]:
                found, miss = self.find(keys)
                sums[k:stop] += np.add.reduceat(found, starts)
                line = (k + np.searchsorted(starts, miss, "right") - 1).astype(np.uint64)
                rest.append(np.unique(line << np.uint64(48) | keys[miss], return_counts=True))
            k = stop
        both, times = (np.concatenate(x) for x in zip(*rest))
        return sums.tolist(), (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1), times


#: The scorer last used and its name, so that the tasks of a Python worker share one.
_HELD: list[tuple[str, HeadScorer]] = []


def _shared_scorer(name: str, grams: Broadcast) -> HeadScorer:
    if not _HELD or _HELD[0][0] != name:
        _HELD.clear()  # before the next is built
        _HELD.append((name, HeadScorer(*grams.value)))
    return _HELD[0][1]


def _count_grams(depth: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _HELD.clear()  # a model of before, in a worker that now counts for another
        keys, n, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: tuple[list[bytes], list[bytes]] = [], []
        size = 0

        def merge() -> None:
            nonlocal keys, n, held, size
            (train, a), (other, b) = (np.unique(gram_keys(lines, depth), return_counts=True) for lines in waiting)
            both, at = np.unique(np.concatenate([keys, train, other]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, a, np.zeros(len(b))]), len(both)).astype(np.int64)
            held = np.bincount(at, np.concatenate([held, np.zeros(len(a)), b]), len(both)).astype(np.int64)
            keys = both
            for lines in waiting:
                lines.clear()
            size = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(held)], names=["gram", "n", "held"])

        for batch in batches:
            for text, out in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                line = normal_text(normal_words(text.as_py()))
                waiting[out].append(line)
                size += len(line)
                if size > _FLUSH:
                    merge()
                    if len(keys) > _FLUSH:
                        yield rows()
                        keys, n, held = keys[:0], n[:0], held[:0]
        merge()
        yield rows()

    return run


def _shorter(keys: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the last ``size`` bytes."""
    found, at = np.unique(keys & np.uint64((1 << 8 * size) - 1), return_inverse=True)
    return found, np.bincount(at, counts, len(found))


def _subtrees(depth: int, top: int):
    """From rows in the order of ``part``: each sequence's probabilities by the
    levels from ``top`` on, and what their roots give the level above."""
    names = ["gram", "times", "bits", "node", "weight"]

    def built(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        grams, n, held = (rows.column(k).to_numpy() for k in range(3))
        grams, seen = grams.view(np.uint64), n > 0
        tree = ContextTree([_shorter(grams[seen], n[seen], d + 1) for d in range(top, depth + 1)], top)
        for k in range(0, len(grams), _SLICE):
            some = grams[k : k + _SLICE]
            bits = np.ascontiguousarray(tree.mix(some, np.full((8, len(some)), np.nan)).T.astype(np.float32))
            ends = np.arange(0, 32 * len(some) + 1, 32, dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(bits)])
            none = [pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array((n + held)[k : k + _SLICE]), packed, *none], names=names)
        nodes, weights = tree.above
        none = [pa.nulls(len(nodes), t) for t in (pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(nodes.view(np.int64)), pa.array(weights.astype(float))], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _HELD.clear()
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            part = batch.column(3).to_numpy()
            if sum(b.num_rows for b in waiting) >= _SLICE and waiting[0].column(3)[0].as_py() != part[-1]:
                cut = int(np.searchsorted(part, part[-1]))  # the last part may go on
                whole = [*waiting[:-1], batch.slice(0, cut)]
                later = [batch.slice(cut)]
                while not whole[-1].num_rows or whole[-1].column(3)[0].as_py() == part[-1]:
                    later.insert(0, whole.pop())
                last = whole[-1].column(3).to_numpy()
                at = int(np.searchsorted(last, part[-1]))
                later.insert(0, whole[-1].slice(at))
                whole[-1] = whole[-1].slice(0, at)
                yield from built(whole)
                waiting = [b for b in later if b.num_rows]
        if waiting:
            yield from built(waiting)

    return run


def _whole(upper: Broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0).to_numpy().view(np.uint64)
            bits = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, 8).T.astype(float)
            if upper.value is not None:
                bits = upper.value.mix(grams, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_log10(bits))], names=["gram", "c", "value"])

    return run


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            held.update(map(word_key, normal_words(text.as_py())))
            held[_END] += 1
            if len(held) > 1_000_000:
                yield rows()
                held.clear()
    yield rows()


def count_grams(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram (``depth + 1`` bytes as a number), n and held: how often it occurs
    in rows to train on and in others. ``docs``: text, held_out."""
    counted = docs.select("text", "held_out").mapInArrow(_count_grams(depth), "gram long, n long, held long")
    return written(counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("held").alias("held")), "grams")


def gram_values(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram, c (how often it occurs in all rows) and value, the log10 probability of its last byte."""
    top = min(_TOP, depth)
    part = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * top) - 1).cast("long"))
    rows = grams.select("gram", "n", "held", part.alias("part")).repartition(F.col("part")).sortWithinPartitions("part")
    lower = written(rows.mapInArrow(_subtrees(depth, top), "gram long, times long, bits binary, node long, weight double"), "subtrees")
    upper = None
    if top:  # at most 65,536 sequences of two bytes, and as many nodes
        found = grams.where("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * top) - 1).cast("long")).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
        sums = lower.where(F.col("node").isNotNull()).groupBy("node").agg(F.sum("weight").alias("weight")).toArrow()
        keys, n = found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy()
        upper = ContextTree([_shorter(keys, n, d + 1) for d in range(top)], 0, (sums["node"].to_numpy().view(np.uint64), sums["weight"].to_numpy()))
    whole = _whole(grams.sparkSession.sparkContext.broadcast(upper))
    return written(lower.where(F.col("gram").isNotNull()).select("gram", "times", "bits").mapInArrow(whole, "gram long, c long, value double"), "values")


def count_words(train: DataFrame) -> DataFrame:
    """word (its key; the end is a line feed) and c, over all training rows."""
    return written(train.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")


def _most_frequent(rows: DataFrame, most: int) -> tuple[Column, int]:
    """Size class of ``c``, a quarter power of two, and the least class so that
    at most ``most`` rows are in it or above; from a histogram of few rows."""
    power = F.floor(4 * F.log2("c"))
    sizes = {int(r["p"]): r["count"] for r in rows.groupBy(power.alias("p")).count().collect()}
    least, total = max(sizes, default=0) + 1, 0
    while sizes and least > min(sizes) and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    return power, least


def head_words(words: DataFrame, most: int = HEAD_WORDS) -> tuple[dict[bytes, float], int]:
    """The most frequent words with log10(c + 1), and the least size class among them."""
    power, least = _most_frequent(words, most)
    rows = words.where(power >= least).toArrow()
    return dict(zip(rows["word"].to_pylist(), np.log10(rows["c"].to_numpy() + 1.0).tolist())), least


def head_grams(values: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """Keys and values of the most frequent sequences; and the others, as rows
    for the join: word (two spaces and six bytes, which no word is), value."""
    power, least = _most_frequent(values, most)
    rows = values.where(power >= least).select("gram", F.col("value").cast("float")).toArrow()
    word = F.unhex(F.concat(F.lit("2020"), F.lpad(F.hex("gram"), 12, "0")))
    return (rows["gram"].to_numpy().view(np.uint64), rows["value"].to_numpy()), values.where(power < least).select(word.alias("word"), "value")


_SENT = "row long, held_out boolean, n_tokens long, score double, word binary, times long, known long, logs double"


def _score(grams, head, kind: pa.DataType, depth: int):
    names = ["doc_id", *(x.split()[0] for x in _SENT.split(", "))]
    types = [kind, pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.binary(), pa.int64(), pa.int64(), pa.float64()]
    name = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, heads = _shared_scorer(name, grams), head.value
        base = TaskContext.get().partitionId() << 40
        row = 0
        for batch in batches:
            ids, out_at = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = batch.column(1).cast(pa.binary())
            for start in range(0, batch.num_rows, 200):
                cols: list[list] = [[] for _ in names]
                tail_row, tail_word, tail_times = [], [], []
                several = [normal_words(texts[k].as_py()) for k in range(start, min(start + 200, batch.num_rows))]
                scores, line, keys, many = scorer.scores([normal_text(words) for words in several], depth)
                first = base + row
                for k, words, score in zip(range(start, batch.num_rows), several, scores):
                    words.append(_END)
                    known, logs, me = 0, 0.0, base + row
                    for word, times in Counter(map(word_key, words)).items():
                        value = heads.get(word)
                        if value is None:
                            tail_row.append(me), tail_word.append(word), tail_times.append(times)
                        else:
                            known += times
                            logs += times * value
                    # No word has a space: this key meets no count, and spreads.
                    for c, v in zip(cols, (ids[k], me, out_at[k], len(words), score, b" %d" % me, 0, known, logs)):
                        c.append(v)
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
                n = len(tail_row)
                tail = {"row": tail_row, "word": tail_word, "times": tail_times}
                yield pa.RecordBatch.from_arrays([pa.array(tail[c], t) if c in tail else pa.nulls(n, t) for c, t in zip(names, types)], names=names)
                ends = np.arange(0, 8 * len(keys) + 1, 8, dtype=np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer((keys | np.uint64(0x2020 << 48)).byteswap())])
                tail = {"row": pa.array(first + line), "word": packed, "times": pa.array(many)}
                yield pa.RecordBatch.from_arrays([tail[c] if c in tail else pa.nulls(len(keys), t) for c, t in zip(names, types)], names=names)

    return run


def _parts(line: bytes, depth: int) -> Iterator[np.ndarray]:
    """Keys of a text in pieces of bounded size."""
    if len(line) <= _FLUSH:
        yield gram_keys([line], depth)
        return
    whole = _END * depth + line
    for k in range(0, len(line), _FLUSH):
        yield gram_keys([whole[k : k + _FLUSH + depth]], depth)[depth:]


def score_documents(docs: DataFrame, held_out: Column, depth: int = DEPTH, entries: int = HEAD_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row;
    both models learn from the rows where ``held_out`` isn't true. At most
    ``entries`` byte sequences are broadcast; the scores are the same with any."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = docs.where(~F.col("held_out"))
    words = count_words(train)
    total = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    head, _ = head_words(words)
    held = spark.sparkContext.broadcast(head)
    most, others = head_grams(gram_values(count_grams(docs, depth), depth), entries)
    grams = spark.sparkContext.broadcast(most)
    counts = words.select("word", "c", F.lit(None).cast("double").alias("value")).unionByName(others.withColumn("c", F.lit(None).cast("long")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.mapInArrow(_score(grams, held, arrow_type(docs, "doc_id"), depth), f"doc_id {kind}, {_SENT}")
    met = sent.join(counts, "word", "left")
    own = F.coalesce(F.col("times"), F.lit(0))
    rows = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum(F.coalesce("known", F.lit(0))) + F.sum(F.when(F.col("c") > 0, own).otherwise(0))).alias("n_known"),
        (F.sum(F.coalesce("logs", F.lit(0.0))) + F.sum(own * F.log10(F.coalesce("c", F.lit(0)) + 1.0))).alias("logs"),
        (F.sum(F.coalesce("score", F.lit(0.0))) + F.sum(own * F.coalesce("value", F.lit(0.0)))).alias("score"),
    )
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
