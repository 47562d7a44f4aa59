"""SimHash near-duplicates by anchor-point covering.

Every text gets a 64-bit fingerprint. Two fingerprints that differ in at most
``max_distance`` bits are linked; components of links are groups of near
duplicates.

Links are found without comparing all pairs. The 64 bits are cut in
``(max_distance + 2) // 2`` parts, so that two linked fingerprints differ by at
most one bit in some part. In each part a covering code is laid out: the
perfect Hamming code on the longest 2^k - 1 bits, which has a codeword within
one bit of every word, with the part's other bits as they are. These codewords
are the anchors. A fingerprint is at home at the one anchor within the covering
radius 1, and is also sent to every anchor within radius plus threshold, 1 + 1.
Linked fingerprints then meet where one of them is at home, and only homes are
compared with what came there. For distance 3 that is two parts of 32 bits,
2^27 anchors each, and at most 34 short rows a distinct fingerprint.

Only distinct fingerprints are compared, so exact copies cost one row each.
What comes to each anchor is counted first, by partial aggregation. An anchor
where more than ``CELL`` meet is dealt over cells, each a share of its homes
with a share of its guests, before any task gathers it; so no task holds more
than two shares. Tasks hand on spanning links, never all pairs, and components
are found by alternating star contraction on Spark tables; the joins there, and
the one that gives each row its component, deal out hot keys.

Defined cases: null, empty and blank texts have fingerprint zero, which links
like any other; texts of fewer words than a shingle are one shingle; rows with
equal or null doc_id each keep their own row; a group in which every doc_id is
null has a null component_id; an empty table gives no rows; other columns of
the input are not read. ``one_of_each`` keeps one row of each component: of
those with the least doc_id (null only where all are null) the one of least
fingerprint, and any one of rows that agree in both.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm._common import checkpointed, free_names, join_hot, written

#: Rows at one anchor beyond which it is dealt over cells, and in either share of a cell.
CELL = 1 << 16
#: Rows to drop by ``one_of_each`` up to which their ids are broadcast.
FEW_GONE = 1 << 20
_BLOCK = 1 << 22


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64."""
    words = (text or b"").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    cuts = zip(starts, (e - 1 for e in ends[shingle - 1 :]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, (line[a:b] for a, b in cuts), repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def _fingerprint_udf(shingle: int, seed: int = 42):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, len(texts)).view(np.int64))

    return F.pandas_udf(run, "long")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle, seed), f"doc_id {kind}, fp long")


class CoveringCode:
    """Anchors of one part of the bits: Hamming code on 2^k - 1 of them, identity on the rest."""

    def __init__(self, part: int, low: int, width: int) -> None:
        self.part, self.low, self.width = part, np.uint64(low), width
        self.k = (width + 1).bit_length() - 1
        self.n = (1 << self.k) - 1
        self.checks = [np.uint64(sum(1 << (i - 1) for i in range(1, self.n + 1) if i >> j & 1)) for j in range(self.k)]

    def _flip(self, positions: np.ndarray) -> np.ndarray:
        """The bit at each position from 1; none for 0."""
        return np.where(positions > 0, np.uint64(1) << (np.maximum(positions, 1) - 1).astype(np.uint64), np.uint64(0))

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of fp, anchor, is home) of all anchors within radius plus threshold."""
        word = (fp >> self.low) & np.uint64((1 << self.width) - 1)
        syndrome = sum(((np.bitwise_count(word & c) & 1).astype(np.int64) << j) for j, c in enumerate(self.checks))
        home = word ^ self._flip(syndrome)
        rows, found = [np.arange(len(fp))], [home]
        for bit in range(self.n, self.width):  # threshold spent on the bits outside the code
            rows.append(rows[0])
            found.append(home ^ np.uint64(1 << bit))
        off = np.flatnonzero(syndrome)  # codewords at distance 2: one for each pair of positions that make the syndrome
        for i in range(1, self.n + 1):
            other = syndrome[off] ^ i
            use = off[(other > i)]
            rows.append(use)
            found.append(word[use] ^ self._flip(np.int64(i)) ^ self._flip(syndrome[use] ^ i))
        is_home = np.zeros(sum(map(len, rows)), bool)
        is_home[: len(fp)] = True
        key = np.concatenate(found) | np.uint64(self.part << 58)
        return np.concatenate(rows), key.view(np.int64), is_home


def covering(max_distance: int) -> list[CoveringCode]:
    parts = (max_distance + 2) // 2
    edges = [64 * k // parts for k in range(parts + 1)]
    return [CoveringCode(k, a, b - a) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def _send(max_distance: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = covering(max_distance)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fp), 50_000):
                part = fp[k : k + 50_000]
                for code in codes:
                    row, anchor, home = code.anchors(part)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), pa.array(part[row].view(np.int64))], names=["anchor", "home", "fp"])

    return run


def spanning_links(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components as x-y, one for each member but the least."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, label[side], least)
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _compare(homes: np.ndarray, all_fp: np.ndarray, first: np.ndarray, size: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between each home and the ``size`` fingerprints from ``first`` on in its group."""
    found_x, found_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    done = np.concatenate([[0], np.cumsum(size)])
    k = 0
    while k < len(homes):
        stop = max(k + 1, int(np.searchsorted(done, done[k] + _BLOCK, side="right")) - 1)
        n = size[k:stop]
        at = np.repeat(first[k:stop] - (done[k:stop] - done[k]), n) + np.arange(done[stop] - done[k])
        x, y = np.repeat(homes[k:stop], n), all_fp[at]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= max_distance
        near &= x != y
        a, b = spanning_links(x[near], y[near])
        found_x.append(a)
        found_y.append(b)
        k = stop
    return spanning_links(np.concatenate(found_x), np.concatenate(found_y))


def _meet(max_distance: int):
    """Rows (anchor, cell, home, fp), sorted by the first two, to links (a, b)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0

        def settle(last: bool) -> pa.RecordBatch:
            """Links of the whole groups that wait; the last one may go on."""
            nonlocal waiting, size
            rows = pa.Table.from_batches(waiting)
            anchor, cell, home, fp = (rows.column(k).to_numpy() for k in range(4))
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])]))
            stop = len(fp) if last else int(new[-1])
            waiting, size = ([] if last else rows.slice(stop).combine_chunks().to_batches()), len(fp) - stop
            new = new[new < stop]
            count = np.diff(np.concatenate([new, [stop]]))
            group = np.repeat(np.arange(len(new)), count)
            use = np.flatnonzero(home[:stop] & (count[group] > 1))
            x, y = _compare(fp[use], fp, new[group[use]], count[group[use]], max_distance)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
            if size >= 4 * CELL:
                yield settle(False)
        if waiting:
            yield settle(True)

    return run


def links(fps: DataFrame, max_distance: int = 3, cell: int = CELL) -> DataFrame:
    """Links a > b that span the near-duplicate components of distinct ``fps`` (column fp)."""
    sent = fps.select("fp").mapInArrow(_send(max_distance), "anchor long, home boolean, fp long")
    counts = sent.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    # At most 100,000 anchors are over this, however many rows there are.
    least = max(cell, 34 * fps.count() // 100_000)
    shares = lambda n: F.ceil(n / cell).cast("int")
    heavy = checkpointed(counts.where(F.col("n") > least).select("anchor", F.greatest(shares(F.col("homes")), F.lit(1)).alias("h"), shares(F.col("n")).alias("g")))
    met = sent.join(F.broadcast(heavy), "anchor", "left")
    own = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    # A home is a guest to other homes as well: it goes to all cells of its share of guests, and of its share of homes.
    every = lambda n: F.sequence(F.lit(0), n - 1)
    as_home = F.transform(every(F.col("g")), lambda k: F.struct((own(F.col("h")) * F.col("g") + k).alias("cell"), F.lit(True).alias("home")))
    as_guest = F.transform(every(F.col("h")), lambda k: F.struct((k * F.col("g") + own(F.col("g"))).alias("cell"), F.lit(False).alias("home")))
    alone = F.array(F.struct(F.lit(0).alias("cell"), F.col("home").alias("home")))
    places = F.when(F.col("h").isNull(), alone).when(F.col("home"), F.concat(as_home, as_guest)).otherwise(as_guest)
    dealt = met.select("anchor", "fp", F.explode(places).alias("p")).select("anchor", "p.cell", "p.home", "fp")
    found = dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(_meet(max_distance), "a long, b long")
    return found.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for every node of ``edges`` (a, b),
    by alternating large-star and small-star contraction."""
    stars = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        mark = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        both = stars.union(stars.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("times"))
        large = join_hot(both.where("b > a"), least, "a", "times", mark["n"], F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("times"))
        small = join_hot(large, least, "a", "times", mark["n"], F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", "m"))
        stars = checkpointed(small.distinct())
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", "b").distinct())


def _grouped(docs: DataFrame, max_distance: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp) of the documents; and for each fp: times, root (the
    least fingerprint of its component) and component_id."""
    held = written(fingerprints(docs, shingle), "fingerprints")
    first = written(held.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("times")), "distinct")
    found = components(links(first, max_distance))
    member = found.join(first, found.node == first.fp).select("node", "root", "first_id")
    least = member.groupBy("root").agg(F.min("first_id").alias("least_id"), F.count("*").alias("n"))
    linked = join_hot(member, least, "root", "n", first.count(), F.col("node")).select(F.col("node").alias("fp"), "root", "least_id")
    by_fp = first.join(linked, "fp", "left").select("fp", "times", F.coalesce("root", "fp").alias("root"), F.coalesce("least_id", "first_id").alias("component_id"))
    return held, written(by_fp, "components")


def near_duplicates(docs: DataFrame, max_distance: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id of its component)."""
    held, by_fp = _grouped(docs, max_distance, shingle)
    return join_hot(held, by_fp, "fp", "times", held.count(), F.xxhash64("doc_id")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, max_distance: int = 3, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component.

    Rows whose doc_id is theirs alone are told by it. Those with a null or
    repeated doc_id, if there are any, are told by doc_id and fingerprint.
    """
    held, by_fp = _grouped(docs, max_distance, shingle)
    rows = written(join_hot(held, by_fp, "fp", "times", held.count(), F.xxhash64("doc_id")).select("doc_id", "fp", "root", "component_id"), "members")
    # The kept row of a component: least doc_id, then least fp.
    stays = rows.where("doc_id <=> component_id").groupBy("root").agg(F.min("fp").alias("fp"), F.first("component_id").alias("keep_id"))
    repeated = checkpointed(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    gone = rows.where("doc_id <> component_id").select("doc_id").union(repeated).distinct()
    gone = checkpointed(gone)
    few = gone.count() <= FEW_GONE
    plain = docs.where("doc_id IS NOT NULL").join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    if repeated.isEmpty() and rows.where("doc_id IS NULL").isEmpty():
        return plain
    fp, nth = free_names("fp", "nth", beside=docs)
    several = repeated.withColumn(nth, F.lit(True))
    odd = docs.join(several, "doc_id", "left").where(F.col("doc_id").isNull() | F.col(nth)).drop(nth)
    odd = odd.withColumn(fp, _fingerprint_udf(shingle)(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    stays = stays.withColumnsRenamed({"fp": "keep_fp"})
    kept = odd.join(stays, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col(fp) == F.col("keep_fp")), "left_semi")
    # Spark keeps one row a key in each task before it shuffles.
    one = kept.withColumn(nth, F.row_number().over(W.partitionBy("doc_id", fp).orderBy(F.lit(0)))).where(F.col(nth) == 1)
    return plain.unionByName(one.select(*(F.col(f"`{c}`") for c in docs.columns)))
