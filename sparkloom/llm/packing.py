"""Best-fit packing of documents into token sequences by bin completion.

Only documents longer than a sequence are cut. What is packed is the histogram
of piece lengths, at most ``capacity`` numbers however many documents there
are: the driver searches it, and tasks then place every piece by its rank among
the pieces of its length.

The search (``complete_bins``) is one branch-and-bound for histograms of any
size. It takes the longest piece left and enumerates the fillings of the space
beside it, least waste first and longer pieces first among equals. Which sums
the pieces left can make is kept as one bit set a length, so that no attempt
ends without a filling. Fillings that another one dominates (a piece could be
added, or one but the longest be changed for a longer) are skipped, but count
as branchings too, so that ``nodes`` bounds all work. A filling
is applied as often as the counts allow, and once on the way back. Branches are
cut where the waste so far, or a lower bound on the bins of what is left, can't
beat the incumbent. The first incumbent is best-fit decreasing; a completed
plan of as many bins takes its place, and from then on only fewer bins will do.

The search ends at the lower bound, when all branches are done (then the plan
is proven best), or after ``nodes`` branchings, with the incumbent; ``Packed``
says which. Every applied filling uses up a length or nearly so; the plan has
at most a few rows per length, so its broadcast is bounded by ``capacity`` too.

Defined cases: null and empty texts have the end id alone; repeated rows are
packed once each; a null doc_id packs like any other; no rows, no pieces;
other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm._common import shuffle_width, written
from sparkloom.llm.word_ids import broadcast_tokenizer, encoder

Filling = tuple[tuple[int, int], ...]  # (length, times), longest first
Plan = list[tuple[Filling, int]]  # filling, number of bins

#: Branchings after which the search gives back the incumbent.
NODES = 20_000


class Packed(NamedTuple):
    plan: Plan
    branchings: int
    completed: bool  # the plan is from bin completion, not the best-fit incumbent
    lower_bound: int
    proven: bool  # no plan has fewer bins


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Best fit over lengths in descending order, all pieces of a length at once."""
    open_bins: dict[int, list[tuple[Filling, int]]] = {}  # by space left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for space in sorted(s for s in open_bins if s >= length):
            fits = space // length
            while left and open_bins.get(space):
                filling, bins = open_bins[space].pop()
                full = min(bins, left // fits)
                if full:
                    open_bins.setdefault(space - fits * length, []).append(((*filling, (length, fits)), full))
                    left -= full * fits
                    bins -= full
                if bins and left:  # fewer than fits
                    open_bins.setdefault(space - left * length, []).append(((*filling, (length, left)), 1))
                    bins, left = bins - 1, 0
                if bins:
                    open_bins.setdefault(space, []).append((filling, bins))
        fits = capacity // length
        if left >= fits:
            open_bins.setdefault(capacity - fits * length, []).append((((length, fits),), left // fits))
        if left % fits:
            open_bins.setdefault(capacity - left % fits * length, []).append((((length, left % fits),), 1))
    return [x for found in open_bins.values() for x in found]


def lower_bound(counts: np.ndarray) -> int:
    """Bins that ``counts`` pieces by length (0 to the capacity) need at least:
    for every threshold, pieces that leave less than it and those over half
    take a bin each, and the middle-sized ones need what space these don't have."""
    capacity, half = len(counts) - 1, (len(counts) - 1) // 2
    n = np.concatenate([[0], np.cumsum(counts)])  # n[k]: pieces shorter than k
    volume = np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    k = np.arange(half + 1)
    alone = n[-1] - n[capacity - k + 1]
    over_half, their_volume = n[capacity - k + 1] - n[half + 1], volume[capacity - k + 1] - volume[half + 1]
    missing = volume[half + 1] - volume[k] - (over_half * capacity - their_volume)
    return int((alone + over_half + np.maximum(0, -(-missing // capacity))).max())


class _Stock:
    """Counts by length, and which sums the shortest lengths can make."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.lengths = capacity, sorted(counts)
        self.place = {n: k for k, n in enumerate(self.lengths)}
        self.left = [counts[n] for n in self.lengths]
        self.by_length = np.zeros(capacity + 1, np.int64)
        self.by_length[self.lengths] = self.left
        self.sums, self.mask = [1] * (len(self.lengths) + 1), (1 << (capacity + 1)) - 1
        self.valid = 0  # sums[0] to sums[valid] are as the counts are

    def take(self, filling: Filling, bins: int) -> None:
        for n, times in filling:
            k, most = self.place[n], self.capacity // n
            before = self.left[k]
            self.left[k] = after = before - times * bins
            self.by_length[n] = after
            if min(before, most) != min(after, most):
                self.valid = min(self.valid, k)

    def reach(self, k: int) -> int:
        """Bit s: some of the pieces of the ``k`` shortest lengths add up to s."""
        while self.valid < k:
            n, times = self.lengths[self.valid], min(self.left[self.valid], self.capacity // self.lengths[self.valid])
            bits, step = self.sums[self.valid], 1
            while times:
                step = min(step, times)
                bits |= bits << (n * step)
                times -= step
                step *= 2
            self.valid += 1
            self.sums[self.valid] = bits & self.mask
        return self.sums[k]

    def longest(self) -> int:
        """Place of the longest piece left."""
        return int(np.flatnonzero(self.by_length)[-1])

    def adding_up(self, k: int, total: int, used: dict[int, int]) -> Iterator[None]:
        """Each way to make ``total`` of the ``k`` shortest lengths, put into ``used``."""
        if not total:
            yield
            return
        for j in range(min(k, bisect_right(self.lengths, total)) - 1, -1, -1):
            if not self.reach(j + 1) >> total & 1:
                return
            n, held = self.lengths[j], used.get(self.lengths[j], 0)
            for times in range(min(self.left[j] - held, total // n), 0, -1):
                if self.reach(j) >> (total - times * n) & 1:
                    used[n] = held + times
                    yield from self.adding_up(j, total - times * n, used)
                    used[n] = held
                    if not held:
                        del used[n]

    def _free(self, low: int, high: int, used: dict[int, int]) -> bool:
        """There is a piece over ``low`` and up to ``high`` beside the ``used``."""
        a, b = bisect_right(self.lengths, low), bisect_right(self.lengths, high)
        return any(self.left[k] > used.get(self.lengths[k], 0) for k in range(a, b))

    def fillings(self) -> Iterator[tuple[int, Filling]]:
        """(waste, filling) around the longest piece, least waste first; an empty
        filling stands for one that is dominated."""
        longest = self.longest()
        space, used = self.capacity - longest, {longest: 1}
        k = bisect_right(self.lengths, space)
        first = True
        for waste in range(space + 1):
            if not self.reach(k) >> (space - waste) & 1:
                continue
            for _ in self.adding_up(k, space - waste, used):
                swapped = (n for n, times in used.items() if n != longest or times > 1)
                dominated = not first and (self._free(0, waste, used) or any(self._free(n, n + waste, used) for n in swapped))
                yield waste, () if dominated else tuple(sorted(used.items(), reverse=True))
            first = False


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = NODES) -> Packed:
    """Fillings and how many bins have each, for ``counts`` pieces by length."""
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return Packed([], 0, True, 0, True)
    best, completed, branchings = best_fit_decreasing(counts, capacity), False, 0
    stock = _Stock(counts, capacity)
    total, lower = sum(k * v for k, v in counts.items()), lower_bound(stock.by_length)
    limit = total_bins(best)  # bins that a plan may have
    plan, used, wasted = [], 0, 0

    def choices() -> Iterator[tuple[int, Filling, int]]:
        for waste, filling in stock.fillings():
            if not filling:
                yield waste, (), 0
                continue
            most = min(stock.left[stock.place[n]] // times for n, times in filling)
            if waste:  # as often as the waste allows
                most = min(most, max(1, (limit * capacity - total - wasted) // waste))
            yield waste, filling, most
            if most > 1:
                yield waste, filling, 1

    stack = [choices()]
    while stack and branchings < nodes and not (completed and limit < lower):
        waste, filling, bins = next(stack[-1], (capacity * limit, (), 0))
        branchings += 1
        if wasted + waste > limit * capacity - total:  # no filling, or none with so little waste
            stack.pop()
            if plan:
                filling, bins = plan.pop()
                stock.take(filling, -bins)
                used, wasted = used - bins, wasted - bins * (capacity - sum(n * t for n, t in filling))
            continue
        if not filling:
            continue
        stock.take(filling, bins)
        if used + bins + lower_bound(stock.by_length) > limit:
            stock.take(filling, -bins)
            continue
        plan.append((filling, bins))
        used, wasted = used + bins, wasted + bins * waste
        if stock.by_length.any():
            stack.append(choices())
            continue
        best, completed, limit = list(plan), True, used - 1
        plan.pop()
        stock.take(filling, -bins)
        used, wasted = used - bins, wasted - bins * waste
    return Packed(best, branchings, completed, lower, not stack or total_bins(best) == lower)


def slots(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), by length and rank."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, bins in plan:
        offset = 0
        for length, times in filling:
            rows.append((length, ranks.get(length, 0), times, sequence, offset))
            ranks[length] = ranks.get(length, 0) + times * bins
            offset += length * times
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _cut(tokenizer: Broadcast, end_id: int, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer.value)
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                ids = encode(text.as_py()) + end
                for n, x in enumerate(range(0, len(ids), step)):
                    part = ids[x : x + step]
                    at.append(k), piece.append(n), start.append(x // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            made = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place(plan: Broadcast):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        order = np.rec.fromarrays([rows[:, 0], rows[:, 1]])
        for batch in batches:
            *kept, length, crc, rank = batch.columns
            n, r = length.to_numpy(), rank.to_numpy()
            if len(n):
                at = np.searchsorted(order, np.rec.fromarrays([n, r], dtype=order.dtype), side="right") - 1
                nth = r - rows[at, 1]
                sequence, offset = rows[at, 3] + nth // rows[at, 2], rows[at, 4] + nth % rows[at, 2] * n
            else:
                sequence = offset = n
            yield pa.RecordBatch.from_arrays([*kept, length, crc, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: what is to be packed."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = _cut(broadcast_tokenizer(docs.sparkSession, tokenizer_path), end_id, capacity)
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, nodes: int = NODES) -> DataFrame:
    """One row a piece, with its sequence_id and its offset there."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    # Ranks within a length, which may hold any share of the rows: by bucket, then over the buckets' counts.
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(2, shuffle_width(spark)))).alias("bucket")
    counts = pieces.groupBy("length", bucket).count()
    before = F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    first = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = spark.sparkContext.broadcast(slots(complete_bins(histogram, capacity, nodes).plan))
    by = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("bucket", bucket).withColumn("nth", F.row_number().over(by)).join(first, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth") - 1).alias("rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(_place(plan), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: sequences, tokens, and the least number of sequences that could hold them."""
    whole = packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens"))
    return whole.withColumn("lower_bound", F.ceil(F.col("tokens") / capacity))


def total_bins(plan: Iterable[tuple[Filling, int]]) -> int:
    return sum(bins for _, bins in plan)
