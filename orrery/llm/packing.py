"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the longest permitted length are cut into pieces of that length and a rest. Best-fit decreasing then
runs on the histogram of piece lengths, which has no more entries than the longest length has tokens, so the plan is made
at the driver whatever the number of documents. Bins are intervals of bin numbers that all hold the same, and an interval is
filled at a time. The bins equal those of placing one piece after another, longest first, each into the open bin of least
free space that takes it, of equal ones that of the least number (test_operators.py compares the two): a bin that takes a
piece takes the next of its length too, as long as it can. Where no open bin takes a piece, a bin is opened: for each
permitted length a greedy filling from the pieces left is tried, and the length of least cost per token packed wins. At last
every bin is downsized to the least permitted length that holds its contents. The plan is a list of runs (length, first
rank, count, first bin, offset); each piece finds its run by its rank among the pieces of its length, in a sorted array.

The number of runs depends on the permitted lengths alone (steps split at most one interval each), so the broadcast of the
plan has a bound; ranks are counted in slices of a length, so that a frequent length does not land in one task. Texts are
read once; lengths go to a table in the shared folder.

Edge cases: a null or negative length counts 0; a document of length 0 has one piece of length 0 in no bin; repeated rows
are packed each; equal lengths are ranked by a digest of doc_id, then doc_id and the row's tie column; an empty table gives
no rows; further columns are ignored whatever their names.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, running

CAPACITIES = (512, 1024, 2048, 4096)


def padding_cost(capacity: int) -> float:
    """A sequence costs its length, and attention that grows with its square."""
    return capacity + 16 + capacity * capacity / 65536


def fill(capacity: int, length: int, left: dict[int, int], lengths: list[int]) -> int:
    """Tokens of one bin that is opened for a piece of this length and filled with the longest pieces left that fit."""
    used, taken = length, {length: 1}
    at = bisect.bisect_right(lengths, capacity - used)
    while at:
        x = lengths[at - 1]
        n = min((capacity - used) // x, left[x] - taken.get(x, 0))
        if n > 0:
            used += n * x
            taken[x] = taken.get(x, 0) + n
        at = min(at - 1, bisect.bisect_right(lengths, capacity - used))
    return used


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = padding_cost) -> tuple[list[tuple], list[tuple]]:
    """Runs (length, rank, count, bin, offset) and bins (first bin, count, used, capacity) of a histogram of lengths."""
    capacities = tuple(sorted(capacities))
    left = {k: n for k, n in histogram.items() if n > 0}
    lengths = sorted(left)
    room: dict[int, list[tuple[int, int, int]]] = {}  # free tokens: heaps of intervals (first bin, count, used)
    free: list[int] = []  # the keys of room, sorted
    runs, bins, n_bins = [], [], 0

    def put(space: int, interval: tuple[int, int, int]) -> None:
        if interval[1] <= 0:
            return
        if space not in room:
            bisect.insort(free, space)
            room[space] = []
        heapq.heappush(room[space], interval)

    for length in sorted(left, reverse=True):
        rank, n = 0, left[length]

        def place(first: int, count: int, used: int, space: int, each: int) -> int:
            """Puts `each` pieces into every bin of an interval; how many pieces that were."""
            runs.extend((length, rank + j * count, count, first, used + j * length) for j in range(each if count else 0))
            put(space - each * length, (first, count, used + each * length))
            return count * each

        while n:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, count, used = heapq.heappop(room[space])
                if not room[space]:
                    del room[space], free[at]
                each = space // length
                full = min(count, n // each)
                done = place(first, full, used, space, each)
                if full < count and n > done:  # the last pieces fill one more bin in part
                    rank += done
                    more = place(first + full, 1, used, space, n - done)
                    rank, done, full = rank - done, done + more, full + 1
                put(space, (first + full, count - full, used))
            else:
                left[length] = n
                best = min((c for c in capacities if c >= length), key=lambda c: (cost(c) / fill(c, length, left, lengths), c))
                each = min(n, best // length)
                # As long as more pieces are left than any bin takes, each new bin is like the last.
                count = max(1, (n - capacities[-1] // length) // each)
                done = place(n_bins, count, 0, best, each)
                n_bins += count
            rank, n = rank + done, n - done
        left[length] = 0
        lengths.pop()
    for intervals in room.values():
        for first, count, used in intervals:
            bins.append((first, count, used, next(c for c in capacities if c >= used)))
    return runs, bins


def pack(docs: DataFrame, length: Column, tie: Column, capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = padding_cost) -> DataFrame:
    """One row per piece of each row of docs (doc_id): doc_id, piece, start, length, bin_id, bin_offset, capacity, bin_used."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    most = max(capacities)
    rows = scratch.table(docs.select("doc_id", F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("total"), tie.alias("tie")), "lengths")
    count = F.greatest(F.ceil(F.col("total") / most), F.lit(1)).cast("int")
    rows = rows.select("doc_id", "tie", "total", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = F.col("piece").cast("long") * most
    rows = rows.select("doc_id", "tie", "piece", start.alias("start"), F.least(F.col("total") - start, F.lit(most)).alias("length"))
    histogram = {r["length"]: r["n"] for r in rows.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, bins = plan(histogram, capacities, cost)
    bins.sort()
    heads = np.array([b[0] for b in bins], np.int64)
    whole = []
    for k, rank, n, first, offset in runs:
        at = first  # a run covers bins of several final intervals
        while at < first + n:
            head, m, used, capacity = bins[int(np.searchsorted(heads, at, side="right")) - 1]
            take = min(first + n, head + m) - at
            whole.append((k, rank + at - first, at, offset, capacity, used))
            at += take
    shared = spark.sparkContext.broadcast(np.array(sorted(whole), np.int64).reshape(-1, 6))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string")).cast("binary"))
    ranked = running(rows, ["length"], key, F.lit(1).cast("long"), ["doc_id", "piece", "tie"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = shared.value
        place = lambda k, rank: k.astype(np.uint64) << np.uint64(42) | rank.astype(np.uint64)
        starts = place(run[:, 0], run[:, 1])
        for batch in batches:
            k, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            none = k == 0
            mine = run[np.maximum(np.searchsorted(starts, place(k, rank), side="right") - 1, 0)] if len(run) else np.zeros((len(k), 6), np.int64)
            made = (mine[:, 2] + rank - mine[:, 1], mine[:, 3], mine[:, 4], mine[:, 5])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(x, pa.int64(), mask=none) for x in made]], names)

    names = ["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "capacity", "bin_used"]
    ranked = ranked.select("doc_id", "piece", "start", "length", "before")
    fields = [ranked.schema["doc_id"], ranked.schema["piece"], *[StructField(c, LongType()) for c in names[2:]]]
    return ranked.mapInArrow(find, StructType(fields))
