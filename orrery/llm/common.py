"""Pieces shared by the corpus operators: shared scratch tables, Arrow text access, hash tables, distributed ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import Scratch, shared_dir, small_batches  # noqa: F401 (the operators take them from here)

#: A word everywhere in this package: a run of anything but ASCII white space. bytes.split() cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def pieces(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts have about limit bytes together (a longer text stays whole)."""
    if not batch.num_rows:
        return
    ends = offsets(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def offsets(texts: pa.Array) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each text starts and ends; a null has no bytes."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at, data = offsets(texts), texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts_of(array: pa.Array) -> list[bytes | None]:
    return array.cast(pa.binary()).to_pylist()


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between successive bounds; empty runs are 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class HashArray:
    """Sorted array of distinct hashes of `bits` bits. A table over the leading bits says where each run of hashes starts."""

    def __init__(self, keys: np.ndarray, bits: int) -> None:
        self.keys = keys.astype(np.uint64)
        self.shift = np.uint64(max(0, bits - max(8, min(22, int(len(keys)).bit_length() + 1))))
        runs = int(np.uint64((1 << bits) - 1) >> self.shift) + 1
        self.first = np.searchsorted(self.keys >> self.shift, np.arange(runs + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.first).max(initial=0))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        if not len(self.keys):
            return out
        run = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[run], self.first[run + 1]
        near = np.minimum(at, len(self.keys) - 1)
        hit = (at < end) & (self.keys[near] == hashes)
        out[hit] = at[hit]
        left = np.flatnonzero(~hit & (at + 1 < end))
        for _ in range(self.longest - 1):
            if not len(left):
                break
            at[left] += 1
            hit = self.keys[at[left]] == hashes[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            left = left[at[left] + 1 < end[left]]
        return out


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null; JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, keys: list[str], key: Column, weight: Column, order: list[str], rows: int = 2_000) -> DataFrame:
    """Adds `before`: the sum of weight over the rows of the same keys that come earlier in (key, order).

    key is a hex string spread evenly (a digest). A group is cut into as many slices of the key's leading digits as its
    size asks for, so that no task holds a large group: sums of slices come first, then each slice runs by itself.
    """
    df = df.withColumn("_k", key).withColumn("_w", weight)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    width = F.least(F.lit(65536), F.greatest(F.lit(1), F.ceil(F.col("_n") / rows))).cast("long")
    size = size.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], width.alias("_slices"))
    on = [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)]
    cut = F.floor(F.conv(F.substring("_k", 1, 8), 16, 10).cast("long") * F.col("_slices") / F.lit(2**32)).cast("long")
    df = df.join(size, on).drop(*[f"_j{i}" for i in range(len(keys))]).withColumn("_s", cut).drop("_slices")
    slices = df.groupBy(*keys, "_s").agg(F.sum("_w").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], F.col("_s").alias("_js"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_b"))
    df = df.join(slices, [*on, F.col("_s") == F.col("_js")]).drop(*[f"_j{i}" for i in range(len(keys))], "_js")
    inside = Window.partitionBy(*keys, "_s").orderBy("_k", *order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", (F.col("_b") + F.coalesce(F.sum("_w").over(inside), F.lit(0))).cast("long")).drop("_b", "_s", "_k", "_w")
