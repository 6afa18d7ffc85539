"""Substring dedup: windows of 50 words that an earlier document (smaller doc_id) also has are cut out.

Super-k-mer partitioning. The minimiser of a window is its 16-word run of the least hash (leftmost among equals).
Consecutive windows with the same minimiser travel as one packed string to the minimiser's bucket; a window's minimiser
depends on its words alone, so equal windows always meet. A bucket's windows are sorted by their words and doc_id: in
each run of equal windows those of a larger doc_id than the first are repeats. Before that, minimisers are counted over
all documents, and a Bloom filter (bounded bits) keeps at home the strings whose minimiser occurs in one document only.

A minimiser with more than `hot` occurrences (at least a millionth of all, so at most a million of them exist) would
make one bucket large. Such buckets are split by a second hash, that of the window: their windows are counted first
(pre-aggregated where they are), go to the split buckets one by one, and are sorted there like all others. Only what one
window repeats more than `hot` times stays where it is: the least doc_id of these windows (again at most a million) is
sent to all tasks, under 128-bit digests of the windows.

Edge cases: a null text has no words; a null doc_id neither removes nor loses words; rows of the same doc_id don't
remove each other's words; empty and short texts (under 50 words) lose none; an empty table gives no rows; further
columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, pieces, small_batches, texts_of

WINDOW, MINIMISER = 50, 16


def minimisers(words: list[bytes], window: int = WINDOW, m: int = MINIMISER) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the words: its minimiser's hash and position."""
    n = len(words) - m + 1
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = np.zeros(n, np.uint64)
    for k in range(m):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    best, at = mix(runs), np.arange(n)
    left, width = window - m + 1, 1
    while width < left:
        step = min(width, left - width)
        a, b = best[:-step], best[step:]
        first = a <= b
        best, at = np.where(first, a, b), np.where(first, at[:-step], at[step:])
        width += step
    return best, at


def segments(words: list[bytes], window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: hash of the minimiser, first window, last window."""
    best, at = minimisers(words, window, m)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return best[new], new, np.r_[new[1:] - 1, len(best) - 1]


def bloom(keys: DataFrame, count: int, scratch: Scratch) -> np.ndarray:
    """Bits set at the trailing part of each key, 8 to 16 bits a key, at most 2 ** 30 (128 MB); built in slices."""
    size = min(30, max(20, (8 * count).bit_length()))
    slice_bits = min(size, 20)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, None

        def done():
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["slice", "bits"])

        for b in batches:
            which, place = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in np.unique(which):
                if s != now:
                    if now is not None:
                        yield done()
                    now, bits = s, np.zeros(1 << slice_bits, bool)
                bits[place[which == s]] = True
        if now is not None:
            yield done()

    place = F.col("mini").bitwiseAND(F.lit((1 << size) - 1))
    cut = keys.select(F.shiftright(place, slice_bits).alias("slice"), place.bitwiseAND(F.lit((1 << slice_bits) - 1)).alias("place"))
    rows = cut.repartition("slice").sortWithinPartitions("slice").mapInArrow(fill, "slice long, bits binary")
    out = np.zeros(1 << size >> 3, np.uint8)
    each = 1 << slice_bits >> 3
    for r in rows.toLocalIterator():
        out[r["slice"] * each : (r["slice"] + 1) * each] |= np.frombuffer(r["bits"], np.uint8)
    return out


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def key_of(digest: bytes) -> int:
    """The bucket of a window whose minimiser's bucket is split."""
    return int.from_bytes(digest[:8], "big", signed=True)


def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array."""
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys if len(some) else np.zeros(len(keys), bool)


def repeats(buckets: np.ndarray, ids: np.ndarray, packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last window of the runs of windows that a smaller id also has in the same bucket.

    Words are numbered, windows sorted by (bucket, hash of the numbers, id), and neighbours compared number by number;
    should two different windows share a hash, they are sorted by their numbers themselves.
    """
    numbers: dict[bytes, int] = {}
    words = [p.split() for p in packed]
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for row in words for x in row), np.int32)
    size = np.fromiter(map(len, words), np.int64, len(words))
    n = np.maximum(size - window + 1, 0)
    row = np.repeat(np.arange(len(words)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    if not len(row):
        return row, inside, inside
    at = np.repeat(np.cumsum(size) - size, n) + inside
    v, h = mix(w.astype(np.uint64) + np.uint64(1)), np.zeros(len(w) - window + 1, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + v[k : k + len(h)]

    def order(h):
        by = np.lexsort((ids[row], h, buckets[row]))
        equal = (h[by[1:]] == h[by[:-1]]) & (buckets[row[by[1:]]] == buckets[row[by[:-1]]])
        return by, equal

    h = h[at]
    by, equal = order(h)
    x, y = at[by[1:][equal]], at[by[:-1][equal]]
    if any((w[x + k] != w[y + k]).any() for k in range(window)):
        h = np.unique(w[at[:, None] + np.arange(window)], axis=0, return_inverse=True)[1].reshape(-1)
        by, equal = order(h)
    run = np.flatnonzero(np.r_[True, ~equal])
    least = np.repeat(ids[row[by[run]]], np.diff(np.r_[run, len(by)]))
    found = np.sort(by[ids[row[by]] > least])
    if not len(found):
        return found, found, found
    new = np.flatnonzero(np.r_[True, (np.diff(found) != 1) | (np.diff(row[found]) != 0)])
    last = np.r_[new[1:] - 1, len(found) - 1]
    return row[found[new]], inside[found[new]], inside[found[last]]


def repeated_ranges(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, hot: int = 20_000) -> DataFrame:
    """(doc_id, text_hash, start, stop): word ranges, stop exclusive, that windows repeated from smaller ids cover."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "substrings")
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                ids, minis = [], []
                for i, text in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
                    words = text.split()
                    if len(words) >= window:
                        found = segments(words, window, m)[0]
                        ids.append(np.full(len(found), i, np.int64))
                        minis.append(found.view(np.int64))
                if ids:
                    yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(minis))], ["doc_id", "mini"])

    seen = rows.select("doc_id", "text").mapInArrow(count, "doc_id long, mini long")
    seen = seen.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    seen = scratch.table(seen.select("mini", "n"), "minis")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(hot, total // 1_000_000)
    often = np.array(sorted(r[0] for r in seen.where(F.col("n") > limit).select("mini").toLocalIterator()), np.int64)
    keys, least = seen.where(F.col("n") <= limit).select("mini"), {}
    if len(often):
        wanted = spark.sparkContext.broadcast(often)

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, 1, 1 << 20):
                    ids, found = [], []
                    for i, text in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
                        words = text.split()
                        if len(words) < window:
                            continue
                        mini, first, last = segments(words, window, m)
                        for k in np.flatnonzero(among(mini.view(np.int64), wanted.value)):
                            for j in range(first[k], last[k] + 1):
                                ids.append(i)
                                found.append(digest_of(words[j : j + window]))
                    if ids:
                        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "digest"])

        each = rows.select("doc_id", "text").mapInArrow(digests, "doc_id long, digest binary").groupBy("digest")
        each = each.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
        each = scratch.table(each.select("digest", "lo", "n"), "windows")
        many = max(hot, each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // 1_000_000)
        least = {bytes(r["digest"]): r["lo"] for r in each.where(F.col("n") > many).select("digest", "lo").toLocalIterator()}
        key = F.conv(F.substring(F.hex("digest"), 1, 16), 16, -10).cast("long")
        keys = keys.union(each.where(F.col("n") <= many).select(key.alias("mini")))
    shared = spark.sparkContext.broadcast((bloom(keys, keys.count(), scratch), often, least))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often, least = shared.value
        mask = np.uint64(8 * len(bits) - 1)

        def wanted(keys: np.ndarray) -> np.ndarray:
            place = keys & mask
            return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1 > 0

        for batch in batches:
            for part in pieces(batch, 2, 1 << 20):
                out = []
                for i, h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part.column(2))):
                    words = text.split()
                    if len(words) < window:
                        continue
                    mini, first, last = segments(words, window, m)
                    split = among(mini.view(np.int64), often)
                    at = np.flatnonzero(wanted(mini) & ~split)
                    for k, a, b in zip(mini[at].view(np.int64).tolist(), first[at].tolist(), last[at].tolist()):
                        out.append((k, i, h, a, b + window, b" ".join(words[a : b + window])))
                    gone = np.zeros(len(words) - window + 2, np.int8)
                    for k in np.flatnonzero(split):
                        for j in range(first[k], last[k] + 1):
                            digest = digest_of(words[j : j + window])
                            if digest in least:
                                gone[j] = least[digest] < i
                            elif wanted(np.array([key_of(digest)], np.int64).view(np.uint64))[0]:
                                out.append((key_of(digest), i, h, j, j + window, b" ".join(words[j : j + window])))
                    edges = np.flatnonzero(np.diff(gone, prepend=0)).tolist()
                    for a, b in zip(edges[::2], edges[1::2]):  # decided here: travels to any bucket, without words
                        out.append((h ^ a, i, h, a, b - 1 + window, None))
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(),) * 5 + (pa.binary(),))], ["mini", "doc_id", "text_hash", "start", "stop", "packed"])

    def sort_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(part: list[tuple]) -> Iterator[pa.RecordBatch]:
            out = [x[1:5] for x in part if x[5] is None]
            part = [x for x in part if x[5] is not None]
            if part:
                key, ids = (np.fromiter((x[c] for x in part), np.int64, len(part)) for c in (0, 1))
                for r, a, b in zip(*(c.tolist() for c in repeats(key, ids, [x[5] for x in part], window))):
                    _, i, h, start, _, _ = part[r]
                    out.append((i, h, start + a, start + b + window))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "text_hash", "start", "stop"])

        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns)))
            if held and held[0][0] != held[-1][0]:
                cut = len(held) - 1
                while held[cut - 1][0] == held[-1][0]:
                    cut -= 1
                yield from done(held[:cut])
                held = held[cut:]
        yield from done(held)

    sent = rows.mapInArrow(send, "mini long, doc_id long, text_hash long, start long, stop long, packed binary")
    return sent.repartition("mini").sortWithinPartitions("mini").mapInArrow(sort_count, "doc_id long, text_hash long, start long, stop long")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, hot: int = 20_000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept_text (words joined by a space)."""
    found = repeated_ranges(docs, window, m, hot).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    found = found.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), "ranges")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.join(found, (F.col("doc_id") == F.col("i")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                n, removed, sha, texts = [], [], [], []
                for text, ranges in zip(texts_of(part.column(1)), part.column(2).to_pylist()):
                    words = (text or b"").split()
                    n.append(len(words))
                    if ranges:
                        gone = np.zeros(len(words) + 1, np.int64)
                        for r in ranges:
                            gone[r["start"]] += 1
                            gone[r["stop"]] -= 1
                        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
                    kept = b" ".join(words)
                    removed.append(n[-1] - len(words))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept)
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
