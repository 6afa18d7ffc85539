"""Language ID by prediction by partial matching over UTF-8 bytes.

Each language has a context tree of orders 0 to `ORDER`, with counts of the bytes that follow each context. A byte that was
seen in the longest known context costs -log2(n / (N + d)) bits there, N the context's count and d its distinct bytes; else
the escape costs -log2(d / (N + d)) and the next shorter context is asked, down to a uniform byte (method C, no exclusions,
frozen statistics). A text's language is the one with the fewest bits over the whole text.

As statistics are frozen, the cost of a byte depends on the ORDER bytes before it. The costs under all languages of every
byte string that any of them knows stand in one table, so a position takes one lookup; strings that none knows climb down.

The models are fitted on a bounded sample of labelled rows: for each language the `sample_docs` rows of least md5(doc_id),
whole texts. Prediction covers whole texts of all rows. The score is the winner's share of 2 ** -bits, for an excerpt of
`EXCERPT` bytes of the text's mean costs: near 1 where languages are far apart, near 1 / languages where a text fits all alike.

Edge cases: a null text, or one without a letter, is `und` with score 0; languages tie by name; without learned languages
every text is `und`; repeated rows stay repeated; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HashArray, mix, pieces, small_batches, sums, texts_of, utf8

ORDER = 3
EXCERPT = 8
#: Tasks that count the sample's strings, at most.
COUNTERS = 8
LETTER = regex.compile(r"\p{L}")


def packed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ORDER + 1 bytes that end at each byte; before a text stand zero bytes."""
    n = len(at) - 1
    where = np.arange(len(data), dtype=np.int64) + np.repeat(np.arange(1, n + 1, dtype=np.int64) * ORDER, np.diff(at))
    padded = np.zeros(len(data) + ORDER * n, np.uint32)
    padded[where] = data
    out = padded.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= padded[:-k] << np.uint32(8 * k)
    return out[where]


def tree(strings: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """From counts of strings of ORDER + 1 bytes, for each order k: sorted strings of k + 1 bytes with counts, sorted contexts
    of k bytes with totals and distinct bytes."""
    out = []
    for k in range(ORDER + 1):
        keys, at = np.unique(strings & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
        count = np.bincount(at, n, minlength=len(keys)).astype(np.int64)
        context, first = np.unique(keys >> np.uint32(8), return_index=True)
        out.append((keys, count, context, np.add.reduceat(count, first) if len(count) else count, np.diff(np.r_[first, len(keys)])))
    return out


def count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, string, n) of whole texts: the ORDER + 1 bytes that end at each byte; a task sends a string of a language once."""
    names: dict[str, int] = {}
    both, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for part in pieces(batch, 1):
            data, at = utf8(part.column(1))
            langs = part.column(0).dictionary_encode()
            index = np.array([names.setdefault(x, len(names)) for x in langs.dictionary.to_pylist()], np.uint64)
            owner = np.repeat(index[langs.indices.to_numpy()], np.diff(at))
            new, times = np.unique(owner << np.uint64(32) | packed(data, at), return_counts=True)
            both, place = np.unique(np.concatenate([both, new]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n, times]), len(both)).astype(np.int64)
    if len(both):
        langs = pa.array(list(names), pa.string()).take(pa.array((both >> np.uint64(32)).astype(np.int64)))
        yield pa.record_batch([langs, pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["lang", "string", "n"])


def look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def cost(model: list[tuple[np.ndarray, ...]], strings: np.ndarray, order: int) -> np.ndarray:
    """Bits of the last byte of each string under the contexts of up to `order` bytes before it."""
    out, left = np.zeros(len(strings)), np.arange(len(strings))
    for k in range(order, -1, -1):
        keys, n, contexts, total, distinct = model[k]
        now = strings[left] & np.uint32((1 << 8 * (k + 1)) - 1)
        place, known = look(contexts, now >> np.uint32(8))
        at, hit = look(keys, now)
        size = (total[place] + distinct[place]).astype(float)
        out[left] += np.where(hit, np.log2(size / np.maximum(n[at], 1)), np.where(known, np.log2(size / distinct[place]), 0.0))
        left = left[~hit]
        if not len(left):
            return out
    out[left] += 8.0
    return out


def table(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict:
    """Languages in order of name, and for each order the known strings with their costs (strings, languages)."""
    models = {lang: tree(*counts[lang]) for lang in sorted(counts)}
    orders = []
    for k in range(ORDER + 1):
        keys = np.unique(np.concatenate([m[k][0] for m in models.values()])) if models else np.zeros(0, np.uint32)
        contexts = np.unique(np.concatenate([m[k][2] for m in models.values()])) if models else keys
        costs = np.stack([cost(m, keys, k) for m in models.values()], axis=1) if models else np.zeros((0, 0))
        escapes = np.zeros((len(contexts), len(models)))
        for j, m in enumerate(models.values()):
            at, hit = look(m[k][2], contexts)
            escapes[:, j] = np.where(hit, np.log2((m[k][3] + m[k][4])[at] / m[k][4][at]), 0.0)
        hashed = mix(keys.astype(np.uint64)) >> np.uint64(16)
        by = np.argsort(hashed)
        orders.append((hashed[by], costs[by].astype(np.float32), contexts, escapes))
    return {"languages": list(models), "orders": orders}


class Predictor:
    def __init__(self, model: dict) -> None:
        self.languages = model["languages"]
        self.orders = [(HashArray(h, 48), c, x, e) for h, c, x, e in model["orders"]]

    def bits(self, texts: pa.Array) -> np.ndarray:
        """(texts, languages) code lengths."""
        data, at = utf8(texts)
        strings = packed(data, at)
        costs = np.zeros((len(strings), len(self.languages)), np.float32)
        left = None
        for k in range(ORDER, -1, -1):
            found, known, contexts, escapes = self.orders[k]
            now = (strings if left is None else strings[left]) & np.uint32((1 << 8 * (k + 1)) - 1)
            index = found.find(mix(now.astype(np.uint64)) >> np.uint64(16))
            hit = index >= 0
            if left is None:
                np.take(known, np.maximum(index, 0), axis=0, out=costs) if len(known) else None
                left = np.flatnonzero(~hit)
                costs[left] = 0
            else:
                costs[left[hit]] += known[index[hit]]
                left = left[~hit]
            if not len(left):
                break
            place, there = look(contexts, now[~hit] >> np.uint32(8))
            if len(contexts):
                costs[left] += np.where(there[:, None], escapes[place], 0.0)
        else:
            costs[left] += 8.0
        return np.stack([sums(costs[:, j].astype(np.float64), at) for j in range(len(self.languages))], axis=1) if self.languages else np.zeros((len(texts), 0))


def fit(docs: DataFrame, sample_docs: int = 400) -> dict:
    """The model of the labelled rows (doc_id, text, lang): rows without text or language teach nothing.

    Learns from at most sample_docs different rows a language, whole texts; Spark counts their strings, and only counts
    come to the driver."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where("text != '' and lang is not null and doc_id is not null").withColumn("hash", F.xxhash64("text"))
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    ids = rows.select("doc_id", "lang", "hash", F.spark_partition_id().alias("part"))
    for groups in (256, 16, 1):  # the least of a language are among the least of its groups, so no task sorts a whole language
        least = Window.partitionBy("lang", F.col("part") % groups).orderBy(digest, "doc_id", "hash")
        ids = ids.withColumn("n", F.row_number().over(least)).where(F.col("n") <= sample_docs)
    ids = ids.select(F.col("doc_id").alias("i"), F.col("lang").alias("l"), F.col("hash").alias("h")).distinct()
    sample = rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("i")) & (F.col("lang") == F.col("l")) & (F.col("hash") == F.col("h")), "left_semi")
    sample = sample.dropDuplicates(["doc_id", "lang", "hash"]).select("lang", "text")  # a row that repeats teaches once
    sample = sample.coalesce(COUNTERS)  # the sample is bounded, and the more tasks the more often they send the same strings
    got = sample.mapInArrow(count_strings, "lang string, string long, n long").groupBy("lang", "string").agg(F.sum("n").alias("n")).toArrow()
    names = got.column("lang").combine_chunks().dictionary_encode()
    lang, string, n = names.indices.to_numpy(), got.column("string").to_numpy().astype(np.uint32), got.column("n").to_numpy()
    return table({x: (string[lang == i], n[lang == i]) for i, x in enumerate(names.dictionary.to_pylist())})


def predict(docs: DataFrame, model: dict, extra: list[Column] | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, lang_pred, score, bits_per_byte."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        names = np.array([*predictor.languages, "und"], object)
        for batch in batches:
            for part in pieces(batch, 1, 2 << 20):
                texts = part.column(1)
                bits = predictor.bits(texts)
                letters = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
                if predictor.languages:
                    best = bits.argmin(axis=1)
                    low = bits[np.arange(len(bits)), best]
                    share = EXCERPT / np.maximum(np.diff(utf8(texts)[1]), EXCERPT)
                    score = 1 / np.exp2(np.maximum((low[:, None] - bits) * share[:, None], -1000)).sum(axis=1)
                else:
                    best, low, score, letters = np.zeros(len(bits), int), np.zeros(len(bits)), np.zeros(len(bits)), letters & False
                best = np.where(letters, best, len(names) - 1)
                n = np.diff(utf8(texts)[1])
                yield pa.record_batch([part.column(0), pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, low / np.maximum(n, 1), 0.0))], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; a null id is in fold -1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)), F.lit(-1))


def identify(docs: DataFrame, sample_docs: int = 400) -> DataFrame:
    """Learns from the rows whose fold is not 2 and predicts all: doc_id, held_out, lang_pred, score, bits_per_byte."""
    model = fit(docs.where(fold(F.col("doc_id")) != 2), sample_docs)
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")
