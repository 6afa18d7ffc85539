"""Quality rules: base counters, and the perplexity of a modified Kneser-Ney n-gram model of UTF-8 bytes.

Spark counts the n-grams of every text of every document, per language. Continuation counts, discounts, probabilities and
back-off weights follow from the different n-grams alone. No n-gram is dropped and none can take another's place: a key is
the gram's bytes and its language's number, mixed by a function that is one to one on 64 bits. Where at most `limit`
different grams were counted, the driver makes the model of their sorted array and broadcasts it, as a sorted array of keys
for each order beside arrays of log probabilities and back-off weights; a larger model is made by joins and aggregates and
stays a table, and each different gram of the texts finds its cost by joins. Both round costs to 2^-20 bit and sum whole numbers,
so their results are equal.

Each language gets bounds on bits per byte from the quartiles of its own texts, over all rows, each different text once (so
that a crowd of copies does not close the band): a text outside
[q1 - width * (q3 - q1 + floor), q3 + width * (q3 - q1 + floor)] is rejected. Width 3 is the usual fence of far outliers.

Edge cases: a null or empty text has no words, fails the base rules and has null bits; a null language is a language of
its own; equal texts of one language get equal verdicts; repeated rows stay repeated; an empty table gives no rows;
further columns of the input are ignored whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from .common import HashArray, Scratch, mix, offsets, pieces, small_batches, sums, texts_of, utf8

ORDER = 4
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(9, 14)]] = True
NO_LANGUAGE = "\x00none"
#: Quartile ranges from a quartile to its bound, and bits added to the range, for languages of few or like texts.
WIDTH, FLOOR = 3.0, 0.01
#: Different grams up to which a model is made at the driver and broadcast; a Python worker holds about 40 bytes for each.
LIMIT = 4_000_000
#: Log probabilities and weights are whole multiples of 1 / UNIT bit, so that their sums do not depend on their order.
UNIT = 1 << 20


def repeated(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; words inside 3-word windows that occur twice or more."""
    lines = text.split(b"\n")
    n_lines = 0
    if len(set(lines)) < len(lines):
        n_lines = sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.split())
    words = text.split()
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return n_lines, 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = np.zeros(len(words), bool)
    for i, w in enumerate(windows):
        if w in often:
            covered[i : i + 3] = True
    return n_lines, int(covered.sum())


def counters(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counters of each text."""
    data, at = utf8(texts)
    space = SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1] | False
    if len(data):
        firsts = at[:-1][at[:-1] < at[1:]]
        starts[firsts] = ~space[firsts]
    lines, words = zip(*(repeated(t or b"") for t in texts_of(texts))) if len(texts) else ((), ())
    return {
        "n_words": sums(starts, at),
        "word_chars": sums(~space & ((data & 0xC0) != 0x80), at),
        "n_symbols": sums(SYMBOL[data], at),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": np.array(words, np.int64),
    }


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER bytes that end at each byte, packed; before a text stand zero bytes. And the bounds of texts."""
    data, at = utf8(texts)
    shift = np.repeat(np.arange(1, len(texts) + 1, dtype=np.int64) * (ORDER - 1), np.diff(at))
    padded = np.zeros(len(data) + (ORDER - 1) * len(texts), np.uint32)
    where = np.arange(len(data), dtype=np.int64) + shift
    padded[where] = data
    packed = padded.copy()
    for k in range(1, ORDER):
        packed[k:] |= padded[:-k] << np.uint32(8 * k)
    return packed[where], at


def keys(numbers: np.ndarray | np.uint64, packed: np.ndarray) -> np.ndarray:
    """One key for each pair of a language's number and packed bytes: mix() is one to one."""
    return mix(packed.astype(np.uint64) | numbers << np.uint64(32))


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def flush():
        for lang, parts in held.items():
            distinct, index = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(index, np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(distinct), pa.string()), pa.array(distinct.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    size = 0
    for batch in batches:
        for part in pieces(batch, 0):
            packed, at = grams(part.column(0))
            langs = part.column(1).fill_null(NO_LANGUAGE).to_pylist()
            owner = np.repeat(np.arange(len(langs)), np.diff(at))
            for lang in set(langs):
                mine = packed[np.array([x == lang for x in langs])[owner]] if len(set(langs)) > 1 else packed
                distinct, n = np.unique(mine, return_counts=True)
                held.setdefault(lang, []).append((distinct, n))
                size += len(distinct)
            if size > 2_000_000:
                yield from flush()
                size = 0
    yield from flush()


def counted_grams(docs: DataFrame, scratch: Scratch) -> DataFrame:
    counted = docs.select(F.col("text"), F.col("lang")).mapInArrow(count_grams, "lang string, gram long, n long")
    return scratch.table(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


def model_table(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """(order, lang, gram, logp, logb, n): log2 probability of a gram's last byte, log2 back-off weight of the gram as a context."""
    levels = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):
        below = levels[k + 1].withColumn("gram", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)))
        levels[k] = below.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    prob, out = None, []
    for k in range(1, ORDER + 1):
        level = levels[k].withColumn("ctx", F.shiftright("gram", 8))
        of = lambda i: F.sum((F.col("n") == i).cast("double"))
        d = level.groupBy("lang").agg(*[of(i).alias(f"c{i}") for i in (1, 2, 3, 4)])
        y = F.col("c1") / F.greatest(F.col("c1") + 2 * F.col("c2"), F.lit(1.0))
        rate = lambda i: F.least(F.lit(float(i)), F.greatest(F.lit(0.1), F.when(F.col(f"c{i}") > 0, i - (i + 1) * y * F.col(f"c{i + 1}") / F.greatest(F.col(f"c{i}"), F.lit(1.0))).otherwise(F.lit(0.5))))
        d = d.select(F.col("lang"), *[rate(i).alias(f"d{i}") for i in (1, 2, 3)])
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.join(d, "lang").withColumn("off", off).drop("d1", "d2", "d3")
        ctx = level.groupBy("lang", "ctx").agg(F.sum("n").cast("double").alias("total"), F.sum("off").alias("held"))
        ctx = ctx.select("lang", "ctx", "total", (F.col("held") / F.col("total")).alias("gamma"))
        level = level.join(ctx, ["lang", "ctx"])
        if prob is None:
            lower = level.withColumn("lower", F.lit(1 / 256))
        else:
            base = prob.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            lower = level.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(base, ["lang", "suffix"])
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("gamma") * F.col("lower")
        prob = scratch.table(lower.select("lang", "gram", "n", p.alias("p")), f"p{k}")
        if k > 1:
            weight = ctx.select("lang", F.col("ctx").alias("gram"), F.log2("gamma").alias("logb"))
            out[-1] = out[-1].join(weight, ["lang", "gram"], "left")
        else:
            weight = ctx.select("lang", F.lit(0).alias("order"), F.lit(0).cast("long").alias("gram"), F.lit(1).cast("long").alias("n"), F.lit(-8.0).alias("logp"), F.log2("gamma").alias("logb"))
        out.append(prob.select("lang", F.lit(k).alias("order"), "gram", "n", F.log2("p").alias("logp")))
        if k == 1:
            root = weight
    out[-1] = out[-1].withColumn("logb", F.lit(0.0))
    names = ["lang", "order", "gram", "n", "logp", "logb"]
    table = root.select(names)
    for t in out:
        table = table.unionByName(t.select(names))
    return table


def levels_of(grams: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One language's model from its sorted grams of ORDER bytes and their counts: {order: (grams, logp, logb)}, as model_table()."""
    counts = {ORDER: (grams, n)}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = np.unique(counts[k + 1][0] & np.uint64((1 << 8 * k) - 1), return_counts=True)
    out, lower = {0: (np.zeros(1, np.uint64), np.array([-8.0]), np.zeros(1))}, np.array([1 / 256])
    for k in range(1, ORDER + 1):
        gram, n = counts[k]
        c = [int((n == i).sum()) for i in (1, 2, 3, 4)]
        y = c[0] / max(c[0] + 2 * c[1], 1)
        off = [min(float(i), max(0.1, i - (i + 1) * y * c[i] / max(c[i - 1], 1))) if c[i - 1] else 0.5 for i in (1, 2, 3)]
        off = np.array(off)[np.minimum(n, 3) - 1]
        context, first = np.unique(gram >> np.uint64(8), return_index=True)
        total, held = np.add.reduceat(n.astype(float), first), np.add.reduceat(off, first)
        gamma = held / total
        of = np.repeat(np.arange(len(context)), np.diff(np.r_[first, len(gram)]))
        suffix = np.searchsorted(out[k - 1][0], gram & np.uint64((1 << 8 * (k - 1)) - 1))
        p = (n - off) / total[of] + gamma[of] * lower[suffix]
        at = np.minimum(np.searchsorted(context, out[k - 1][0]), len(context) - 1)
        out[k - 1][2][:] = np.where(context[at] == out[k - 1][0], np.log2(gamma[at]), 0.0)
        out[k], lower = (gram, np.log2(p), np.zeros(len(gram))), p
    return out


def fit(docs: DataFrame, limit: int = LIMIT) -> dict:
    """The model as {"langs": numbers of languages, "orders": {k: (sorted keys, logp, logb)}}, or as {"table"} where more
    than limit different grams were counted: then it is built and used by joins alone."""
    scratch = Scratch(docs.sparkSession, "quality")
    counted = counted_grams(docs, scratch)
    if counted.count() > limit:
        table = scratch.table(model_table(counted, scratch).withColumn("logb", F.coalesce("logb", F.lit(0.0))).drop("n"), "model")
        scratch.drop("grams", *(f"p{k}" for k in range(1, ORDER + 1)))
        return {"table": table}
    got = counted.toArrow()
    scratch.drop("grams")
    names = got.column("lang").combine_chunks().dictionary_encode()
    lang, gram, n = names.indices.to_numpy(), got.column("gram").to_numpy().astype(np.uint64), got.column("n").to_numpy()
    langs = {x: i for i, x in enumerate(names.dictionary.to_pylist())}
    by = np.lexsort((gram, lang))
    lang, gram, n = lang[by], gram[by], n[by]
    ends = np.searchsorted(lang, np.arange(len(langs) + 1))
    models = [levels_of(gram[a:b], n[a:b]) for a, b in zip(ends[:-1], ends[1:])]
    orders = {}
    for k in range(ORDER + 1):
        found = np.concatenate([keys(np.uint64(i), m[k][0]) for i, m in enumerate(models)] or [np.zeros(0, np.uint64)])
        by = np.argsort(found)
        logp, logb = (np.rint(np.concatenate([m[k][j] for m in models] or [np.zeros(0)]) * UNIT).astype(np.int32)[by] for j in (1, 2))
        orders[k] = (found[by], logp, logb)
    return {"langs": langs, "orders": orders}


class Scorer:
    def __init__(self, model: dict) -> None:
        self.langs = model["langs"]
        self.orders = {k: (HashArray(h, 64), p.astype(np.int64), b.astype(np.int64)) for k, (h, p, b) in model["orders"].items()}

    def bits_of(self, texts: pa.Array, langs: list[str | None]) -> np.ndarray:
        """Bits per byte of each text under the model of its language; nan for a text without bytes."""
        packed, at = grams(texts)
        numbers = [self.langs.get(NO_LANGUAGE if x is None else x, len(self.langs)) for x in langs]
        numbers = np.repeat(np.array(numbers, np.uint64), np.diff(at))
        cost = np.zeros(len(packed), np.int64)
        left, k = np.arange(len(packed)), ORDER
        while k and len(left):
            found, logp, _ = self.orders[k]
            index = found.find(keys(numbers[left], packed[left] & np.uint32((1 << 8 * k) - 1)))
            hit = index >= 0
            cost[left[hit]] -= logp[index[hit]]
            left = left[~hit]
            k -= 1
            if len(left):
                found, _, logb = self.orders[k]
                context = (packed[left] >> np.uint32(8)) & np.uint32((1 << 8 * k) - 1)
                index = found.find(keys(numbers[left], context))
                cost[left] -= np.where(index >= 0, logb[np.maximum(index, 0)], 0) if len(logb) else 0
        cost[left] += 8 * UNIT
        n = np.diff(at)
        return np.where(n > 0, sums(cost, at) / np.maximum(n, 1) / UNIT, np.nan)


def grams_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, lang, gram, n) for each distinct gram of each text."""
    for batch in batches:
        for part in pieces(batch, 0):
            packed, at = grams(part.column(0))
            owner = np.repeat(np.arange(part.num_rows, dtype=np.uint64), np.diff(at))
            distinct, n = np.unique(owner << np.uint64(32) | packed, return_counts=True)
            rows = pa.array((distinct >> np.uint64(32)).astype(np.int64))
            gram = pa.array((distinct & np.uint64(0xFFFFFFFF)).astype(np.int64))
            yield pa.record_batch([part.column(2).take(rows), part.column(1).fill_null(NO_LANGUAGE).take(rows), gram, pa.array(n)], ["digest", "lang", "gram", "n"])


def joined_bits(docs: DataFrame, table: DataFrame, scratch: Scratch) -> DataFrame:
    """(bits_digest, bits_lang, bits) of each text and language, by joins with a model of any size; as Scorer.bits_of."""
    held = docs.select("text", "lang", F.sha2("text", 256).alias("digest")).mapInArrow(grams_of_texts, "digest string, lang string, gram long, n long")
    held = scratch.table(held, "held")
    cost, owed = F.lit(None).cast("long"), F.lit(0).cast("long")
    whole = lambda c: F.rint(F.col(c) * UNIT).cast("long")
    each = held.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("rows"))
    for k in range(ORDER, 0, -1):
        mask = lambda order: F.lit((1 << 8 * order) - 1).cast("long")
        own = table.where(F.col("order") == k).select("lang", F.col("gram").alias("_g"), whole("logp").alias(f"logp{k}"))
        back = table.where(F.col("order") == k - 1).select("lang", F.col("gram").alias("_c"), whole("logb").alias(f"logb{k}"))
        each = each.withColumn("_g", F.col("gram").bitwiseAND(mask(k))).join(own, ["lang", "_g"], "left").drop("_g")
        each = each.withColumn("_c", F.shiftright("gram", 8).bitwiseAND(mask(k - 1))).join(back, ["lang", "_c"], "left").drop("_c")
        cost = F.coalesce(cost, owed - F.col(f"logp{k}"))
        owed = owed - F.coalesce(F.col(f"logb{k}"), F.lit(0))
    each = scratch.table(each.select("lang", "gram", "rows", F.coalesce(cost, owed + 8 * UNIT).alias("cost")), "costs")
    # Grams that a ten-thousandth of all rows have are ten thousand at most: they are sent to the rows, the others' rows to them.
    frequent = F.col("rows") > max(1, held.count() // 10_000)
    hot, rare = F.broadcast(each.where(frequent).drop("rows")), each.where(~frequent).drop("rows")
    both = held.join(hot, ["lang", "gram"]).unionByName(held.join(hot, ["lang", "gram"], "left_anti").join(rare, ["lang", "gram"]))
    # Copies of a text add to both sums alike.
    bits = both.groupBy("digest", "lang").agg((F.sum(F.col("n") * F.col("cost")) / F.sum("n") / UNIT).alias("bits"))
    return bits.select(F.col("digest").alias("bits_digest"), F.col("lang").alias("bits_lang"), "bits")


COUNTERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, model: dict, columns: list[str], scratch: Scratch) -> DataFrame:
    """Columns of docs, then _lang, _base_failed, _bits and the counters, of each row; written once, so that the model's broadcast can go."""
    joined = "table" in model
    shared = None if joined else docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias("_text"), F.col("lang").alias("_lang"), *([F.sha2("text", 256).alias("_digest")] if joined else []))
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if joined else Scorer(shared.value)
        for batch in batches:
            for part in pieces(batch, width):
                texts, langs = part.column(width), part.column(width + 1)
                c = counters(texts)
                last = part.column(width + 2) if joined else pa.array(scorer.bits_of(texts, langs.to_pylist()), from_pandas=True)
                made = [langs, pa.array(base_failed(c)), *[pa.array(c[n], pa.int64()) for n in COUNTERS], last]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *made], [f"c{i}" for i in range(width + len(made))])

    last = "_digest string" if joined else "_bits double"
    made = StructType.fromDDL(", ".join(["_lang string", "_base_failed boolean", *[f"_{n} long" for n in COUNTERS], last]))
    kinds = [docs.schema[c].dataType for c in columns]
    fields = StructType([StructField(f"c{i}", kind) for i, kind in enumerate([*kinds, *[f.dataType for f in made]])])
    named = [F.col(f"c{i}").alias(c) for i, c in enumerate([*columns, *made.names])]
    scored = rows.mapInArrow(run, fields).select(*named)
    if joined:
        same = (F.col("_digest") == F.col("bits_digest")) & (F.coalesce("_lang", F.lit(NO_LANGUAGE)) == F.col("bits_lang"))
        scored = scored.join(joined_bits(docs, model["table"], scratch), same, "left").drop("bits_digest", "bits_lang", "_digest").withColumnRenamed("bits", "_bits")
    scored = scratch.table(scored, "scored")
    if shared:
        shared.destroy()
    return scored


def bands(scored: DataFrame, width: float = WIDTH, floor: float = FLOOR) -> DataFrame:
    """(band_lang, low, high): bounds on bits from the quartiles, to 1/1000 bit, of the different texts that the base rules keep."""
    step = F.floor(F.col("_bits") * 1000).cast("long")
    texts = scored.where(~F.col("_base_failed") & F.col("_bits").isNotNull()).select("_lang", F.round("_bits", 6).alias("_bits"), *[f"_{n}" for n in COUNTERS]).distinct()
    bins = texts.groupBy("_lang", step.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_lang").orderBy("bin")
    total = F.sum("n").over(Window.partitionBy("_lang"))
    bins = bins.withColumn("upto", F.sum("n").over(w)).withColumn("total", total)
    at = lambda q: (F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bin"))) / 1000)
    q = bins.groupBy("_lang").agg(at(1).alias("q1"), at(3).alias("q3"))
    reach = (F.col("q3") - F.col("q1") + floor) * width
    return q.select(F.col("_lang").alias("band_lang"), (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def judged(docs: DataFrame, columns: list[str], width: float, floor: float, limit: int) -> DataFrame:
    """Columns of docs, the columns of score(), low, high and _kept. A language without bounds (all its documents failed) keeps nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "quality")
    scored = score(docs, fit(docs, limit), columns, scratch)
    bounds = scratch.table(bands(scored, width, floor), "bounds")
    inside = F.col("_bits").between(F.col("low"), F.col("high"))
    joined = scored.join(bounds, F.col("_lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
    return joined.withColumn("_kept", F.coalesce(~F.col("_base_failed") & inside, F.lit(False)))


def quality(docs: DataFrame, width: float = WIDTH, floor: float = FLOOR, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, lang, counters, base_failed, bits per byte, its language's bounds, kept."""
    rows = judged(docs, ["doc_id"], width, floor, limit)
    return rows.select("doc_id", *[F.col(f"_{n}").alias(n) for n in ("lang", *COUNTERS, "base_failed", "bits")], "low", "high", F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, width: float = WIDTH, floor: float = FLOOR, limit: int = LIMIT) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns."""
    named = docs.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(docs.columns)], "text", "lang")
    rows = judged(named, named.columns[:-2], width, floor, limit).where("_kept")
    return rows.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)])
