"""Near-duplicate documents: b-bit MinHash.

A document's set is its distinct 5-word shingles (ASCII letters lower-cased; with fewer words the whole sequence). 160
minima of 32-bit permutations are cut into 40 bands of 4 that give candidates; the low 4 bits of each minimum are packed
into ten longs. A candidate pair whose collision-corrected similarity, from counts of differing bits, is hopeless (more
than 5.5 standard deviations under the threshold) ends there; the others are confirmed on full shingle sets. A pair at
similarity 0.75 misses all bands with probability 2.5e-7, one at 0.8 with 6e-10.

Texts of the same word sequence form a class and only one of them goes on. Each band's bucket has a pivot: the class that
shares the most buckets' places with others, which in a group of copies is the text they were made from. Every class is
compared with its buckets' pivots by the packed bits and linked with the nearest if full sets confirm it: a row a class and
bucket, whatever the bucket's size. Buckets that then still hold several components need more pairs, but all pairs of a
bucket would grow with its square. Their classes find their partners in other components by an exact prefix filter
instead, whatever the bucket's size: with the shingles of each set in order of frequency, two sets of enough similarity
share one near the start of both. The pairs pass the packed bits and the full sets as before. Frequent shingles come last
in that order and are hardly ever sent.

Edge cases: a null or empty text, or one without words, has n_shingles 0 and is its own component; repeated rows stay
repeated, under one component, all of them kept or none; equal texts link whatever their ids; a null doc_id never names a
component that has other ids and is kept only where its component has none (of several texts the one of least digest);
an empty table gives no rows; further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, pieces, small_batches, texts_of
from .components import components

WIDTH, BANDS, ROWS, BITS = 5, 40, 4, 4
HASHES = BANDS * ROWS
LONGS = HASHES * BITS // 64
SLOTS = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
MULTIPLY = (_RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
PLACE = _RNG.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BAND = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sequence(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def key_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < width:
        return mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], np.uint64))
    place = PLACE if width == WIDTH else mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out += h[k : n - width + 1 + k] * place[k]
    return np.unique(mix(out))


def minima(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, (x[at : at + 256, None] * MULTIPLY + ADD).min(axis=0), out=out)
    return out


def pack(minima: np.ndarray) -> np.ndarray:
    """(documents, HASHES) minima to (documents, LONGS): BITS low bits of each."""
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minima), LONGS, -1)
    return (low << (np.arange(low.shape[2], dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(minima: np.ndarray) -> np.ndarray:
    parts = minima.astype(np.uint64).reshape(len(minima), BANDS, ROWS)
    return mix((parts * BAND).sum(axis=2, dtype=np.uint64)).view(np.int64)


SIGNED = "doc_id long, rid binary, key binary, n_shingles long, " + ", ".join(f"s{i} long" for i in range(LONGS)) + ", bands array<long>"
SIGNATURE = ["n_shingles", *[f"s{i}" for i in range(LONGS)]]


def row_digest() -> Column:
    """128 bits of doc_id and text. Rows that agree in both share it."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary")))


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 2):
            keys, sizes, rows = [], [], []
            for text in texts_of(part.column(2)):
                words = sequence(text)
                s = shingles(words)
                keys.append(key_of(words))
                sizes.append(len(s))
                rows.append(minima(s))
            m = np.stack(rows)
            packed, bands = pack(m), band_keys(m)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(m) + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *[pa.array(np.ascontiguousarray(packed[:, i])) for i in range(LONGS)], lists], ["doc_id", "rid", "key", *SIGNATURE, "bands"])


def differing(a: str, b: str) -> Column:
    """How many of the packed low-bit groups differ."""
    total = F.lit(0)
    ones = F.lit(0x1111111111111111).cast("long")
    for i in range(LONGS):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(ones)
        total = total + F.bit_count(x)
    return total


def hopeful(a: str, b: str, percent: int, slack: float = 0.2) -> Column:
    """Whether sizes allow the similarity and the estimate, corrected for chance collisions of BITS bits, is near enough."""
    chance = 1 / (1 << BITS)
    most = int(HASHES * (1 - chance) * (1 - (percent / 100 - slack)))
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (small * 100 >= large * percent) & (differing(a, b) <= most)


def estimated(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are hopeful by their packed bits, and how many groups of bits keep them apart."""
    both = pairs.join(sig.alias("x"), F.col("a") == F.col("x.key")).join(sig.alias("y"), F.col("b") == F.col("y.key"))
    return both.where(hopeful("x", "y", percent)).select("a", "b", differing("x", "y").alias("apart"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, scratch: Scratch, name: str, parts: int = 64) -> DataFrame:
    """The pairs (a, b) of class keys whose full shingle sets have 100 * intersection >= percent * union.

    A class b of many pairs is dealt over `parts` parts by a, and its text goes once to each part that has pairs.
    """
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(parts)).alias("part"))
    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    right = pairs.select("b", "part").distinct().join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(right, ["b", "part"]).select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(key: bytes, text: bytes) -> np.ndarray:
            if key not in recent:
                recent[key] = shingles(sequence(text))
                if len(recent) > 64:
                    recent.popitem(last=False)
            recent.move_to_end(key)
            return recent[key]

        for batch in batches:
            kept = []
            for a, b, x, y in zip(*(batch.column(i).cast(pa.binary()).to_pylist() for i in range(4))):
                x, y = of(a, x), of(b, y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    return scratch.table(both.mapInArrow(check, "a binary, b binary"), name)


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 2):
            sets = [shingles(sequence(t)).view(np.int64) for t in texts_of(part.column(2))]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
            yield pa.record_batch([part.column(0), part.column(1), lists], ["key", "label", "shingles"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        total += np.bincount(slot(batch.column(0).flatten().to_numpy()), minlength=SLOTS)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used), pa.array(total[used])], ["slot", "c"])


def slot(shingles: np.ndarray) -> np.ndarray:
    return shingles & (SLOTS - 1)


def prefix_pairs(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of rows of sets (key, label, shingles) of other labels, among them all that are similar enough.

    Two sets of sizes n and m are similar enough only with an overlap of percent * (n + m) / (100 + percent), so that of the
    shingles in one order the first that they share stands before so many others in both. The order is by the count in a
    table of SLOTS counters, then by hash: any one order is right, and frequent shingles stand out in a table of any fixed
    size. A shingle alone in its counter is in one set only and is not sent. Sizes are dealt into steps of 10 %: each set
    waits in its own step for sets as large or larger, which look into all steps down to the least size allowed.
    """
    step = 1.1
    counts = sets.select("shingles").mapInArrow(counted, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[counts["slot"].to_numpy()] = counts["c"].to_numpy()
    often = sets.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, values, rest = [], [], []
            for k, shingle in enumerate(batch.column(2)):
                s = shingle.values.to_numpy()
                c = often.value[slot(s)]
                order = np.lexsort((s, c))
                left = len(s) - np.arange(len(s))
                take = (100 * left >= percent * len(s)) & (c[order] > 1)
                values.append(s[order][take])
                rest.append(left[take])
                at.append(np.full(len(rest[-1]), k))
            rows = batch.select([0, 1, 3]).take(pa.array(np.concatenate(at)))
            yield pa.record_batch([*rows.columns, pa.array(np.concatenate(values)), pa.array(np.concatenate(rest))], ["key", "label", "n", "s", "rest"])

    order = sets.withColumn("n", F.size("shingles").cast("long")).mapInArrow(prefixes, "key binary, label binary, n long, s long, rest long")
    order = scratch.table(order, "prefixes")
    often.destroy()
    place = lambda n: F.floor(F.log(n) / F.log(F.lit(step)) + 1e-9).cast("int")
    wait = order.where(F.col("rest") * (100 + percent) >= F.col("n") * 2 * percent)
    wait = wait.select("s", place(F.col("n")).alias("g"), *[F.col(c).alias(f"{c}2") for c in ("key", "label", "n", "rest")])
    least, most = F.col("n") * percent / 100, F.least("n", F.floor(F.col("rest") * (100 + percent) / percent + 0.001) - F.col("n"))
    look = order.withColumn("g", F.explode(F.sequence(F.least(place(most), place(F.greatest(F.lit(1.0), least)) - 1), place(most))))
    need = F.least("rest", "rest2") * (100 + percent) >= percent * (F.col("n") + F.col("n2"))
    met = look.join(wait, ["s", "g"]).where((F.col("label") != F.col("label2")) & (F.col("n2") <= F.col("n")) & need)
    return met.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()


def grouped(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, rid, n_shingles, label) of each row of docs: rows of one component, and no others, share a label."""
    signed = scratch.table(docs.select("doc_id", row_digest().alias("rid"), "text").mapInArrow(sign, SIGNED), "signed")
    classes = signed.where("n_shingles > 0").groupBy("key").agg(F.first(F.struct("rid", *SIGNATURE, "bands")).alias("x")).select("key", "x.*")
    classes = scratch.table(classes, "classes")

    rows = classes.select("key", F.explode(F.array_distinct("bands")).alias("band"))
    sizes = rows.groupBy(F.col("band").alias("in_band")).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.table(rows.join(sizes, F.col("band") == F.col("in_band")).select("band", "key", "size"), "members")
    weight = members.groupBy(F.col("key").alias("m")).agg(F.sum("size").alias("weight"))
    weighted = members.join(weight, F.col("key") == F.col("m"))
    central = weighted.groupBy(F.col("band").alias("in_band")).agg(F.max(F.struct("weight", "key"))["key"].alias("pivot"))
    stars = members.join(central, F.col("band") == F.col("in_band")).where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    sig = classes.select("key", *SIGNATURE)
    nearest = estimated(stars, sig, percent).groupBy("a").agg(F.min(F.struct("apart", "b"))["b"].alias("b"))
    nearest = scratch.table(nearest, "nearest")

    wanted = members.select("key").distinct().join(classes.select(F.col("key").alias("k"), F.col("rid").alias("r")), F.col("key") == F.col("k")).select("key", "r")
    texts = docs.select(row_digest().alias("rid"), "text").join(wanted, F.col("rid") == F.col("r")).select("key", "text").dropDuplicates(["key"])
    texts = scratch.table(texts, "texts")
    links = confirmed(nearest, texts, percent, scratch, "links")
    labels = scratch.table(components(links, scratch, "c"), "labels")

    of = members.join(labels, F.col("key") == F.col("node"), "left").select("band", "key", F.coalesce("label", "key").alias("label"))
    mixed = of.groupBy(F.col("band").alias("in_band")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("in_band")
    crowd = of.join(mixed, F.col("band") == F.col("in_band"), "left_semi").select(F.col("key").alias("k"), "label").distinct()
    sets = texts.join(crowd, F.col("key") == F.col("k")).select("key", "label", "text").mapInArrow(listed, "key binary, label binary, shingles array<long>")
    pairs = estimated(prefix_pairs(scratch.table(sets, "sets"), percent, scratch), sig, percent)
    more = confirmed(scratch.table(pairs, "pairs"), texts, percent, scratch, "more")
    scratch.drop("members", "sets", "prefixes", "pairs", "texts", "classes")

    # The first links joined whole components: their labels stand for them.
    joins = more.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    joins = components(joins.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), scratch, "d").select(F.col("node").alias("was"), F.col("label").alias("now"))
    out = signed.join(labels, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "key"))
    out = out.join(joins, F.col("label") == F.col("was"), "left")
    return scratch.table(out.select("doc_id", "rid", "n_shingles", F.coalesce("now", "label").alias("label")), "grouped")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    rows = grouped(docs, percent, Scratch(docs.sparkSession, "neardup"))
    one = rows.where("n_shingles > 0").groupBy(F.col("label").alias("l")).agg(F.min("doc_id").alias("least"), F.min("rid").alias("first"))
    rows = rows.join(one, (F.col("label") == F.col("l")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("least", "doc_id")
    kept = F.when(component.isNull(), F.coalesce(F.col("rid") == F.col("first"), F.lit(True))).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False)))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of docs of each component, all columns: of its rows of least doc_id (null: last) that of the least digest.
    Rows without words are no duplicates of each other, but of rows that agree in doc_id and text one stays."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = grouped(docs, percent, scratch)
    own = F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("rid"))
    kept = rows.groupBy(own).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("x"))
    kept = scratch.table(kept.select(F.col("x.rid").alias("_kept_row")), "kept")
    names = docs.columns
    whole = docs.select(row_digest().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_all"))
    whole = whole.join(kept, F.col("_row") == F.col("_kept_row"), "left_semi").dropDuplicates(["_row"])
    return whole.select(*[F.col(f"_all.`{c}`").alias(c) for c in names])
