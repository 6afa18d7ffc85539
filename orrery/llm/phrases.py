"""Phrase collocations: frequent runs of 2 to 4 words of each language, scored by how seldom their parts go without each other.

Contiguous pattern growth in the manner of PrefixSpan. An occurrence of a prefix is a pointer to a row of the words that follow
it; a task projects the pointers of a prefix onto the words after it, keeps those that are frequent, and grows each to the right,
depth first. Frequent prefixes of two words are dealt out, each to one task; a prefix of more rows than a task should hold is dealt
by its third word, and only its own count is then summed over tasks.

What can't be part of a frequent phrase leaves before the shuffle (as in hash-based pruning of pairs): the table is read four
times, in blocks whose words are cut and hashed as arrays. First words (and how many there are), then pairs of words that may be
frequent, then triples of such pairs, are counted in arrays of hash slots:
one byte a slot that stops at 255, so an array has a fixed size (at most 2^26 bytes, and a 2^23 byte bitmap of slots that reach the
least count is broadcast), whatever the corpus. A slot's count is at least that of each of its phrases, so none is lost; a full
array prunes less, which costs time only. The last reading emits rows (a phrase of up to four words, times), equal ones of a block
as one; equal hashes of different words only fill slots, the rows are compared word by word.

Hard rows: a null text has no words, a null language is `und`, and so are counted with it; equal rows count each time; doc_id
isn't read, nor are other columns; an empty table, or one without frequent phrases, gives an empty one. A very long text is one
block of its task, with about 100 bytes of arrays a word; a long run without punctuation is one piece as any other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, mix, offsets, pieces, small_batches, texts_of

#: Fixed values of the contract: phrase lengths, least count, score's factor, share of a longer phrase that hides a shorter one.
LONGEST, LEAST, FACTOR, HIDES = 4, 30, 2_000_000, 80
#: Least and most hash slots, as powers of two; slots that travel as one row.
SLOT_BITS, ROW_BITS = (16, 26), 18
#: Rows of one task's prefixes, and of one prefix that is dealt by its third word.
TASK_ROWS, HOT_ROWS = 50_000, 10_000

_map = bytearray(range(256))
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _map[_c] = 10
_map[9] = 32
for _c in range(65, 91):
    _map[_c] = _c + 32
#: Letters A-Z lower, ends of pieces as line feeds, tabs as spaces.
PLAIN = bytes(_map)
#: Words longer than this are hashed one by one. Masks of the first bytes of eight.
LONG_WORD = 64
HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def blocks(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches (lang, text) put together, or cut, to about limit bytes of text (a longer text stays whole)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for piece in pieces(batch, 1, limit):
            more = int(np.ptp(offsets(piece.column(1))))
            if held and size + more > limit:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(piece)
            size += more
    if held:
        yield pa.concat_batches(held)


class Words:
    """The words of a block (lang, text) in a row: their places in its bytes, codes of their languages, hashes of language
    and word, and whether the next word is of the same piece."""

    def __init__(self, block: pa.RecordBatch) -> None:
        lang = block.column(0).dictionary_encode()
        texts = [x or b"" for x in texts_of(block.column(1))]
        self.data = np.frombuffer(b"\n".join([b"", *texts, b""]).translate(PLAIN), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.between = (self.data == 32) | (self.data == 10)
        edges = np.flatnonzero(self.between[1:] != self.between[:-1]) + 1  # begins and ends of words take turns
        self.starts, self.sizes = np.ascontiguousarray(edges[::2]), edges[1::2] - edges[::2]
        self.goes_on = np.ones(len(self.starts), bool)
        if len(self.starts):
            self.goes_on[np.searchsorted(self.starts, np.flatnonzero(self.data == 10)) - 1] = False  # -1: the last word, which ends a piece too
        self.langs = lang.dictionary
        self.lang = np.repeat(lang.indices.to_numpy(), np.diff(np.searchsorted(self.starts, ends), prepend=0))
        of_lang = np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs.to_pylist()], np.uint64)
        self.hashes = mix(self._hashes() + of_lang[self.lang])

    def __len__(self) -> int:
        return len(self.starts)

    def _hashes(self) -> np.ndarray:
        """Hashes of the words' bytes, eight at a time; those of long words one by one."""
        padded = np.append(self.data, np.zeros(8, np.uint8))
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        out = self.sizes.astype(np.uint64)
        left = np.arange(len(self))
        for at in range(0, LONG_WORD, 8):
            chunk = eight[self.starts[left] + at] & HEADS[np.minimum(self.sizes[left] - at, 8)]
            out[left] = mix(out[left]) + chunk
            left = left[self.sizes[left] > at + 8]
            if not len(left):
                break
        for i in left.tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.starts[i] + self.sizes[i]])
        return out

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the words among the different ones, and these."""
        ends = np.zeros(len(self) + 1, np.int32)
        np.cumsum(self.sizes, out=ends[1:])
        found = pa.Array.from_buffers(pa.string(), len(self), [None, pa.py_buffer(ends), pa.py_buffer(self.data[~self.between])]).dictionary_encode()
        return found.indices.to_numpy(), found.dictionary

    def may_begin(self, maps: list[Bitmap]) -> tuple[list[np.ndarray], np.ndarray]:
        """For each length up to one more than there are maps: does a phrase begin at a place whose shorter parts may all be
        frequent, and which may be itself as far as there is a map of its length. Also the hashes of the longest ones."""
        out, hashes = [np.ones(len(self), bool)], self.hashes.copy()
        for length, only in enumerate(maps, 1):
            here = out[-1]
            at = np.flatnonzero(here)
            hashes = mix(hashes)
            here[at] = only[slots(hashes[at], only.bits)]
            out.append(here & self.goes_on & np.append(here[1:], False))
            hashes[:-length] += self.hashes[length:]
        return out, hashes


def slots(mixed: np.ndarray, bits: int) -> np.ndarray:
    return (mixed >> np.uint64(64 - bits)).astype(np.uint32)


class Bitmap:
    """Slots that reach the least count."""

    def __init__(self, bits: int, rows: dict[int, bytes]) -> None:
        width = 1 << min(bits, ROW_BITS)
        held = np.zeros(1 << bits, np.uint8)
        for row, data in rows.items():
            held[row * width : (row + 1) * width] = np.unpackbits(np.frombuffer(data, np.uint8), count=width)
        self.bits, self.packed = bits, np.packbits(held, bitorder="little")

    def __getitem__(self, slots: np.ndarray) -> np.ndarray:
        return (self.packed[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


COUNTED = "row int, at binary, times binary, lang string, n long"


def slot_rows(counts: np.ndarray, words: dict[str, int]) -> pa.RecordBatch:
    """COUNTED: the slots of each row that were met (gaps between them, low bytes first) and how often, both as bytes; then
    the words of each language."""
    width = min(len(counts), 1 << ROW_BITS)
    rows, at, times = [], [], []
    for row in range(len(counts) // width):
        met = np.flatnonzero(part := counts[row * width : (row + 1) * width])
        if len(met):
            gaps = np.diff(met, prepend=0).astype("<u4")
            rows.append(row), at.append(gaps.view(np.uint8).reshape(-1, 4).T.tobytes()), times.append(part[met].tobytes())
    none = [None] * len(words)
    columns = (rows + none, at + none, times + none, [None] * len(rows) + list(words), [None] * len(rows) + list(words.values()))
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["row", "at", "times", "lang", "n"])


def met_slots(at: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(at, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel())


def add(counts: np.ndarray, slots: np.ndarray) -> None:
    met, times = np.unique(slots, return_counts=True)
    counts[met] = np.minimum(counts[met] + times, 255)


def count_slots(docs: DataFrame, bits: int, maps: list[Bitmap]) -> DataFrame:
    """(row, bits, lang, n): bitmap's rows of the slots that have the least count or more, of phrases one word longer than there
    are maps of shorter ones; where there are none, also the number of words of each language that has any."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, held = np.zeros(1 << bits, np.uint8), Counter(), shared.value
        for block in blocks(batches):
            words = Words(block)
            may, hashes = words.may_begin(held)
            add(counts, slots(mix(hashes[may[-1]]), bits))
            if not held:
                n.update({x: k for x, k in zip(words.langs.to_pylist(), np.bincount(words.lang, minlength=len(words.langs)).tolist(), strict=True) if k})
        yield slot_rows(counts, n)

    width = 1 << min(bits, ROW_BITS)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        n: Counter[str] = Counter()
        for batch in batches:
            for row, at, times, lang, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row is None:
                    n[lang] += words
                else:
                    counts = held.setdefault(row, np.zeros(width, np.uint8))
                    met = met_slots(at)
                    counts[met] = np.minimum(counts[met].astype(np.int32) + np.frombuffer(times, np.uint8), 255)
        packed = [np.packbits(c >= LEAST).tobytes() for c in held.values()]
        none = [None] * len(n)
        columns = ([*held, *none], [*packed, *none], [None] * len(held) + list(n), [None] * len(held) + list(n.values()))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.string(), pa.int64()), strict=True)], ["row", "bits", "lang", "n"])

    # Rows of slots add up one by one as they come: no task holds more than its own sums.
    return docs.mapInArrow(count, COUNTED).repartition("row", "lang").mapInArrow(total, "row int, bits binary, lang string, n long")


def bitmap(bits: int, counted: DataFrame) -> Bitmap:
    return Bitmap(bits, {r["row"]: r["bits"] for r in counted.where("row is not null").select("row", "bits").collect()})  # 2^bits bits at most


def windows(docs: DataFrame, maps: list[Bitmap]) -> DataFrame:
    """(lang, phrase, n): single words that may be frequent, and from each place where a pair may be frequent the longest
    phrase of up to four words that may be. Equal ones are one row."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for block in blocks(batches):
            words = Words(block)
            may, _ = words.may_begin(held)
            number, names = words.numbered()
            at = np.flatnonzero(may[1])
            columns = [words.lang[at], number[at], *(np.where(may[k][at], number[np.minimum(at + k, len(words) - 1)], -1) for k in range(1, LONGEST))]
            alone = np.flatnonzero(may[0])
            for places in (columns, [words.lang[alone], number[alone]]):
                keys = [f"k{i}" for i in range(len(places))]
                each = pa.table(places, keys).group_by(keys, use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                if each.num_rows:
                    lang, *parts = (each.column(k).chunk(0) for k in keys)
                    parts = [names.take(pc.if_else(pc.less(x, 0), None, x)) for x in parts]
                    phrase = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
                    yield pa.record_batch([words.langs.take(lang), phrase, each.column("count_all").chunk(0)], ["lang", "phrase", "n"])

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def grow(rows: DataFrame) -> DataFrame:
    """(lang, phrase, k, a) of windows (lang, phrase, n) of two or more words, partial counts for prefixes dealt by their third word."""
    spark = rows.sparkSession
    total = rows.count()
    rows = rows.withColumn("head", F.substring_index("phrase", " ", 2))
    sizes = rows.groupBy("lang", "head").agg(F.count(F.lit(1)).alias("rows"))
    hot = sizes.where(F.col("rows") > max(HOT_ROWS, total // 5_000)).select("lang", "head", F.lit(True).alias("hot"))  # 5,000 prefixes at most
    tasks = max(spark.sparkContext.defaultParallelism, total // TASK_ROWS + 1)
    dealt = rows.join(F.broadcast(hot), ["lang", "head"], "left").fillna(False, ["hot"])
    third = F.when(F.col("hot"), F.substring_index("phrase", " ", 3)).otherwise("")
    dealt = dealt.select("lang", "phrase", "n", "hot", F.pmod(F.xxhash64("lang", "head", third), F.lit(tasks)).cast("int").alias("task"))

    def run(table: pa.Table) -> pa.Table:
        coded = table.column("lang").combine_chunks().dictionary_encode()
        columns = [(coded.indices.to_numpy(), coded.dictionary.to_pylist())]
        parts = pc.split_pattern(table.column("phrase").combine_chunks(), " ")
        starts, coded = parts.offsets.to_numpy(), parts.values.dictionary_encode()
        codes, names = np.append(coded.indices.to_numpy(), np.int32(-1)), coded.dictionary.to_pylist()
        for k in range(LONGEST):
            at = starts[:-1] + k
            columns.append((codes[np.where(at < starts[1:], at, -1)], names))
        times, hot = table.column("n").to_numpy(), table.column("hot").to_numpy()
        out: list[tuple] = []

        def project(pointers: np.ndarray, depth: int, prefix: tuple[str, ...]) -> None:
            """Grows a prefix, whose occurrences the pointers are, by the words in column `depth`."""
            codes = columns[depth][0][pointers]
            order = np.argsort(codes, kind="stable")
            pointers, codes = pointers[order], codes[order]
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            counts = np.add.reduceat(times[pointers], starts)
            for start, stop, code, n in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], codes[starts].tolist(), counts.tolist(), strict=True):
                if code < 0:
                    continue
                longer = (*prefix, columns[depth][1][code])
                part = depth == 2 and bool(hot[pointers[start]])
                if depth >= 2 and (n >= LEAST or part):
                    out.append((longer[0], " ".join(longer[1:]), depth, n))
                if depth < LONGEST and (depth < 2 or n >= LEAST or part):  # other tasks have occurrences of a language and a first word, too
                    project(pointers[start:stop], depth + 1, longer)

        if table.num_rows:
            project(np.arange(table.num_rows), 0, ())
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)], ["lang", "phrase", "k", "a"])

    return dealt.groupBy("task").applyInArrow(run, "lang string, phrase string, k int, a long")


def collocations(docs: DataFrame, most: int = 2000, lang: Column | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `most` best phrases."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "phrases")
    lang = F.coalesce(F.col("lang") if lang is None else lang, F.lit("und"))
    docs = docs.select(lang.alias("lang"), "text")
    # The first reading also counts words, so it can't know how many slots they need; rows of slots not met aren't sent.
    bits = SLOT_BITS[1]
    counted = scratch.table(count_slots(docs, bits, []), "words")
    maps = [bitmap(bits, counted)]
    n = counted.where("lang is not null").select("lang", "n")
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(SLOT_BITS[1], max(SLOT_BITS[0], int(total // 2).bit_length()))
    while len(maps) < LONGEST - 1:
        maps.append(bitmap(bits, count_slots(docs, bits, maps)))
    rows = scratch.table(windows(docs, maps), "windows")
    single = ~F.col("phrase").contains(" ")
    alone = rows.where(single & (F.col("n") >= LEAST)).select("lang", "phrase", F.lit(1).alias("k"), F.col("n").alias("a"))
    grown = grow(rows.where(~single)).groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).where(F.col("a") >= LEAST)
    counts = scratch.table(alone.union(grown), "counts")
    scored = score(counts)
    better = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # A window's limit cuts each partition before the shuffle; the languages' best of 32 parts come before those of all.
    part = F.pmod(F.xxhash64("phrase"), F.lit(32))
    for keys in (["lang", "part"], ["lang"]):
        scored = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*better)).cast("long")).where(F.col("rank") <= most)
    return scored.join(F.broadcast(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def score(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the counted phrases of two or more words that no longer one hides."""
    words = F.split("phrase", " ")
    phrases = counts.where("k >= 2").withColumn("words", words)
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = phrases.select("lang", "phrase", "k", "a", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(1, F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    of = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    wide = "decimal(28,0)"
    cuts = cuts.withColumn("score", F.expr(f"cast({FACTOR} as decimal(10,0)) * cast(a as {wide}) div (cast(l as {wide}) + cast(r as {wide}))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    # parts of two or more words of each longer phrase, by their first word and length
    spans = [(start, size) for size in range(2, LONGEST) for start in range(1, LONGEST - size + 2)]
    inside = F.filter(F.array(*[F.when(F.col("k") >= F.greatest(F.lit(start + size - 1), F.lit(size + 1)), part(start, size)) for start, size in spans]), lambda x: x.isNotNull())
    hidden = phrases.where("k >= 3").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(hidden, ["lang", "phrase"], "left")
    return kept.where(f"longer is null or cast(100 as decimal(5,0)) * cast(longer as {wide}) < cast({HIDES} as decimal(5,0)) * cast(a as {wide})").drop("longer")
