"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models of random strings.

Patterns (base spans) are leftmost and non-overlapping per kind; positions are code points, the end exclusive, of the
whole match. To them the models add: candidate tokens of 20 characters or more, mixed from letters and digits, are scored
by the log-likelihood ratio of two first-order character models, one of random strings and one of ordinary identifiers
and words, trained from labelled samples (label 1 and 0). A token outside the base spans whose ratio per character
reaches `threshold` becomes a span of kind `markov`.

The models are one table of log ratios over pairs of ALPHABET characters, so its size is fixed; samples are split into
pairs, counted and smoothed by Spark. Samples are generated by rule (SAMPLES rows a label) unless given.

Edge cases: a null text counts as empty and has no spans; equal texts have equal spans; repeated rows stay repeated; an
empty table gives no rows; further columns are ignored whatever their names. A very long text is one row of a task; work on it
grows with its length: matches are cut off once, positions come from running sums by blocks, spans meet in one sorted pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

# The base patterns and the least length of what must match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: A run of one character class: only runs of the least length are looked at, which are the same maximal runs.
ACCESS_RUN = r"AKIA[A-Z0-9]{14,}"
HEX_RUN = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLES = 400
# Parts of ordinary identifiers.
PARTS = """account action address agent amount array batch block buffer build cache call change check class client code column
config connection content context count current data database default delete detail device document element error event
field file filter format frame function group handler header history image index input instance interval item key label
language length level library limit line list local location manager message method model module name network number object
offset operation option order output package page parameter parent pattern payment point position price process product
profile project property provider query queue range record reference region report request resource response result
return schema score script search section select server service session setting size source stage start state status
storage stream string structure summary system table target task template test text thread time token total transfer type
update user value vector version view window worker""".split()


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(label, text): n random strings in hexadecimal, base64 and base36 look, and n identifiers in four styles."""
    ids = spark.range(n)
    h = lambda i: F.sha2(F.concat(F.lit(f"sample {i} "), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(F.concat(h(1), h(2))))
    upper = F.upper(F.regexp_replace(F.base64(F.unhex(h(3))), "[^A-Za-z0-9]", ""))
    random = ids.select(F.lit(1).alias("label"), F.explode(F.array(F.substring(h(0), 1, 40), b64, upper)).alias("text"))
    word = lambda i: F.element_at(F.array(*map(F.lit, PARTS)), (F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(len(PARTS))) + 1).cast("int"))
    words = F.array(*[word(i) for i in range(4)])
    number = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(100)).cast("string")
    styles = F.array(
        F.array_join(words, "_"), F.array_join(words, "-"), F.array_join(F.transform(words, F.initcap), ""), F.concat(F.upper(F.array_join(words, "_")), F.lit("_"), number), F.concat_ws("/", words), F.array_join(words, "")
    )
    return random.union(ids.select(F.lit(0), F.explode(styles)))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios, random against ordinary, of each pair of ALPHABET characters, row by row."""
    size = len(ALPHABET)
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    pairs = labelled.where("text is not null and label is not null").select("label", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1)))).alias("i"))
    pairs = pairs.select("label", F.expr("substring(text, i, 1)").alias("x"), F.expr("substring(text, i + 1, 1)").alias("y"))
    pairs = pairs.select("label", place(F.col("x")).alias("a"), place(F.col("y")).alias("b")).where("a >= 0 and b >= 0")
    count = {(r["label"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    table = np.zeros((2, size, size))
    for (label, a, b), n in count.items():
        if label in (0, 1):
            table[label, a, b] = n
    prior = (table.sum(axis=1) + 0.5) / (table.sum(axis=(1, 2))[:, None] + 0.5 * size)
    logp = np.log((table + 5 * prior[:, None, :]) / (table.sum(axis=2)[:, :, None] + 5))
    return np.round(logp[1] - logp[0], 6).ravel().tolist()


#: Values of a running sum that are copied as one array grows; characters of a piece of text that a cut reads from its start.
BLOCK, PIECE = 64, 256
SPAN = "struct<start:int,rank:int,stop:int,text:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once, however often a function of a higher order asks for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """What plus makes of the first 0, 1, ... n of n numbers, from 0: an array of n + 1.

    An array grows by being copied, so this is done for blocks, blocks of their totals, and those' totals: linear up to
    BLOCK ** 3 numbers, and beyond that but for a share of 1 in BLOCK ** 4."""
    none = F.array().cast("array<array<int>>")
    grown = lambda v: F.aggregate(v, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(plus(F.element_at(acc, -1), x))))
    block = lambda v: lambda i: grown(F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))
    blocks = lambda values: let(values, lambda v: F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), block(v))).otherwise(none))
    totals = lambda bs: F.transform(bs, lambda b: F.element_at(b, -1))

    def whole(one: Column, two: Column, three: Column) -> Column:
        outer = lambda i: F.floor(i / BLOCK).cast("int")
        start = lambda i: plus(F.get(three, outer(i)), F.get(F.get(two, outer(i)), F.pmod(i, F.lit(BLOCK))))
        each = F.transform(one, lambda b, i: let(start(i), lambda s: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: plus(s, x))))
        return F.concat(F.flatten(each), F.array(F.element_at(three, -1)))

    return let(blocks(values), lambda one: let(blocks(totals(one)), lambda two: let(grown(totals(two)), lambda three: whole(one, two, three))))


def add(a: Column, b: Column) -> Column:
    return a + b


def found(text: Column, pattern: str, kind: str, group_from: int = 0, keep_text: bool = False) -> Column:
    """Array of (start, rank, stop, text) of the matches of a pattern, from the pieces between them: no match is looked for twice."""
    rank = KINDS.index(kind)
    keep = (lambda m: F.length(F.regexp_extract(m, f"^{ASSIGN}$", 2)) >= LEAST["assign"]) if group_from else (lambda m: F.lit(True))

    def spans(matches: Column) -> Column:
        # lengths of gap, match, gap, match ...: every second running sum is where a match starts or stops
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        lengths = F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.array(g, F.length(m))))
        each = lambda at: F.transform(matches, lambda m, i: F.struct(F.get(at, 2 * i + 1).alias("start"), F.lit(rank).alias("rank"), F.get(at, 2 * i + 2).alias("stop"), m.alias("text")))
        return F.filter(let(before(lengths, add), each), lambda x: keep(x["text"]))

    all_spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)
    if not keep_text:
        all_spans = F.transform(all_spans, lambda x: F.struct(x["start"], x["rank"], x["stop"], F.lit(None).cast("string").alias("text")))
    return F.when(text.rlike(pattern), all_spans).otherwise(F.array()).cast(f"array<{SPAN}>")


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: all in order of a span's stop and another's start, each with the furthest stop
    of the others before it."""
    event = lambda at, kind, x: F.struct(at.alias("at"), F.lit(kind).alias("kind"), x.alias("span"))
    events = F.array_sort(F.concat(F.transform(spans, lambda x: event(x["stop"], 0, x)), F.transform(others, lambda x: event(x["start"], 1, x))))

    def free(events: Column) -> Column:
        stops = F.transform(events, lambda e: F.when(e["kind"] == 1, e["span"]["stop"]).otherwise(F.lit(0)))
        paired = let(before(stops, F.greatest), lambda most: F.transform(events, lambda e, i: F.struct(e.alias("e"), F.get(most, i).alias("most"))))
        return F.transform(F.filter(paired, lambda p: (p["e"]["kind"] == 0) & (p["most"] <= p["e"]["span"]["start"])), lambda p: p["e"]["span"])

    return let(events, free)


def cutter(text: Column, use: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """use(cut), where cut(start, stop) is that part of the text; a cut reads pieces of the text, never the text from its start."""

    def of(pieces: Column) -> Column:
        def cut(start: Column, stop: Column) -> Column:
            first, last = (F.floor(x / PIECE).cast("int") for x in (start, stop))
            piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
            one = F.substring(piece(first), F.pmod(start, F.lit(PIECE)) + 1, stop - start)
            more = F.concat(F.substring(piece(first), F.pmod(start, F.lit(PIECE)) + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.substring(piece(last), F.lit(1), F.pmod(stop, F.lit(PIECE))))
            return F.when(first == last, one).otherwise(more)

        return use(cut)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), of)


def ratio(token: Column, table: Column) -> Column:
    """Mean log ratio over the pairs of a token."""
    size = len(ALPHABET)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when((acc["last"] >= 0) & (c >= 0), F.element_at(table, (acc["last"] * size + c + 1).cast("int"))).otherwise(F.lit(0.0))).alias("sum"))
    return F.aggregate(codes, start, step, lambda acc: acc["sum"]) / F.greatest(F.length(token) - 1, F.lit(1))


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text, base and spans, arrays of (start, rank, stop, null) in order."""
    spark = docs.sparkSession
    table = train(samples(spark) if labelled is None else labelled)
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", found(F.col("text"), ASSIGN, "assign", 2).alias("assign"), found(F.col("text"), ACCESS_RUN, "access").alias("access"), found(F.col("text"), HEX_RUN, "hex").alias("hex"), found(F.col("text"), CANDIDATE, "markov", keep_text=True).alias("tokens"))
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    table = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # one constant, not one expression a pair

    is_secret = lambda t: t["text"].rlike("[0-9]") & t["text"].rlike("[A-Za-z]") & (ratio(t["text"], table) >= threshold)
    extra = F.when(F.size("tokens") > 0, F.filter(apart(F.col("tokens"), F.col("base")), is_secret)).otherwise(F.col("tokens"))
    bare = F.transform(extra, lambda x: F.struct(x["start"], x["rank"], x["stop"], F.lit(None).cast("string").alias("text"))).cast(f"array<{SPAN}>")
    return rows.select("doc_id", "text", "assign", "access", "hex", "base", bare.alias("markov")).withColumn("spans", F.array_sort(F.concat("base", "markov")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kinds, s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))), ",")


def secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    found = scan(docs, labelled, threshold)
    n = lambda c: F.size(c).cast("long")
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), n("markov").alias("n_markov"))


def redact(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.8, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs, all columns, with each run of overlapping spans of the text replaced by a mark; a null text stays null."""
    names = docs.columns
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc_id"), F.col("text"))
    rows = scan(nested, labelled, threshold)

    def joined(cut: Callable[[Column, Column], Column]) -> Column:
        def gaps(most: Column) -> Column:
            paired = F.transform("spans", lambda x, i: F.struct(F.get(most, i).alias("from"), x["start"].alias("to")))
            between = F.transform(F.filter(paired, lambda p: p["to"] >= p["from"]), lambda p: cut(p["from"], p["to"]))
            return F.array_join(F.concat(between, F.array(cut(F.element_at(most, -1), F.length("text")))), mark)

        return let(before(F.transform("spans", lambda x: x["stop"]), F.greatest), gaps)

    whole = cutter(F.col("text"), joined)
    clean = F.when(F.size("spans") > 0, whole).otherwise(F.col("doc_id.text"))
    return rows.select(*[clean.alias(c) if c == "text" else F.col(f"doc_id.`{c}`").alias(c) for c in names])

