"""BM25, vector search and their fusion, for many queries in one plan. Rankings have a total order: score, then id."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B, RRF_K = 1.5, 0.75, 60
BLOCK = 4096


def postings(docs: DataFrame, doc: str, words: Column) -> DataFrame:
    """(doc, term, tf)."""
    return docs.select(F.col(doc).alias("doc"), F.explode(words).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(post: DataFrame) -> DataFrame:
    return post.groupBy("doc").agg(F.sum("tf").alias("dl"))


def idf(post: DataFrame, n: Column) -> DataFrame:
    """(term, df, idf): ln(1 + (n - df + 1/2) / (df + 1/2))."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def spread(rows: DataFrame) -> DataFrame:
    """A scan of few row groups dealt over all cores, for work that costs much more than reading; a scan of at least as many
    splits as cores, which any large table is, stays as it is, so that no large table is shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def bm25(docs: DataFrame, doc: str, words: Column, queries: DataFrame) -> DataFrame:
    """(query, doc, score > 0) of queries (query, words): every occurrence of a query's token counts.

    Texts are tokenized once. A document is one row, so that its length is the size of its token array; tokens that no query
    asks for leave by a semi join before anything is grouped. An empty token, asked for by all, is put before each
    document's tokens and carries its length, so that the counts of documents and words come from the same shuffled
    postings as the hits and the document frequencies (one exchange, used three times). Null and empty tokens count as none.
    """
    real = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: t != "")
    held = docs.select(F.col(doc).alias("doc"), real(words).alias("words"))
    asked = queries.select("query", F.explode(real(F.col("words"))).alias("term")).where("term is not null").groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = asked.select(F.col("term").alias("wanted")).union(queries.sparkSession.range(1).select(F.lit("").alias("wanted"))).distinct()
    each = held.select("doc", F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))
    post = each.where("term is not null").join(wanted, F.col("term") == F.col("wanted"), "left_semi").groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    mark = F.col("term") == ""
    stats = post.agg(F.coalesce(F.sum(F.when(mark, F.col("tf"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(mark, F.col("dl") * F.col("tf"))), F.lit(0)).alias("total"))
    stats = stats.select("n", F.greatest(F.col("total") / F.col("n"), F.lit(1.0)).alias("avgdl"))
    df = post.groupBy("term").agg(F.sum((F.col("tf") > 0).cast("long")).alias("df"))  # reads tf, else the exchange would be another
    hits = asked.join(df, "term").join(F.broadcast(stats)).join(post, "term")
    return hits.groupBy("query", "doc").agg(F.sum(bm25_part()).alias("score")).where("score > 0")


def bm25_part() -> Column:
    """What one term adds, from qtf, n, df, tf, dl and avgdl."""
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.col("qtf") * weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def bm25_within(candidates: DataFrame, words: Column, asked: Column) -> DataFrame:
    """(query, doc, score > 0) of candidates: statistics over each query's own candidates only, so that idf differs by query.

    words and asked are arrays of the tokens of the candidate and of its query."""
    w = Window.partitionBy("query")
    rows = candidates.select("query", "doc", words.alias("words"), asked.alias("asked")).withColumn("dl", F.size("words"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("avgdl", F.greatest(F.avg("dl").over(w), F.lit(1.0)))
    tf = lambda t: F.size(F.filter("words", lambda x: x == t))
    qtf = lambda t: F.size(F.filter("asked", lambda x: x == t))
    terms = F.transform(F.array_distinct("asked"), lambda t: F.struct(t.alias("term"), tf(t).alias("tf"), qtf(t).alias("qtf")))
    hits = rows.select("query", "doc", "dl", "n", "avgdl", F.explode(terms).alias("t")).select("query", "doc", "dl", "n", "avgdl", "t.*").where("tf > 0")
    hits = hits.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("query", "term")))
    return hits.groupBy("query", "doc").agg(F.sum(bm25_part()).alias("score")).where("score > 0")


def hybrid_within(candidates: DataFrame, words: Column, asked: Column, weight: Column, distance: str = "distance") -> DataFrame:
    """Candidates (query, doc, distance, ...) with bm25_score, vector_score and hybrid_score: keyword scores are joined to the
    vector hits, which all stay; of the keyword scores the least and the missing ones become 0."""
    scored = bm25_within(candidates, words, asked)
    scored = scored.select(F.col("query").alias("_q"), F.col("doc").alias("_d"), min_max(scored, "score").alias("bm25_score"))
    both = candidates.join(scored, (F.col("query") == F.col("_q")) & (F.col("doc") == F.col("_d")), "left").drop("_q", "_d").fillna(0.0, ["bm25_score"])
    both = both.withColumn("vector_score", 1 / (1 + F.coalesce(F.nullif(F.col(distance), F.lit(0.0)), F.lit(2.0))))
    return both.withColumn("hybrid_score", F.col("bm25_score") * weight + F.col("vector_score") * (1 - weight))


#: Scale of the keyword boost by intent.
BOOST_SCALE = {"semantic": 0.45, "keyword": 1.55}


def base_search(hits: DataFrame, words: Column, code: Column, file: Column, repo: Column, intent: Column, k: int = 10) -> DataFrame:
    """The k best of vector hits (query, doc, distance, ...) by distance less keyword boost, with rank."""
    scale = F.when(intent == "semantic", BOOST_SCALE["semantic"]).when(intent == "keyword", BOOST_SCALE["keyword"]).otherwise(1.0)
    boosted = hits.withColumn("keyword_boost", keyword_boost(words, code, file, repo, scale))
    return top(boosted.withColumn("hybrid_score", F.col("distance") - F.col("keyword_boost")), k, score="hybrid_score", ascending=True)


def gates(intent: Column, n_results: Column) -> dict[str, Column]:
    """Which steps a search takes: in-result hybrid, graph expansion, reranking."""
    return {"hybrid": intent != "semantic", "graph": intent == "dependency", "rerank": n_results <= 20}


def similarity_percent(distance: Column) -> Column:
    return F.round((1 - distance) * 100, 1)


def top(scored: DataFrame, k: int, by: str = "query", score: str = "score", key: str = "doc", ascending: bool = False) -> DataFrame:
    """The k best rows of each query, with their rank from 1."""
    order = F.round(score, 9)
    w = Window.partitionBy(by).orderBy(order.asc() if ascending else order.desc(), key)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def in_blocks(queries: DataFrame, key: str, block: int = BLOCK) -> list[DataFrame]:
    """Parts of the queries that have about `block` rows each, whatever their number: what may be broadcast."""
    n = queries.count()
    parts = max(1, -(-n // block))
    return [queries] if parts == 1 else [queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def similar_pairs(vectors: DataFrame, key: str, vector: str, least: float, block: int = 2048) -> DataFrame:
    """(a, b, cos) of all pairs a < b with cos >= least: every pair of blocks is one matrix product of bounded size."""
    n = vectors.count()
    parts = max(1, -(-n // block))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("p"))
    pairs = rows.select("id", "v", "p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("q"))
    pairs = pairs.select("id", "v", (F.col("p") <= F.col("q")).alias("left"), (F.col("p") >= F.col("q")).alias("right"), F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"))

    def product(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        v = np.array(table.column("v").to_pylist(), float).reshape(len(ids), -1)
        a, b = (np.flatnonzero(table.column(c).to_numpy()) for c in ("left", "right"))
        cos = v[a] @ v[b].T
        same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        i, j = np.nonzero((cos >= least) & ((ids[a][:, None] < ids[b]) if same else True))
        x, y = ids[a[i]], ids[b[j]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "cos": cos[i, j]})

    return pairs.groupBy("lo", "hi").applyInArrow(product, "a long, b long, cos double")


def min_max(scored: DataFrame, score: str, by: str = "query") -> Column:
    """Score to 0..1 within its query; equal scores all become 0."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return (F.col(score) - low) / F.coalesce(F.nullif(high - low, F.lit(0.0)), F.lit(1.0))


def weighted(keyword: DataFrame, semantic: DataFrame, weight: Column) -> DataFrame:
    """Full outer join of keyword (query, doc, score) and semantic (query, doc, distance) hits, fused by weight."""
    k = keyword.select("query", "doc", min_max(keyword, "score").alias("bm25_score"))
    s = semantic.select("query", "doc", (1 / (1 + F.coalesce("distance", F.lit(2.0)))).alias("vector_score"))
    both = k.join(s, ["query", "doc"], "full").fillna(0.0, ["bm25_score", "vector_score"])
    return both.withColumn("hybrid_score", weight * F.col("bm25_score") + (1 - weight) * F.col("vector_score"))


def rrf(*ranked: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of ranked hits (query, doc, rank from 1)."""
    parts = [r.select("query", "doc", (1.0 / (RRF_K + F.col("rank"))).alias("part")) for r in ranked]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("query", "doc").agg(F.sum("part").alias("score"))


def lexical_rerank(words: Column, code: Column, file: Column, repo: Column) -> Column:
    """Per distinct query word of 3 letters or more: 1 in the code, 2 in the path, 3 in the repository; over the number of words."""
    w = F.array_distinct(F.filter(words, lambda x: F.length(x) >= 3))
    has = lambda c, x: F.contains(F.lower(c), x).cast("int")
    total = F.aggregate(w, F.lit(0), lambda s, x: s + has(code, x) + 2 * has(file, x) + 3 * has(repo, x))
    return total / F.greatest(F.size(w), F.lit(1))


def keyword_boost(words: Column, code: Column, file: Column, repo: Column, scale: Column) -> Column:
    """Over the distinct keywords of 3 letters or more: 1 if the repository's name (- and _ as spaces) has it, plus 0.4 if the
    path has it, plus 0.2 if the code has it; times scale."""
    w = F.array_distinct(F.filter(words, lambda x: F.length(x) >= 3))
    name = F.translate(F.lower(repo), "-_", "  ")
    has = lambda c, x, v: F.when(F.contains(c, x), F.lit(v)).otherwise(F.lit(0.0))
    return scale * F.aggregate(w, F.lit(0.0), lambda s, x: s + has(name, x, 1.0) + has(F.lower(file), x, 0.4) + has(F.lower(code), x, 0.2))


def within_budget(ranked: DataFrame, size: Column, budget: int, by: str = "query") -> DataFrame:
    """The blocks in order of rank up to the first that would exceed the budget."""
    w = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def progressive(ranked: DataFrame, relevance: str, few: int = 3, weak: float = 0.28, by: str = "query") -> DataFrame:
    """The first few hits of queries whose best hit is relevant enough, all hits of the others."""
    return ranked.withColumn("best", F.max(relevance).over(Window.partitionBy(by))).where((F.col("rank") <= few) | (F.col("best") < weak)).drop("best")


def rerank(hits: DataFrame, score: Callable[[Column, Column], Column] | None, k: int, asked: str = "asked", code: str = "code", cut: int = 2000) -> DataFrame:
    """The k best of hits (query, doc, distance, asked, code) by a plugged-in score of (query text, first `cut` characters of
    the code), such as a Pandas UDF over a cross encoder. Without one the order of distances stays, and the score is the distance."""
    if score is None:
        return top(hits.withColumn("rerank_score", F.col("distance")), k, score="rerank_score", ascending=True)
    return top(hits.withColumn("rerank_score", score(F.col(asked), F.substring(F.col(code), 1, cut))), k, score="rerank_score")
