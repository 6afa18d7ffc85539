"""Catalog and index maintenance: counts, diffs by content hash, merge, delete, graph hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_diff(old: DataFrame, new: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Each key with status new, changed, same or deleted."""
    o, n = old.select(*keys, F.col(digest).alias("_o")), new.select(*keys, F.col(digest).alias("_n"))
    status = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(F.col("_o") == F.col("_n"), "same").otherwise("changed")
    return o.join(n, keys, "full").select(*keys, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key is not in new, and all of new."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def split_evenly(rows: DataFrame, order: str, n: int) -> Column:
    """Contiguous parts of floor(rows / n); the last takes the remainder."""
    each = F.greatest(F.floor(F.count(F.lit(1)).over(Window.partitionBy()) / n), F.lit(1))
    return F.least(F.floor((F.row_number().over(Window.orderBy(order)) - 1) / each), F.lit(n - 1))


def neighbours(edges: DataFrame, relation: str | None = None) -> DataFrame:
    """(node, neighbour), undirected, each once."""
    e = edges if relation is None else edges.where(F.col("relation") == relation)
    return e.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(e.select("dst", "src")).distinct()


def hops(seeds: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(seed, node, hop): nodes reached along edges within n hops, at their least hop, the seed not among them."""
    seen = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).cast("long").alias("hop"))
    front = seen
    for i in range(1, n + 1):
        front = front.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.lit(i).cast("long").alias("hop")).distinct()
        front = front.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", "hop")
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def precedence(values: dict[str, int], column: str) -> Column:
    """Of a group's values the one of least place, in an aggregate; others count last, by name."""
    place = F.lit(len(values))
    for v, k in values.items():
        place = F.when(F.col(column) == v, k).otherwise(place)
    return F.min(F.struct(place.alias("place"), F.col(column).alias("value")))["value"]


def newest_threads(messages: DataFrame, thread: str, ts: str, key: str, threads: int = 24, each: int = 80) -> DataFrame:
    """The last `each` messages of the `threads` threads that were used last; ties by thread and key."""
    used = messages.groupBy(thread).agg(F.max(ts).alias("_last")).orderBy(F.col("_last").desc(), thread).limit(threads)
    kept = messages.join(F.broadcast(used.select(F.col(thread).alias("_t"))), F.col(thread) == F.col("_t"), "left_semi")
    w = Window.partitionBy(thread).orderBy(F.col(ts).desc(), F.col(key).desc())
    return kept.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= each).drop("_rn")


def parents(children: DataFrame, rows: DataFrame, child: str, parent: str, rank: str, by: str) -> DataFrame:
    """Parents of ranked children, each once per `by`, at the place of its first child."""
    found = children.join(rows.select(child, parent), child)
    return found.groupBy(by, parent).agg(F.min(rank).alias(rank), F.count(F.lit(1)).alias("children"))
