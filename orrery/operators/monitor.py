"""Telemetry: latency percentiles, satisfaction, drift, costs, caches and limits over logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Prices per 1000 tokens, in the order in which a model's name is looked up by substring.
PRICES = [("gpt-4o-mini", 0.00015, 0.0006), ("gpt-4o", 0.0025, 0.01), ("claude-3-5-sonnet", 0.003, 0.015), ("gemini-2.0-flash", 0.0001, 0.0004), ("codellama", 0.0, 0.0), ("ollama", 0.0, 0.0)]
SATISFACTION = {"thumbs_up": 1.0, "click": 0.7, "skip": 0.3, "thumbs_down": 0.0}


def latest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def nearest_rank(rows: DataFrame, by: str, value: str, ps: dict[str, float]) -> DataFrame:
    """Percentiles as the element floor(n * p), from 0, of the sorted values; mean, least, greatest and count. Values are counted
    before they are ranked, so that a group's repeated values travel as one row each; null values are left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(by)
    counts = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    at = lambda p: F.min(F.when(F.col("_upto") > F.least(F.floor(F.col("_n") * p), F.col("_n") - 1), F.col(value)))
    return counts.groupBy(by).agg(*[at(p).alias(name) for name, p in ps.items()], (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum("_c").alias("n"))


def satisfaction(rows: DataFrame, action: str) -> DataFrame:
    score = F.create_map(*[x for k, v in SATISFACTION.items() for x in (F.lit(k), F.lit(v))])
    value = F.try_element_at(score, F.col(action))
    return rows.agg(F.round(F.avg(value), 4).alias("satisfaction"), F.count(value).alias("n"))


def price(model: Column, side: int) -> Column:
    out = F.lit(0.0)
    for name, *both in reversed(PRICES):
        out = F.when(F.contains(F.lower(model), F.lit(name)), both[side]).otherwise(out)
    return out


def costs(calls: DataFrame) -> DataFrame:
    """(model, calls, tokens, cost) of calls (model, tokens_in, tokens_out), with a total row (model null)."""
    cost = F.col("tokens_in") / 1000 * price(F.col("model"), 0) + F.col("tokens_out") / 1000 * price(F.col("model"), 1)
    return calls.withColumn("cost", cost).rollup("model").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.sum("cost").alias("cost"))


def drift(rows: DataFrame, by: str, order: list[str], score: str, first: int = 50, last: int = 50, limit: float = 0.15) -> DataFrame:
    """Mean of the first scores against mean of the last ones, per group. Ranks are cut in each partition before the shuffle."""
    head = latest(rows.select(by, score, *order), [by], [F.col(c) for c in order], first).groupBy(by).agg(F.avg(score).alias("baseline"))
    tail = latest(rows.select(by, score, *order), [by], [F.col(c).desc() for c in order], last).groupBy(F.col(by).alias("_by")).agg(F.avg(score).alias("recent"))
    r = head.join(tail, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    change = F.abs(F.col("recent") - F.col("baseline")) / F.col("baseline")
    return r.withColumn("change", change).withColumn("drifted", change > limit)


def admitted(rows: DataFrame, by: str, ts: str, key: str, limit: int = 10, seconds: int = 60) -> DataFrame:
    """Exact sliding limiter: a request passes if fewer than `limit` passed in the `seconds` before it; rejected ones don't count.

    A caller's requests come sorted to one task, batch by batch; the task keeps the last `limit` times of the caller at hand."""
    r = rows.select(by, key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    kinds = dict(r.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, times = None, deque()
        for b in batches:
            passed = []
            for caller, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if caller != who:
                    who, times = caller, deque()
                while times and times[0] <= t - seconds * 1_000_000:
                    times.popleft()
                passed.append(len(times) < limit)
                if passed[-1]:
                    times.append(t)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(passed, pa.bool_())], [by, key, "admitted"])

    ordered = r.where("t is not null").repartition(by).sortWithinPartitions(by, "t", key)
    return ordered.mapInArrow(fold, f"{by} {kinds[by]}, {key} {kinds[key]}, admitted boolean")


def survivors(entries: DataFrame, now: Column, size: int) -> DataFrame:
    """Cache entries (key, last_access, expires_at) that neither expired nor were evicted: the `size` last used."""
    return entries.where(F.col("expires_at") > now).orderBy(F.col("last_access").desc(), "key").limit(size)


# Seconds that a namespace of the search cache keeps an entry.
TTL = {"embedding": 86_400, "query": 3_600, "hyde": 7_200, "rerank": 3_600, "search": 1_800}
TTL_DEFAULT = 3_600


def cache_lookups(lookups: DataFrame, namespace: str, key: str, ts: str, order: str, ttl: Column) -> DataFrame:
    """Lookups with `hit`: the entry's last store is less than ttl seconds old. A miss stores the entry; a hit doesn't renew it.

    Folds each key's lookups in order, holding only the time of the last store."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = lookups.withColumn("_t", t).withColumn("_ttl", ttl.cast("long") * 1_000_000)
    log = rows.groupBy(namespace, key).agg(F.array_sort(F.collect_list(F.struct("_t", F.col(order).alias("id"), "_ttl"))).alias("log"))
    start = F.struct(F.lit(None).cast("long").alias("stored"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("misses"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.coalesce(x["_t"] - acc["stored"] < x["_ttl"], F.lit(False))
        return F.struct(F.when(hit, acc["stored"]).otherwise(x["_t"]).alias("stored"), (acc["hits"] + hit.cast("long")).alias("hits"), (acc["misses"] + (~hit).cast("long")).alias("misses"))

    return log.select(namespace, key, F.aggregate("log", start, step).alias("x")).select(namespace, key, "x.hits", "x.misses")


def cache_stats(counted: DataFrame, namespace: str) -> DataFrame:
    """hits, misses and hit rate (0 without lookups) of each namespace."""
    r = counted.groupBy(namespace).agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    return r.withColumn("hit_rate", F.round(F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 4))


# Prices of a million tokens, in and out, by provider and model, and each provider's price of other models.
MILLION = {
    "openai": {"gpt-4o": (2.5, 10.0), "gpt-4o-mini": (0.15, 0.6), "gpt-4-turbo": (10.0, 30.0), "gpt-4": (30.0, 60.0), "gpt-3.5-turbo": (0.5, 1.5)},
    "anthropic": {"claude-sonnet-4-20250514": (3.0, 15.0), "claude-3-5-sonnet-20241022": (3.0, 15.0), "claude-3-opus-20240229": (15.0, 75.0), "claude-3-haiku-20240307": (0.25, 1.25)},
    "gemini": {"gemini-2.0-flash": (0.1, 0.4), "gemini-1.5-pro": (1.25, 5.0), "gemini-1.5-flash": (0.075, 0.3), "gemini-pro": (0.5, 1.5)},
}
MILLION_OTHER = {"openai": (0.15, 0.6), "anthropic": (3.0, 15.0), "gemini": (0.1, 0.4)}


def million_price(provider: str, model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    cost = lambda p: tokens_in / 1e6 * p[0] + tokens_out / 1e6 * p[1]
    out = cost(MILLION_OTHER[provider])
    for name, p in MILLION[provider].items():
        out = F.when(model == name, cost(p)).otherwise(out)
    return out


def extremes(rows: DataFrame, value: str, key: str, n: int = 3) -> DataFrame:
    """The n greatest and the n least rows, with side and rank; ties by key."""
    take = lambda side, order: rows.orderBy(order, key).limit(n).withColumn("side", F.lit(side))
    both = take("largest", F.col(value).desc()).unionByName(take("smallest", F.col(value)))
    order = F.when(F.col("side") == "largest", -F.col(value)).otherwise(F.col(value))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(order, key)).cast("long"))
