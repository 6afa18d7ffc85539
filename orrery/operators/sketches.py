"""Mergeable sketches: quantiles (KLL) and distinct counts (HyperLogLog) by span of time, merged over any spans.

A row of a sketch table is a few kB whatever it has seen, so a span's sketches can be stored, merged again and again, and kept
by a stream. RANK_ERROR is what a quantile's rank may be off with k = 400 (99 of 100 times), USERS_ERROR what a distinct count
may be off, as a share, with 2^14 registers (three standard errors).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, REGISTERS = 400, 14
RANK_ERROR, USERS_ERROR = 0.01, 0.025


def by_span(rows: DataFrame, ts: str, keys: list[str], value: str, who: str, width: str = "1 hour") -> DataFrame:
    """(span, keys, n, quantiles, users): a sketch of each span and key, of a table or of a stream with a watermark."""
    w = F.window(F.col(ts).cast("timestamp"), width)
    made = rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.expr(f"kll_sketch_agg_double(cast({value} as double), {K})").alias("quantiles"), F.hll_sketch_agg(who, REGISTERS).alias("users"))
    return made.select(F.col("w.start").alias("span"), *keys, "n", "quantiles", "users")


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, quantiles, users) over all spans given; the result can be merged again."""
    return spans.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr("kll_merge_agg_double(quantiles)").alias("quantiles"), F.hll_union_agg("users").alias("users"))


def read(sketch: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The keys and n, `distinct`, and a column for each named quantile."""
    keys = [c for c in sketch.columns if c not in ("quantiles", "users")]
    return sketch.select(*keys, F.hll_sketch_estimate("users").alias("distinct"), *[F.expr(f"kll_sketch_get_quantile_double(quantiles, {q}D)").alias(name) for name, q in quantiles.items()])
