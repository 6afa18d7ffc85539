"""Retrieval and answer evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import QUESTION_STOP_WORDS


def at_k(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Precision, recall and NDCG at each k and the reciprocal rank, per query of ranked (query, doc, rank) and relevant (query, doc).
    A query without relevant rows has zeros."""
    total = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("n_relevant"))
    hit = ranked.join(relevant.withColumn("hit", F.lit(1)), ["query", "doc"], "left").fillna(0, ["hit"])
    aggs = [F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr")]
    for k in ks:
        aggs += [F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"hits{k}"), F.sum(F.when(F.col("rank") <= k, F.col("hit") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg{k}")]
    rows = hit.groupBy("query").agg(*aggs).join(total, "query", "left").fillna(0, ["n_relevant"])
    out = [F.col("query"), F.col("rr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int")))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        some = lambda x: F.when(F.col("n_relevant") > 0, x).otherwise(0.0)
        out += [(F.col(f"hits{k}") / k).alias(f"p{k}"), some(F.col(f"hits{k}") / F.col("n_relevant")).alias(f"r{k}"), some(F.col(f"dcg{k}") / ideal).alias(f"ndcg{k}")]
    return rows.select(*out)


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of two sets of words."""
    common = F.size(F.array_intersect(a, b))
    p, r = common / F.greatest(F.size(a), F.lit(1)), common / F.greatest(F.size(b), F.lit(1))
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def faithfulness(answer: Column, context: Column) -> Column:
    """Share of the answer's words that the context has."""
    return F.size(F.array_intersect(answer, context)) / F.greatest(F.size(answer), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def relevance(answer: Column, question: Column) -> Column:
    """Jaccard similarity of two sets of words without the stop words of questions; 0 where a side is empty."""
    plain = lambda c: F.filter(c, lambda w: ~w.isin(QUESTION_STOP_WORDS))
    return F.when((F.size(plain(answer)) > 0) & (F.size(plain(question)) > 0), jaccard(plain(answer), plain(question))).otherwise(0.0)


def rating(score: Column) -> Column:
    return F.when(score >= 0.8, "Excellent").when(score >= 0.7, "Good").when(score >= 0.6, "Fair").otherwise("Needs Improvement")


#: Tokens of a question and of the system's instructions.
QUESTION_TOKENS, SYSTEM_TOKENS = 50, 100


def cost_per_query(n_docs: Column, doc_tokens: Column, answer_tokens: Column, in_per_1k: Column, out_per_1k: Column) -> dict[str, Column]:
    tokens_in = n_docs * doc_tokens + QUESTION_TOKENS + SYSTEM_TOKENS
    return {"input_tokens": tokens_in, "total_tokens": tokens_in + answer_tokens, "total_cost": tokens_in / 1000 * in_per_1k + answer_tokens / 1000 * out_per_1k}


# Lanczos' coefficients of the logarithm of the gamma function for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
STEPS, TINY = 3000, 1e-300


def log_gamma(x: Column) -> Column:
    """For x > 0."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        series = series + F.lit(c) / (x + i)
    return F.lit(0.9189385332046727) + (x - 0.5) * F.log(x + 6.5) - (x + 6.5) + F.log(series)


def beta_part(x: Column, a: Column, b: Column) -> Column:
    """Continued fraction of the incomplete beta function, from the front; steps past its limit change nothing."""
    away = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def add(s: Column, q: Column) -> Column:
        d, c = 1 / away(1 + q * s["d"]), away(1 + q / s["c"])
        return state(c, d, s["h"] * c * d)

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.get(F.transform(F.array(add(s, even)), lambda t: add(t, odd)), F.lit(0))

    first = 1 / away(1 - (a + b) * x / (a + 1))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double")), state(F.lit(1.0), first, first), step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised, for 0 <= x <= 1."""
    front = lambda x, a, b: F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)) * beta_part(x, a, b) / a
    inner = F.when(x < (a + 1) / (a + b + 2), front(x, a, b)).otherwise(1 - front(1 - x, b, a))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inner)


def p_value(t: Column, df: Column) -> Column:
    """Of both sides of Student's distribution."""
    return incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))


def significance(rows: DataFrame, arm: str, value: str, cost: str) -> DataFrame:
    """Arms a and b: n, mean, 95th percentile and mean cost of each; t, degrees of freedom and p with equal and unequal (Welch's)
    variances. An arm of fewer than two values, or two arms without variance, has no t and no p."""
    g = rows.groupBy(arm).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.percentile(value, F.lit(0.95)).alias("p95"), F.avg(cost).alias("cost"))
    one = lambda x, c: F.max(F.when(F.col(arm) == x, F.col(c)))
    r = g.agg(*[one(x, c).alias(f"{c}_{x}") for x in "ab" for c in ("n", "mean", "var", "p95", "cost")])
    na, nb, va, vb = (F.col(c) for c in ("n_a", "n_b", "var_a", "var_b"))
    apart, share_a, share_b = F.col("mean_b") - F.col("mean_a"), va / na, vb / nb
    known = lambda c: F.nullif(c, F.lit(0.0))
    pooled = ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)
    r = r.withColumns({"t": apart / F.sqrt(known(pooled * (1 / na + 1 / nb))), "df": (na + nb - 2).cast("double"), "welch_t": apart / F.sqrt(known(share_a + share_b)), "welch_df": (share_a + share_b) ** 2 / known(share_a**2 / (na - 1) + share_b**2 / (nb - 1))})
    return r.withColumns({"p": p_value(F.col("t"), F.col("df")), "welch_p": p_value(F.col("welch_t"), F.col("welch_df"))}).drop("var_a", "var_b")


def compare(rows: DataFrame, arm: str, value: str) -> DataFrame:
    """Arms a and b: means, change in per cent and the t statistic with equal variance."""
    g = rows.groupBy(arm).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    one = lambda x, c: F.max(F.when(F.col(arm) == x, F.col(c)))
    r = g.agg(*[one(x, c).alias(f"{c}_{x}") for x in "ab" for c in ("n", "mean", "var")])
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2)
    t = (F.col("mean_b") - F.col("mean_a")) / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
    return r.select("n_a", "n_b", "mean_a", "mean_b", (100 * (F.col("mean_b") - F.col("mean_a")) / F.col("mean_a")).alias("change_percent"), t.alias("t"))
