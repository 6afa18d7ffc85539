"""What stands around a search: query expansion, prompts, answer caches, chunk gates, service mapping, incidents, tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.guards import strip

# What the advice for an error is, by what was found in its trace.
ADVICE = {
    "panic": ["Add nil checks before dereferencing pointers", "Add recover() in goroutines to prevent crashes"],
    "timeout": ["Increase timeout or add context.WithTimeout", "Check network connectivity and service health"],
    "refused": ["Verify the target service is running", "Check connection pool settings and retry logic"],
    "redis": ["Check Redis connection pool and TTL settings"],
    "none": ["Check the error handling in the identified functions", "Add structured logging around the error path"],
}


def expand(queries: DataFrame, synonyms: DataFrame, most: int = 5) -> DataFrame:
    """(id, expanded) of queries (id, q): up to `most` synonyms (word, place, synonym) after the query.

    Synonyms come by their place in a word's list, then by the word's place in the query; a word of the query and one that
    came before are left out. synonyms is a dictionary, so small; rows are per query word, never per pair of queries.
    """
    words = queries.select("id", "q", F.posexplode_outer(F.filter(F.split(F.lower("q"), r"\s+"), lambda w: w != "")).alias("at", "w"))
    own = F.filter(F.split(F.lower("q"), r"\s+"), lambda w: w != "")
    hits = words.join(synonyms, F.col("w") == F.col("word")).where(~F.array_contains(own, F.col("synonym")))
    firsts = hits.groupBy("id", "synonym").agg(F.min(F.struct("place", "at")).alias("p"))
    lists = firsts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p", "synonym"))).alias("found")).withColumnRenamed("id", "found_id")
    more = F.transform(F.slice(F.coalesce("found", F.array().cast("array<struct<p:struct<place:int,at:int>,synonym:string>>")), 1, most), lambda x: x["synonym"])
    out = queries.join(lists, F.col("id").eqNullSafe(F.col("found_id")), "left")
    return out.select("id", F.array_join(F.concat(F.array("q"), more), " ").alias("expanded"))


def within_chunks(chunks: DataFrame, by: str, most: int) -> DataFrame:
    """(by, n_chunks, too_large) of each group of chunks."""
    n = F.count(F.lit(1))
    return chunks.groupBy(by).agg(n.alias("n_chunks"), (n > most).alias("too_large"))


def with_overrides(tasks: DataFrame, repos: DataFrame, bases: DataFrame) -> DataFrame:
    """(task_id, repo, branch): a task's own source branch, else one that its base folder forces, else its repository's, else master."""
    given = tasks.join(repos.select(F.col("repo").alias("r"), "base", F.col("source_branch").alias("of_repo")), F.col("repo") == F.col("r"), "left")
    given = given.join(bases.select(F.col("base").alias("b"), F.col("forced").alias("of_base")), F.col("base") == F.col("b"), "left")
    first = lambda c: F.nullif(F.col(c), F.lit(""))
    return given.select("task_id", "repo", F.coalesce(first("source_branch"), first("of_base"), first("of_repo"), F.lit("master")).alias("branch"))


def cache_key(question: Column, *parameters: Column) -> Column:
    """Key of an answer: the question's normal form and the parameters; a different parameter is a different key."""
    return F.sha2(F.concat_ws("\x1f", T.normal_question(question), *[F.coalesce(p.cast("string"), F.lit("")) for p in parameters]).cast("binary"), 256)


def cached(asked: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """(id, answer, hit): each question (id, key) with the newest live answer of the cache (key, answer, stored_at, expires_at)."""
    live = cache.where(F.col("expires_at") > now).groupBy(F.col("key").alias("k")).agg(F.max(F.struct("stored_at", "answer"))["answer"].alias("answer"))
    return asked.join(live, F.col("key") == F.col("k"), "left").select("id", "answer", F.col("answer").isNotNull().alias("hit"))


def near_cached(asked: DataFrame, cache: DataFrame, least: float = 0.92, where: Column | None = None) -> DataFrame:
    """(id, entry, sim): the cached question with the same parameters that is most like each one asked, if like enough.

    Both have (parameters, vector), unit vectors; ties go to the smaller entry. Only questions of equal parameters meet, and of
    those only pairs (id, entry) for which `where` holds.
    """
    sim = F.aggregate(F.zip_with("vector", "v", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    both = asked.join(cache.select(F.col("parameters").alias("p"), "entry", F.col("vector").alias("v")), (F.col("parameters") == F.col("p")) & (F.lit(True) if where is None else where)).withColumn("sim", sim)
    best = both.where(F.round("sim", 9) >= least).groupBy("id").agg(F.max(F.struct(F.round("sim", 9).alias("s"), (-F.col("entry")).alias("e"), "sim")).alias("m"))
    return best.select("id", (-F.col("m.e")).alias("entry"), F.col("m.sim").alias("sim"))


def prompts(questions: DataFrame, history: DataFrame, context: DataFrame, turns: int = 3) -> DataFrame:
    """(id, prompt): the last turns of the history (id, turn, q, a), the context blocks (id, rank, block) in order, the question (id, question)."""
    last = Window.partitionBy("id").orderBy(F.col("turn").desc())
    said = history.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= turns)
    said = said.groupBy(F.col("id").alias("h")).agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("Q: "), "q", F.lit("\nA: "), "a").alias("s")))).alias("said"))
    blocks = context.groupBy(F.col("id").alias("c")).agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("blocks"))
    out = questions.join(said, F.col("id") == F.col("h"), "left").join(blocks, F.col("id") == F.col("c"), "left")
    text = lambda column, field: F.nullif(F.array_join(F.transform(column, lambda x: x[field]), "\n\n"), F.lit(""))
    return out.select("id", F.concat_ws("\n\n", text("said", "s"), text("blocks", "block"), F.concat(F.lit("Question: "), "question")).alias("prompt"))


def incidents(traces: DataFrame) -> DataFrame:
    """(id, error_type, error_message, functions, files, suggestions) of traces (id, trace); functions and files in order, each once.

    A line that starts with panic: or error: names the error, the last such line; else the first with a general mark does.
    """
    lines = F.transform(F.split("trace", "\n"), strip)
    own = F.filter(lines, lambda x: x.rlike("^(panic|error):"))
    general = r"(Error|ERROR|Exception|FATAL):"
    marked = F.get(F.filter(lines, lambda x: x.rlike(general)), F.lit(0))
    last = F.try_element_at(own, F.lit(-1))
    kind = F.coalesce(F.regexp_extract(last, r"^(\w+):", 1), F.regexp_extract(marked, general, 1), F.lit(""))
    said = F.coalesce(F.trim(F.regexp_extract(last, r"^\w+:(.*)$", 1)), F.substring(F.trim(F.regexp_extract(marked, general + "(.*)$", 2)), 1, 200), F.lit(""))
    functions = F.array_distinct(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"(\w+)\.(\w+)\(", 2)), lambda x: x != ""))
    go, py = lambda x: F.regexp_extract(x, r"(\S+\.go):\d+", 1), lambda x: F.regexp_extract(x, r'File "([^"]+)", line \d+', 1)
    files = F.array_distinct(F.filter(F.flatten(F.transform(lines, lambda x: F.array(go(x), py(x)))), lambda x: x != ""))
    rows = traces.select("id", kind.alias("error_type"), said.alias("error_message"), functions.alias("functions"), files.alias("files"))
    advice = lambda key, when: F.when(when, F.array(*map(F.lit, ADVICE[key]))).otherwise(F.array().cast("array<string>"))
    low = F.lower("error_message")
    found = F.concat(
        advice("panic", F.col("error_type") == "panic"), advice("timeout", F.contains(low, F.lit("timeout"))),
        advice("refused", F.contains(low, F.lit("connection refused"))), advice("redis", F.exists("files", lambda f: F.contains(F.lower(f), F.lit("redis")))),
    )
    return rows.withColumn("suggestions", F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, ADVICE["none"]))))


def replace_word(text: Column, old: str, new: str) -> Column:
    """Every whole-word occurrence of old becomes new; neither is read as a pattern."""
    return F.regexp_replace(text, F.lit(r"\b\Q" + old + r"\E\b"), F.lit(new.replace("\\", r"\\").replace("$", r"\$")))


def stages(queries: DataFrame) -> DataFrame:
    """(query_id, seq, stage): what a query goes through, of queries (query_id, cache_hit, hyde, hits, hybrid, graph)."""
    on = lambda c, name: F.when(F.col(c), F.lit(name))
    found = F.array_compact(F.array(F.lit("start"), on("hyde", "hyde"), F.lit("vector"), on("hybrid", "hybrid"), F.lit("reranked"), on("graph", "graph"), F.lit("complete")))
    none = F.array_compact(F.array(F.lit("start"), on("hyde", "hyde"), F.lit("vector"), F.lit("complete")))
    path = F.when(F.col("cache_hit"), F.array(*map(F.lit, ("start", "cache_hit", "complete")))).when(F.col("hits") == 0, none).otherwise(found)
    return queries.select("query_id", F.posexplode(path).alias("seq", "stage"))
