"""Dictionary matching: which of any number of names a text holds, by an equi-join on grams of characters.

A name is filed under one of its grams, the one that fewest names have. A text's grams meet the filed ones, and what meets is
looked for in the text itself. So neither names nor texts are sent everywhere, and each name found is really there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of grams: a name's are of the greatest that it has room for.
SIZES = (16, 8, 4, 2, 1)


def grams(text: Column, size: int) -> Column:
    """All runs of `size` characters of a text, each once, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def filed(needles: DataFrame) -> DataFrame:
    """(size, gram, needle): each needle under its rarest gram."""
    size = reduce(lambda rest, s: F.when(F.length("needle") >= s, F.lit(s)).otherwise(rest), reversed(SIZES), F.lit(0))
    rows = needles.where("needle <> ''").select("needle").distinct().withColumn("size", size)
    each = rows.withColumn("gram", F.explode(reduce(lambda rest, s: F.when(F.col("size") == s, grams(F.col("needle"), s)).otherwise(rest), SIZES, F.array().cast("array<string>"))))
    often = each.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("often"))
    return each.join(often, ["size", "gram"]).groupBy("needle").agg(F.min(F.struct("often", "gram", "size")).alias("x")).select("x.size", "x.gram", "needle")


def contained(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(id, needle) of texts (id, text) and needles (needle): each needle that a text of the id contains, once. Empty ones are in nothing."""
    index = filed(needles)
    sizes = [r[0] for r in index.select("size").distinct().collect()]  # five at most
    if not sizes:
        return texts.select("id", F.lit(None).cast("string").alias("needle")).limit(0)
    sized = lambda s: F.transform(grams(F.col("text"), s), lambda g: F.struct(F.lit(s).alias("size"), g.alias("gram")))
    every = F.flatten(F.array(*map(sized, sizes)))
    rows = texts.where("text is not null")
    each = rows.select("id", F.explode(every).alias("g")).select("id", "g.size", "g.gram")
    may = each.join(index, ["size", "gram"]).select("id", "needle").distinct()  # few: only these meet their texts again
    return may.join(rows, "id").where(F.contains("text", F.col("needle"))).select("id", "needle").distinct()


def mentioned(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) of texts (id, text), each id once: the name (of `names`, column name) that a text mentions, or null. It is the longest
    that the text contains, as written or with - for _ and blanks (of equally long ones the first by name), else the first run of 4
    to 1 words, joined by -, that is a name."""
    hyphened = lambda c: F.translate(F.lower(c), "_ ", "--")
    table = names.where("name is not null").select("name", F.lower("name").alias("low"), hyphened("name").alias("norm")).distinct()
    lower = F.lower(F.trim("text"))
    forms = {"low": texts.select("id", lower.alias("text")), "norm": texts.select("id", hyphened(lower).alias("text"))}
    hits = [contained(rows, table.select(F.col(form).alias("needle"))).join(table.select(F.col(form).alias("needle"), "name"), "needle").select("id", "name") for form, rows in forms.items()]
    best = hits[0].union(hits[1]).groupBy("id").agg(F.min(F.struct((-F.length("name")).alias("l"), "name"))["name"].alias("held"))
    words = F.filter(F.split(F.translate(lower, "-_", "  "), r"\s+"), lambda w: w != "")
    starts = lambda n: F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>"))
    of = lambda n: F.transform(starts(n), lambda i: F.array_join(F.slice("words", i, F.lit(n)), "-"))
    runs = F.flatten(F.array(*map(of, (4, 3, 2, 1))))
    each = texts.select("id", words.alias("words")).select("id", F.posexplode(runs).alias("place", "norm"))
    by_run = each.join(table, "norm").groupBy("id").agg(F.min(F.struct("place", (-F.length("name")).alias("l"), "name"))["name"].alias("run"))
    return texts.select("id").join(best, "id", "left").join(by_run, "id", "left").select("id", F.coalesce("held", "run").alias("name"))


def map_services(services: DataFrame, repos: DataFrame) -> DataFrame:
    """(service_name, repo): the first repository (by place) whose path or name is in the working directory, else whose name is
    in the service's name or holds it. repos: (place, name, local_path). A service that none fits is left out."""
    s = services.select("service_name", F.coalesce("working_directory", F.lit("")).alias("there")).distinct()
    text = lambda df, key, c: df.select(F.col(key).alias("id"), c.alias("text"))
    needle = lambda df, c: df.select(c.alias("needle"))
    place = repos.select("place", "name", F.lower("name").alias("low"), "local_path")
    inside = lambda c: contained(text(s, "there", F.col("there")).distinct(), needle(repos, F.col(c))).join(place, F.col("needle") == F.col(c)).join(s, F.col("id") == F.col("there")).select("service_name", F.lit(0).alias("late"), "place", "name")
    holds = contained(text(s, "service_name", F.lower("service_name")), needle(repos, F.lower("name"))).join(place, F.col("needle") == F.col("low")).select(F.col("id").alias("service_name"), F.lit(1).alias("late"), "place", "name")
    low = s.select("service_name", F.lower("service_name").alias("own"))
    held = contained(text(place, "name", F.col("low")), needle(low, F.col("own"))).join(place, F.col("id") == F.col("name")).join(low, F.col("needle") == F.col("own")).select("service_name", F.lit(1).alias("late"), "place", "name")
    hits = inside("local_path").union(inside("name")).union(holds).union(held)
    return hits.groupBy("service_name").agg(F.min(F.struct("late", "place", "name"))["name"].alias("repo"))

