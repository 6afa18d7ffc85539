"""Digest of a repository's documentation from the hits of its four searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards

# What is searched for each section, and how many hits it takes.
SEARCHES = {"main": ("main func init", 5), "handlers": ("handler router endpoint", 5), "models": ("struct type model", 5), "configs": ("config env variable", 3)}


def docs_digest(hits: DataFrame) -> DataFrame:
    """(repo, files_found, packages, key_files, entry_points, endpoints, models, markdown) of hits (repo, search, rank, file, code).

    A repository's hits are at most 18 (SEARCHES), whatever its size. Files and packages come in order of searches and
    ranks, each once (the first 10 files); 20 endpoints and models are kept, of which the document shows 10, and 5 entries.
    Null code is empty. Hits of other searches or beyond a search's number are left out.
    """
    names = F.array(*map(F.lit, SEARCHES))
    most = F.element_at(F.array(*[F.lit(n) for _, n in SEARCHES.values()]), F.col("s"))
    own = hits.select("repo", F.array_position(names, F.col("search")).cast("int").alias("s"), "rank", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("code", F.lit("")).alias("code"))
    own = own.where("s > 0").where(F.col("rank") <= most)
    rows = own.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("s", "rank", "file", "code"))).alias("h"))
    of = lambda name: F.filter("h", lambda x: x["s"] == list(SEARCHES).index(name) + 1)
    files = F.array_distinct(F.col("h.file"))
    package = lambda x: F.when(x["code"].startswith("package "), guards.strip(F.replace(F.split(x["code"], "\n")[0], F.lit("package "), F.lit(""))))
    entries = F.transform(F.filter(of("main"), lambda x: guards.entry_point(x["code"])), lambda x: F.struct(x["file"].alias("file"), guards.preview(x["code"]).alias("preview")))
    lines = lambda x: F.filter(F.transform(F.split(x["code"], "\n"), guards.strip), guards.endpoint_line)
    ends = F.flatten(F.transform(of("handlers"), lambda x: F.transform(lines(x), lambda y: F.struct(x["file"].alias("file"), F.substring(y, 1, 100).alias("line")))))
    models = F.flatten(F.transform(of("models"), lambda x: F.transform(guards.struct_names(x["code"]), lambda y: F.struct(y.alias("name"), x["file"].alias("file")))))
    rows = rows.select(
        "repo", F.size(files).alias("files_found"), F.array_distinct(F.array_compact(F.transform("h", package))).alias("packages"),
        F.slice(files, 1, 10).alias("key_files"), entries.alias("entry_points"), F.slice(ends, 1, 20).alias("endpoints"), F.slice(models, 1, 20).alias("models"),
    )

    def part(title, found, n, line):
        return F.when(F.size(found) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.transform(F.slice(found, 1, n), line), "\n"), F.lit("\n")))

    overview = F.concat(F.lit("## Overview\n\n- **Packages**: "), F.array_join("packages", ", "), F.lit("\n- **Files**: "), F.col("files_found"), F.lit(" indexed\n"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("# "), "repo", F.lit("\n")), overview,
        part("Entry Points", F.col("entry_points"), 5, lambda e: F.concat(F.lit("- `"), e["file"], F.lit("`"))),
        part("API Endpoints", F.col("endpoints"), 10, lambda e: F.concat(F.lit("- `"), e["line"], F.lit("`  ("), e["file"], F.lit(")"))),
        part("Data Models", F.col("models"), 10, lambda e: F.concat(F.lit("- `"), e["name"], F.lit("` ("), e["file"], F.lit(")"))),
    )
    return rows.withColumn("markdown", text)
