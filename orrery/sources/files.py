"""Sources: trees of source files, repositories, service units, JSON logs, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File endings by language, and parts of a path that are never indexed.
ENDINGS = {"go": ["go"], "python": ["py"], "javascript": ["js", "jsx"], "typescript": ["ts", "tsx"], "java": ["java"], "ruby": ["rb"]}
SKIPPED = ["vendor", "node_modules", ".git", "__pycache__", "dist", "build", "target", ".venv", "venv", ".idea"]


def source_files(spark: SparkSession, root: str, languages: list[str] | None = None, skipped: list[str] = SKIPPED) -> DataFrame:
    """(path, language, content) of the files under root in the given languages (all when none are named).

    A file in a skipped folder or of white space only is left out. The path filter reaches the listing, so other files
    are never opened; a folder without such files gives no rows.
    """
    wanted = {e: lang for lang in languages or ENDINGS for e in ENDINGS[lang]}
    found = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(wanted) + "}").text(root)
    parts = F.split(F.col("path"), "/")
    language = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    rows = found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    rows = rows.where(F.trim("content").rlike(r"\S") & ~F.arrays_overlap(parts, F.array(*map(F.lit, skipped))))
    return rows.select("path", F.try_element_at(language, F.element_at(F.split("path", r"\."), -1)).alias("language"), "content")


def repository_of(path: Column) -> Column:
    """The folder that holds .git, of a path inside .git; null for other paths."""
    return F.nullif(F.regexp_extract(path, r"^(.*?)/\.git(?:/|$)", 1), F.lit(""))


def repositories(paths: DataFrame) -> DataFrame:
    """(repo_path, name): each folder with a .git in it, once, of a listing (path). Trailing and double slashes don't tell paths apart."""
    clean = F.regexp_replace("path", "/+", "/")
    found = paths.select(repository_of(clean).alias("repo_path")).where("repo_path is not null").distinct()
    return found.select("repo_path", F.element_at(F.split("repo_path", "/"), -1).alias("name"))


def base_paths(variable: str | None, config: dict | None) -> list[str]:
    """Base folders: from the variable (cut at colons, else at commas) if it names any, else from base_paths or paths of the configuration."""
    named = [p.strip() for p in (variable or "").split(":" if ":" in (variable or "") else ",")]
    config = config or {}
    return [p for p in named if p] or list(config.get("base_paths") or config.get("paths") or [])


def merged_config(main: dict, *others: dict) -> dict:
    """The main configuration; other files only fill keys that are missing, the first of them first."""
    out = dict(main)
    for other in others:
        out |= {k: v for k, v in other.items() if k not in out}
    return out


def service_units(units: DataFrame) -> DataFrame:
    """(service_name, working_directory, exec_start) of unit files (path, content): the first line of each kind; null where there is none."""
    first = lambda key: F.trim(F.get(F.regexp_extract_all("content", F.lit(rf"(?m)^{key}=(.*)$"), F.lit(1)), F.lit(0)))
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.service$", "")
    return units.where(F.col("path").endswith(".service")).select(name.alias("service_name"), first("WorkingDirectory").alias("working_directory"), first("ExecStart").alias("exec_start"))


def json_lines(spark: SparkSession, path: str, schema: str, **equal: str) -> DataFrame:
    """Rows of a log of JSON lines; lines that aren't JSON go, and rows whose columns differ from those asked for."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for column, value in equal.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows
