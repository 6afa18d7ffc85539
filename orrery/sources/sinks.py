"""Sinks and text forms: JSON logs, metric lines, server-sent events, documents."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_json(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines, nulls left out."""
    rows.write.mode("append").json(path)


def as_json(rows: DataFrame) -> DataFrame:
    """(line): each row as JSON, keys in order of their names."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("line"))


def metric_lines(rows: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    """(line) in the text format of metric scrapers, of rows (label, value)."""
    return rows.select(F.concat(F.lit(f'{metric}{{{label}="'), F.col(label).cast("string"), F.lit('"} '), F.col(value).cast("string")).alias("line"))


def event_frame(kind: Column, data: Column) -> Column:
    """A frame of a server-sent event stream; data is a struct."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def document(rows: DataFrame, key: str, title: str, section: str, order: str, line: str) -> DataFrame:
    """(key, markdown): a heading, then a section for each value of `section` with its lines as a list, in order.

    Lines of a section are put in order inside that section's group; the document is put together from finished sections.
    """
    items = rows.groupBy(key, title, section).agg(F.array_sort(F.collect_list(F.struct(order, line))).alias("items"))
    body = F.concat(F.lit("## "), F.col(section), F.lit("\n\n"), F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x[line])), "\n"))
    parts = items.select(key, title, F.struct(F.col(section).alias("s"), body.alias("body")).alias("part"))
    whole = parts.groupBy(key, title).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    text = F.concat(F.lit("# "), F.col(title), F.lit("\n\n"), F.array_join(F.transform("parts", lambda p: p["body"]), "\n\n"), F.lit("\n"))
    return whole.select(key, text.alias("markdown"))


def snapshot_json(rows: DataFrame, path: str) -> None:
    """The whole table as JSON lines, in place of what the path held."""
    rows.write.mode("overwrite").json(path)


def replace_collection(rows: DataFrame, path: str, name: str) -> None:
    """Writes a collection in place of the one of that name; the others under the path stay."""
    rows.write.mode("overwrite").parquet(_of(path, name))


def drop_collection(spark: SparkSession, path: str, name: str) -> bool:
    """Deletes a collection; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_of(path, name))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unified(spark: SparkSession, path: str) -> DataFrame:
    """All collections as one table with the column `collection`, which prunes folders; nothing is copied."""
    return spark.read.option("mergeSchema", True).parquet(path)


def _of(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/collection={quote(name, safe='')}"
