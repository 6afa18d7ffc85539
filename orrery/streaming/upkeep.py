"""What runs for long: a cache table whose entries expire, and polling for pending tasks."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def cache_writer(target: str) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls to add entries (key, answer, stored_at, expires_at) to the cache at target.

    Entries are only added, in folders by batch and by day of expiry (UTC): no batch rewrites what others stored, and a batch
    that is run again replaces its own folder. An entry without a time of expiry never counts as live, so it is not stored.
    """

    def store(batch: DataFrame, number: int) -> None:
        day = F.date_from_unix_date(F.floor(F.unix_micros("expires_at") / 86_400_000_000).cast("int"))
        rows = batch.where("expires_at is not null").withColumn("day", day)
        rows.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{target}/batch={number}")

    return store


def live(spark: SparkSession, target: str, now: datetime, schema: str = "key string, answer string, stored_at timestamp, expires_at timestamp") -> DataFrame:
    """The cache's entries that have not expired, for `assistant.cached`; days that are over are not read."""
    day = now.astimezone(timezone.utc).date()
    rows = spark.read.schema(f"{schema}, batch int, day date").option("basePath", target).parquet(target)
    return rows.where((F.col("day") >= F.lit(day)) & (F.col("expires_at") > F.lit(now))).drop("batch", "day")


def drop_expired(spark: SparkSession, target: str, now: datetime) -> int:
    """Deletes the folders of days that are over; gives their number. Folders are listed, entries not read."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(target)
    fs, n, today = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0, now.astimezone(timezone.utc).date()
    for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{target}/batch=*/day=*")) or []:
        day = s.getPath().getName()[4:]
        if not day.startswith("__") and date.fromisoformat(day) < today:
            n += fs.delete(s.getPath(), True)
    return n


def poll(
    spark: SparkSession, tasks: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str,
    seconds: float = 60, iterations: int | None = None, pending: Column | None = None,
) -> StreamingQuery:
    """Every `seconds`, handle(the tasks that are pending, iteration from 1), at most `iterations` times; stop() ends it.

    Tasks are read anew each time and their status is not written back: what stays pending comes again. An iteration with
    nothing pending is counted, but not handled. The handler must bear to get the same tasks twice.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", max(1, round(1 / seconds) if seconds < 1 else 1)).load()
    wanted = F.col("status") == "pending" if pending is None else pending
    done, started = 0, threading.Event()

    def stop() -> None:
        started.wait()
        query.stop()

    def tick(_: DataFrame, number: int) -> None:
        nonlocal done
        if iterations is not None and done >= iterations:
            return
        done += 1
        found = tasks().where(wanted)
        if not found.isEmpty():
            handle(found, done)
        if iterations is not None and done >= iterations:
            threading.Thread(target=stop, daemon=True).start()  # a query can't stop itself within its batch

    query = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
    started.set()
    return query
