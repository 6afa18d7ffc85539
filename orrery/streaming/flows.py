"""Structured Streaming: windows over events, rolling limits, incremental index merges. Each runs on a batch frame too, where Spark allows it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import catalog


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Events of a growing folder of JSON lines, in a fixed schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def tumbling(events: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, by, n, total) of windows of one width; what is later than `late` is dropped when events is a stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = rows.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(by, session_start, n): runs of events with no longer pause than gap."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = rows.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(by, F.col("w.start").alias("session_start"), "n")


def limiter(requests: DataFrame, by: str, ts: str, key: str, limit: int = 10, seconds: int = 60) -> DataFrame:
    """(by, key, admitted) of a stream of requests; the state of a caller is the times of its last admitted requests, at most `limit`.

    Rejected requests don't count. Requests of one micro-batch are taken in order of time, then key; a caller's state ends
    with `seconds` of event time after its last admitted request.
    """
    rows = requests.select(by, key, F.col(ts).cast("timestamp").alias("t")).withWatermark("t", f"{seconds} seconds")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        for rows in [pd.concat(list(frames)).sort_values(["t", key])]:
            passed = []
            for t in rows["t"].astype("datetime64[us]").astype("int64"):
                times = [x for x in times if x > t - seconds * 1_000_000]
                passed.append(len(times) < limit)
                if passed[-1]:
                    times.append(int(t))
            yield pd.DataFrame({by: group[0], key: rows[key].to_numpy(), "admitted": passed})
        state.update((times,))
        if times:
            state.setTimeoutTimestamp(max(times[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    out = f"{by} {kinds[by]}, {key} {kinds[key]}, admitted boolean"
    return rows.groupBy(by).applyInPandasWithState(step, out, "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def index_merge(target: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls to merge a micro-batch of changed files (keys, ..., deleted) into the table at target.

    Each batch reads the newest version and writes the next, named by the batch: a batch that is run again writes the same version.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where(~F.coalesce("deleted", F.lit(False))).drop("deleted").dropDuplicates(keys)
        if number == 0:
            out = new
        else:
            old = spark.read.schema(new.schema).parquet(f"{target}/v={number - 1}")
            out = catalog.upsert(catalog.delete(old, batch, keys), new, keys)
        out.write.mode("overwrite").parquet(f"{target}/v={number}")

    return merge
