"""Stateful processors with list and value state, timers and TTL. They need the RocksDB state store (see STORE) and run on
streams and on tables alike."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Setting that a session needs for these processors.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


class Admission(StatefulProcessor):
    """A caller's sliding limit. State: the times of its last admitted requests, at most `limit`; a timer clears them when the
    last has left the window."""

    def __init__(self, by: str, key: str, limit: int, seconds: int) -> None:
        self.by, self.key, self.limit, self.span = by, key, limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = [x[0] for x in self.times.get()] if self.times.exists() else []
        asked = pd.concat(list(rows)).sort_values(["t", self.key])
        passed = []
        for t in micros(asked["t"]).tolist():
            times = [x for x in times if x > t - self.span]
            passed.append(len(times) < self.limit)
            if passed[-1]:
                times.append(t)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if times:
            self.times.put([(x,) for x in times])
            self.handle.registerTimer(max((times[-1] + self.span) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.times.clear()
        yield pd.DataFrame({self.by: key[0], self.key: asked[self.key].to_numpy(), "admitted": passed})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited(requests: DataFrame, by: str, ts: str, key: str, limit: int = 10, seconds: int = 60) -> DataFrame:
    """(by, key, admitted) of a stream of requests: fewer than `limit` passed in the `seconds` before; rejected ones don't count.
    Requests of one micro-batch are taken in order of time, then key. Later ones than the watermark (`seconds`) are dropped."""
    rows = requests.select(by, key, F.col(ts).cast("timestamp").alias("t")).withWatermark("t", f"{seconds} seconds")
    kinds = dict(rows.dtypes)
    return rows.groupBy(by).transformWithStateInPandas(Admission(by, key, limit, seconds), f"{by} {kinds[by]}, {key} {kinds[key]}, admitted boolean", "Append", "EventTime")


class Answers(StatefulProcessor):
    """A cache by key. State: the newest answer and when it was stored, which the state store drops `ttl` after it was written."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "answer string, stored long", self.ttl * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        out = []
        asked = pd.concat(list(rows))
        asked = asked.assign(at=micros(asked["t"]), asks=asked["answer"].isna()).sort_values(["at", "asks", "id"])
        put = False
        for row in asked.itertuples():
            if not row.asks:
                held, put = (row.answer, row.at), True
            else:
                live = held is not None and row.at < held[1] + self.ttl * 1_000_000
                out.append((row.id, held[0] if live else None, live))
        if put:
            self.held.update(held)
        yield pd.DataFrame(out, columns=["id", "answer", "hit"])

    def close(self) -> None:
        pass


def answered(rows: DataFrame, ttl: int) -> DataFrame:
    """(id, answer, hit) of the questions among rows (id, key, t, answer): a row with an answer stores it under its key, one without
    asks for the newest answer stored less than `ttl` seconds before. What is stored at the same time counts.

    Hits go by the rows' own times; the state of a key leaves by the clock, `ttl` seconds after it was last stored."""
    kind = dict(rows.dtypes)["id"]
    rows = rows.select("id", "key", F.col("t").cast("timestamp").alias("t"), "answer")
    return rows.groupBy("key").transformWithStateInPandas(Answers(ttl), f"id {kind}, answer string, hit boolean", "Append", "ProcessingTime")
