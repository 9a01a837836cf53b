"""Alarm logic on unbounded inputs; each stream's final result is that of its batch counterpart."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import kept, shared_path

#: Rows of a file that arrives.
AT_ONCE = 250_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_clusters(stream: DataFrame, key: str, ts: str, theta: str, late: str) -> DataFrame:
    """Clusters of alarms by gaps of at most theta, once the watermark has passed their end."""
    w = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, theta).alias("w"))
    return w.agg(F.count("*").alias("size"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(key, "first", "last", "size")


def alarm_rate(stream: DataFrame, ts: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Alarms in tumbling or sliding windows of time."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"))
    return w.agg(F.count("*").alias("alarms")).select(F.col("w.start").alias("start"), "alarms")


def _micros(x: pd.Timestamp) -> int:
    return int((x.tz_localize(None) if x.tzinfo else x).value // 1000)


class Refractory(StatefulProcessor):
    """Accepts alarms of one key in the order of time; an accepted one suppresses the others for the hold (closed at the end).

    State: the last accepted time, the times that wait, and one timer, at the earliest of them.  A time is decided when the
    watermark has passed it, as no earlier one can come then; so neither the order of arrival nor where batches end matters.
    """

    def __init__(self, key: str, ts: str, hold_micros: int) -> None:
        self.key, self.ts, self.hold = key, ts, hold_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")
        self.waiting = handle.getListState("waiting", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(_micros(t),) for b in rows for t in b[self.ts]]
        before = self._earliest()
        self.waiting.appendList(new)
        first = min(t for (t,) in new) if new else None
        if first is not None and (before is None or first < before):
            self._rewind(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sure = timerValues.getCurrentWatermarkInMs() * 1000
        times = sorted(t for (t,) in self.waiting.get())
        at = self.last.get()[0] if self.last.exists() else None
        accepted = []
        for t in times:
            if t > sure:
                break
            if at is None or t > at + self.hold:
                accepted.append(t)
                at = t
        rest = [(t,) for t in times if t > sure]
        if at is not None:
            self.last.update((at,))
        if rest:
            self.waiting.put(rest)
            self._rewind(rest[0][0])
        else:
            self.waiting.clear()
        if accepted:
            yield pd.DataFrame({self.key: [key[0]] * len(accepted), self.ts: pd.to_datetime(accepted, unit="us")})

    def close(self) -> None:
        pass

    def _earliest(self) -> int | None:
        return min((t for (t,) in self.waiting.get()), default=None) if self.waiting.exists() else None

    def _rewind(self, t: int) -> None:
        """One timer, in the millisecond after t."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(t // 1000 + 1)


def refractory(stream: DataFrame, key: str, ts: str, hold_seconds: float, late: str) -> DataFrame:
    """Alarms that are accepted when each accepted one suppresses the others for the hold (see Refractory)."""
    rows = stream.select(key, ts).withWatermark(ts, late)
    state = Refractory(key, ts, round(hold_seconds * 1_000_000))
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # the store that timers and lists need
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(state, f"`{key}` {kind}, `{ts}` timestamp", "append", "EventTime")


def in_batches(df: DataFrame, ts: str, parts: int, most: int = 100, at_once: int = AT_ONCE) -> DataFrame:
    """A stream of df's rows in the order of time: files in the shared folder, of which a trigger reads a part's.

    A trigger reads a fixed number of files, so every part is written as so many; else it would read some of a part, and the
    watermark would pass the others' rows.  A file has about at_once rows.
    """
    spark = df.sparkSession
    path = shared_path(spark, "arriving")
    kept_rows = kept(df.where(F.col(ts).isNotNull()))
    found = kept_rows.agg(F.percentile_approx(F.unix_micros(ts), [k / parts for k in range(1, parts)], 1000).alias("q")).first()[0] or []
    t, cuts = F.unix_micros(ts), sorted(set(found))[: most - 1]
    part = sum(((t > c).cast("int") for c in cuts), F.lit(0))
    sizes = [r["count"] for r in kept_rows.groupBy(part.alias("part")).count().collect()]  # a row a part
    # No more files than the smallest part fills: rows are dealt in turn, so a task with that many rows writes to all.
    files = max(1, min(-(-max(sizes, default=0) // at_once), min(sizes, default=0) // kept_rows.rdd.getNumPartitions()))
    for k in range(len(cuts) + 1):  # one after the other, as files are read by age
        kept_rows.where(part == k).repartition(files).write.parquet(f"{path}/{k:04d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


def run_into(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a query over all that its source has now, into files; called again, it goes on where it stopped."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """run_into files of its own in the shared folder, and what is there then; nothing passes through the driver."""
    spark: SparkSession = stream.sparkSession
    path = shared_path(spark, f"stream-{name}")
    run_into(stream, path, shared_path(spark, f"progress-{name}"))
    return spark.read.schema(stream.schema).parquet(path)
