"""The same operators on streams. Sources are whatever ``readStream`` gives; sinks are files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from lineforge.functions import text as tx
from lineforge.operators import library, parsing
from lineforge.operators.metrics import MICROS
from lineforge.sources import sinks


def stream_parse(lines: DataFrame, col: str = "raw", year: int | None = None) -> DataFrame:
    """Mixed lines to common columns with a ``route``; stateless."""
    return sinks.with_route(parsing.parse_mixed(lines, col, year))


def stream_signatures(
    lines: DataFrame, window: str = "1 hour", watermark: str = "10 minutes", time: str = "ts", col: str = "raw"
) -> DataFrame:
    """Lines per signature and tumbling window; rows later than the watermark are dropped.

    Counts combine map-side before they reach the state, so a hot signature costs one row per task.
    """
    signed = lines.withColumn("signature", tx.signature(F.col(col))).withWatermark(time, watermark)
    counts = signed.groupBy(F.window(time, window), "source", "signature").agg(F.count("*").alias("lines"))
    return counts.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "source", "signature",
        "lines")


def stream_route(lines: DataFrame, parsers: DataFrame, col: str = "raw", dialect: str = "py") -> DataFrame:
    """``route_lines`` with the lines as stream and the library as table."""
    return library.route_lines(lines, parsers, col, dialect)


def last_per_slot(
    samples: DataFrame, by: Sequence[str], step_s: int, time: str = "ts", watermark: str = "10 minutes",
) -> DataFrame:
    """The last sample per series and step, once the watermark has passed the step's end.

    A step holds the samples after the one before it and up to its own end, as the evaluation grid does; of equal
    times the largest value counts. Samples combine map-side before they reach the state. Adds ``window_end``, the event
    time for what follows.
    """
    shifted = samples.withColumn("__at", F.col(time) - F.expr("INTERVAL 1 MICROSECOND")).withWatermark("__at", watermark)
    last = F.max(F.struct(F.unix_micros(time).alias("at"), F.col("value").cast("double").alias("value")))
    slots = shifted.groupBy(*by, F.window("__at", f"{step_s} seconds")).agg(last.alias("last"))
    return slots.select(
        *by, F.window_time("window").alias("window_end"), F.unix_micros("window.end").alias("ends"), "last.at", "last.value")


class AlertClock(StatefulProcessor):
    """Alert states of one series on the evaluation grid, from its slots and from event-time timers.

    A slot's value holds at the grid times up to the next slot, while its sample is at most ``lookback`` old. Grid times
    without a slot are judged once the watermark has passed them, by a timer at the next one. All grid times of a batch
    are judged together, as arrays.
    """

    def __init__(self, keys: Sequence[str], step_s: int, lookback_s: int, for_s: int) -> None:
        self.keys, self.step, self.lookback, self.held = list(keys), step_s * MICROS, lookback_s * MICROS, for_s * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "series", "slot long, at long, value double, active boolean, judged long, since long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        slots = pd.concat(rows, ignore_index=True)
        yield from self._judge(key, slots.sort_values("ends"), timerValues)

    def handleExpiredTimer(
        self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield from self._judge(key, None, timerValues)

    def _judge(self, key: tuple, new: pd.DataFrame | None, timers: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get() if self.state.exists() else None
        columns = [[x] for x in before[:4]] if before else [[], [], [], []]
        if new is not None:
            fresh = (new["ends"] // self.step, new["at"], new["value"], new["active"])
            columns = [np.concatenate([old, x.to_numpy()]) for old, x in zip(columns, fresh)]
        slot, at = (np.asarray(c, dtype=np.int64) for c in columns[:2])
        value, active = np.asarray(columns[2], dtype=float), np.asarray(columns[3], dtype=bool)
        passed = timers.getCurrentWatermarkInMs() * 1000 // self.step
        reach = (at + self.lookback) // self.step
        # up to the next slot; the last one holds as far as the watermark has come, and at its own time
        until = np.minimum(reach, np.append(slot[1:] - 1, max(passed, slot[-1])))
        start = slot.copy()
        if before:
            start[0] = before[4] + 1
        count = np.maximum(until - start + 1, 0)
        grid = np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        held, on = np.repeat(value, count), np.repeat(active, count)
        judged, since = (before[4], before[5]) if before else (None, None)
        if len(grid):
            previous = np.append(grid[0] - 1 if judged is None else judged, grid[:-1])
            was_on = np.append(since is not None, on[:-1])
            begins = on & ~(was_on & (previous == grid - 1))
            at_on = np.where(begins, grid, np.iinfo(np.int64).min)
            at_on[0] = grid[0] if begins[0] else (since if on[0] else at_on[0])
            active_since = np.maximum.accumulate(at_on)
            firing = (grid - active_since) * self.step >= self.held
            states = np.where(~on, "inactive", np.where(firing, "firing", "pending"))
            judged, since = int(grid[-1]), int(active_since[-1]) if on[-1] else None
            yield pd.DataFrame({
                **{name: [part] * len(grid) for name, part in zip(self.keys, key)},
                "ts": pd.to_datetime(grid * self.step, unit="us"), "value": held, "state": states,
                "active_since": pd.to_datetime(pd.Series(np.where(on, active_since * self.step, 0)), unit="us").where(on)})
        elif judged is None:
            judged = int(slot[-1]) - 1
        if before and before[6] is not None:
            self.handle.deleteTimer(before[6])
        if passed > reach[-1]:  # nothing to hold any more, and no slot can follow the last one directly
            self.state.clear()
            return
        timer = (max(judged, int(passed)) + 1) * self.step // 1000
        self.handle.registerTimer(timer)
        self.state.update((int(slot[-1]), int(at[-1]), float(value[-1]), bool(active[-1]), judged, since, timer))


def stream_alerts(
    samples: DataFrame, by: Sequence[str], condition: Column, for_s: int, step_s: int = 30, lookback_s: int = 300,
    time: str = "ts", watermark: str = "10 minutes",
) -> DataFrame:
    """Alert state per series and evaluation time, as ``eval_grid`` and ``alert_states`` give it for a table.

    ``condition`` is on ``value`` and the columns ``by``. A watermarked aggregate keeps the last sample per series and step, so rows
    late by less than the watermark count wherever they arrive; what it lets go feeds a state per series. An evaluation
    time is judged when the watermark has passed it. Needs the RocksDB state store, which ``session.prepare`` sets.
    """
    keys = list(by)
    slots = last_per_slot(samples, keys, step_s, time, watermark).withColumn("active", F.coalesce(condition, F.lit(False)))
    fields = slots.schema
    key_schema = ", ".join(f"`{k}` {fields[k].dataType.simpleString()}" for k in keys)
    output = f"{key_schema}, ts timestamp, value double, state string, active_since timestamp"
    return slots.groupBy(*keys).transformWithStateInPandas(
        AlertClock(keys, step_s, lookback_s, for_s), output, "Append", "EventTime")


def start_file_sink(
    stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (), available_now: bool = True
) -> StreamingQuery:
    """Starts a stream into parquet files; restarts from ``checkpoint`` lose and repeat nothing."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
