"""Batches of changes while watching: session windows, and a capped debounce with state of its own.

Each has a batch form and a streaming form over the same logic; the streaming forms that keep keyed state are in states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.session import importable


def session_batches(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """key, first_ms, n: runs of events of a key with less than gap between them. On a stream, set a watermark on `at` first."""
    batches = events.groupBy(key, F.session_window(at, gap).alias("batch")).agg(F.count("*").alias("n"))
    return batches.select(key, F.unix_millis("batch.start").alias("first_ms"), "n")


def window_peaks(samples: DataFrame, key: str, at: str, value: str, width: str) -> DataFrame:
    """key, window_ms, peak: the largest sample of each tumbling window. On a stream, set a watermark on `at` first."""
    peaks = samples.groupBy(key, F.window(at, width).alias("w")).agg(F.max(value).alias("peak"))
    return peaks.select(key, F.unix_millis("w.start").alias("window_ms"), "peak")


class Debounce:
    """An open batch: only a path that it doesn't hold yet moves its deadline, and never beyond cap after the first event."""

    def __init__(self, gap: int, cap: int, first: int | None = None, deadline: int | None = None, paths: list[str] | None = None):
        self.gap, self.cap, self.first, self.deadline, self.paths = gap, cap, first, deadline, dict.fromkeys(paths or ())

    def close(self) -> tuple[int, int] | None:
        """(first event, number of paths) of the open batch, which ends."""
        found = None if self.first is None else (self.first, len(self.paths))
        self.first, self.paths = None, {}
        return found

    def add(self, at: int, path: str) -> tuple[int, int] | None:
        """Takes an event in; returns the batch that had ended before it, if any."""
        ended = self.close() if self.first is not None and at >= self.deadline else None
        if self.first is None:
            self.first, self.deadline, self.paths = at, at + min(self.gap, self.cap), {path: None}
        elif path not in self.paths:
            self.paths[path] = None
            self.deadline = min(at + self.gap, self.first + self.cap)
        return ended


def capped_batches(events: DataFrame, gap: int, cap: int) -> DataFrame:
    """watcher, first, paths of every batch of events(watcher, path, at).

    A pause of gap ends a batch for sure, so that events are grouped between pauses first; the state machine runs over one such stretch.
    """
    importable(events.sparkSession)
    timed = events.withColumn("ts", F.timestamp_millis("at"))
    stretches = timed.groupBy("watcher", F.session_window("ts", f"{gap} milliseconds").alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("events"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for watcher, rows in zip(frame["watcher"], frame["events"], strict=True):
                state = Debounce(gap, cap)
                found = [state.add(int(x["at"]), x["path"]) for x in rows] + [state.close()]
                out += [(watcher, *x) for x in found if x]
            yield pd.DataFrame(out, columns=["watcher", "first", "paths"])

    return stretches.select("watcher", "events").mapInPandas(run, "watcher long, first long, paths long")


def carried_batches(batches: DataFrame) -> DataFrame:
    """watcher, first, paths, loads of batches(watcher, first, paths: array, loaded): what a failed load leaves is merged into the next batch, up to one that loads; a last run of failures stays as one, not loaded."""
    earlier = Window.partitionBy("watcher").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.coalesce(F.sum(F.col("loaded").cast("int")).over(earlier), F.lit(0))
    merged = batches.withColumn("turn", turn).groupBy("watcher", "turn")
    return merged.agg(F.min("first").alias("first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths")))).alias("paths"), F.count("*").alias("loads"), F.bool_or("loaded").alias("loaded")).drop("turn")


def first_accesses(accesses: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """(task, path, operation, result, seq of the first copies of accesses, at most budget a task; task, dropped of tasks beyond it)."""
    first = accesses.groupBy("task", "path", "operation", "result").agg(F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("task").orderBy("seq", "path", "operation", "result"))
    kept = first.withColumn("place", place).where(F.col("place") <= budget).drop("place")
    over = first.groupBy("task").agg((F.count("*") - budget).alias("dropped")).where("dropped > 0")
    return kept, over


def capped_stream(events: DataFrame, gap: int, cap: int, late: str = "0 seconds") -> DataFrame:
    """The same over a stream of events(watcher, path, ts): a batch is put out when a later event or the watermark passes its deadline."""
    importable(events.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, deadline, paths = state.get if state.exists else (None, None, [])
        batch, out = Debounce(gap, cap, first, deadline, list(paths)), []
        if state.hasTimedOut:
            out.append(batch.close())
        else:
            rows = sorted((int(t.value // 1_000_000), p) for frame in frames for t, p in zip(pd.DatetimeIndex(frame["ts"]), frame["path"], strict=True))
            out += [batch.add(at, path) for at, path in rows]
        if batch.first is None:
            state.remove()
        else:
            state.update((batch.first, batch.deadline, list(batch.paths)))
            state.setTimeoutTimestamp(max(batch.deadline, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *x) for x in out if x], columns=["watcher", "first", "paths"])

    return (
        events.withWatermark("ts", late)
        .groupBy("watcher")
        .applyInPandasWithState(run, "watcher long, first long, paths long", "first long, deadline long, paths array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    )
