"""Streaming forms with keyed state: batches carried over failed loads, first accesses within a budget, output waited for.

Each has a batch form in watch or output_text and gives its rows on the same input. State is kept by key in the state
store (set spark.sql.streaming.stateStore.providerClass to the RocksDB provider), never in the worker, and is
forgotten `idle` milliseconds after it was last written where that is given; such a query always has a next
micro-batch to forget in, so that a trigger of what is available now doesn't end: give it a processing-time one. A key's rows must come in order, except
within one micro-batch, whose rows of a key are ordered here: bound it by the source's limits (maxFilesPerTrigger,
maxOffsetsPerTrigger). Rows with a null key or order are left out; empty streams give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphloom.session import importable
from graphloom.streaming.output_text import ending, shown


def _ordered(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable")


class _Carry(StatefulProcessor):
    """The paths of batches that failed to load since the last one that did."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.paths = handle.getMapState("paths", "path string", "seen boolean", self.idle)
        self.open = handle.getValueState("open", "first long, loads long", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, loads = self.open.get() if self.open.exists() else (None, 0)
        out = []
        pending: set[str] = set()  # of this micro-batch; the store is read once a merged batch, not once a row
        for at, paths, loaded in _ordered(rows, ["first"])[["first", "paths", "loaded"]].itertuples(index=False):
            first, loads = int(at) if first is None else first, loads + 1
            pending.update(p for p in (() if paths is None else paths) if p is not None)
            if loaded:
                pending.update(p for (p,) in (self.paths.keys() if self.paths.exists() else ()))
                self.paths.clear()
                out.append((key[0], first, sorted(pending), loads, True))
                first, loads, pending = None, 0, set()
        for path in pending:
            self.paths.updateValue((path,), (True,))
        if loads:
            self.open.update((first, loads))
        else:
            self.open.clear()
        yield pd.DataFrame(out, columns=["watcher", "first", "paths", "loads", "loaded"])

    def close(self) -> None:
        pass


def carried_stream(batches: DataFrame, idle: int | None = None) -> DataFrame:
    """watch.carried_batches over a stream of batches(watcher, first, paths, loaded): rows come out when a batch loads; a run of failures at the end waits in the state."""
    importable(batches.sparkSession)
    kind = batches.schema["watcher"].dataType.simpleString()
    rows = batches.where("watcher IS NOT NULL AND first IS NOT NULL").select("watcher", "first", "paths", F.coalesce("loaded", F.lit(False)).alias("loaded"))
    out = f"watcher {kind}, first long, paths array<string>, loads long, loaded boolean"
    return rows.groupBy("watcher").transformWithStateInPandas(_Carry(idle), out, "Append", "ProcessingTime" if idle else "None")


class _Budget(StatefulProcessor):
    """The different accesses of a task, of which no more than budget are kept, and whether there were more."""

    def __init__(self, budget: int, idle: int | None):
        self.budget, self.idle = budget, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "path string, operation string, result string", "seq long", self.idle)
        self.count = handle.getValueState("count", "kept long, over boolean", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept, over = self.count.get() if self.count.exists() else (0, False)
        out = []
        fields = ["path", "operation", "result"]
        new = _ordered(rows, ["seq", *fields]).drop_duplicates(fields)
        for seq, *access in new[["seq", *fields]].itertuples(index=False):
            access = tuple(x if isinstance(x, str) else None for x in access)
            if over and kept >= self.budget:
                break
            if self.seen.containsKey(access):
                continue
            if kept >= self.budget:
                over = True
                out.append((key[0], None, None, None, seq, True))
                break
            self.seen.updateValue(access, (int(seq),))
            kept += 1
            out.append((key[0], *access, seq, False))
        self.count.update((kept, over))
        yield pd.DataFrame(out, columns=["task", *fields, "seq", "over"])

    def close(self) -> None:
        pass


def first_accesses_stream(accesses: DataFrame, budget: int, idle: int | None = None) -> DataFrame:
    """task, path, operation, result, seq, over: watch.first_accesses over a stream of accesses(task, path, operation, result, seq).

    A task that goes beyond its budget has one row more, with over set and the seq of the first access that was not
    kept; how many follow isn't counted, so that a task's state never holds more than budget accesses.
    """
    importable(accesses.sparkSession)
    kind = accesses.schema["task"].dataType.simpleString()
    rows = accesses.where("task IS NOT NULL AND seq IS NOT NULL").select("task", "path", "operation", "result", F.col("seq").cast("long").alias("seq"))
    out = f"task {kind}, path string, operation string, result string, seq long, over boolean"
    return rows.groupBy("task").transformWithStateInPandas(_Budget(budget, idle), out, "Append", "ProcessingTime" if idle else "None")


class _Shown(StatefulProcessor):
    """The texts a task still waits for, and for each of its streams the end of what was shown and what is open of a sequence."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "patterns array<string>", self.idle)
        self.streams = handle.getMapState("streams", "stream string", "tail string, begun string", self.idle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = _ordered(rows, ["seq", "stream", "text"])
        pending = list(self.pending.get()[0]) if self.pending.exists() else list(dict.fromkeys(found["patterns"].iloc[0]))
        ready, changed = None, {}
        for stream, seq, text in found[["stream", "seq", "text"]].itertuples(index=False) if pending else ():
            if stream not in changed:
                changed[stream] = self.streams.getValue((stream,)) if self.streams.containsKey((stream,)) else ("", "")
            tail, begun = changed[stream]
            new, begun = shown(text, begun)
            pending = [p for p in pending if p not in tail + new]
            if not pending:
                ready = seq
                break
            changed[stream] = ending(tail + new, max(map(len, pending)) - 1), begun
        self.pending.update((pending,))  # an empty list is a task that was ready, which is told once
        if pending:
            for stream, held in changed.items():
                self.streams.updateValue((stream,), held)
        else:
            self.streams.clear()
        yield pd.DataFrame([] if ready is None else [(key[0], ready)], columns=["task", "seq"])

    def close(self) -> None:
        pass


def readiness_stream(chunks: DataFrame, patterns: DataFrame, idle: int | None = None) -> DataFrame:
    """output_text.readiness over a stream of chunks(task, stream, seq, text); patterns(task, pattern) is a static table. A task is put out once, with the chunk that made it ready."""
    importable(chunks.sparkSession)
    kind = chunks.schema["task"].dataType.simpleString()
    waited = patterns.where("task IS NOT NULL AND pattern IS NOT NULL").groupBy("task").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"))
    rows = chunks.where("task IS NOT NULL AND stream IS NOT NULL AND seq IS NOT NULL AND text IS NOT NULL").select("task", "stream", F.col("seq").cast("long").alias("seq"), "text")
    return rows.join(waited, "task").groupBy("task").transformWithStateInPandas(_Shown(idle), f"task {kind}, seq long", "Append", "ProcessingTime" if idle else "None")
