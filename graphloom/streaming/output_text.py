"""The text that a terminal would show of output that comes in chunks, and when all texts waited for have been shown.

Control sequences are no text. A sequence may be torn over chunks: what is carried of it is its shortest beginning
that reads on the same way, so that what is carried never grows. The batch form reads ranges of a stream apart: each
range is first read from every way a sequence may be open at its start, the ranges are then followed in order by these
short answers alone, and every range is read again from where it really starts. No task reads a whole stream's text.

Nulls: a chunk without text, task, stream or number shows nothing, nor does a pattern without task or text wait.
Empty chunks and chunks of control sequences alone show nothing; an empty pattern has been shown by a task's first chunk
that has a text, empty or not. Chunks of one number are read in the order of their texts. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpointed, importable

#: ESC [ up to a final byte; ESC with ], P, X, ^ or _ up to BEL or ESC \; ESC with one other character. The groups hold where a text ends within one.
_SEQUENCE = re.compile(r"\x1b(?:\[[^@-~]*+(?:[@-~]|(?P<bracket>\Z))|[\]PX^_](?:[^\x07\x1b]|\x1b[^\\])*+(?:\x07|\x1b\\|(?P<string>\x1b?)\Z)|[^\[\]PX^_]|(?P<bare>\Z))")
#: Every way a sequence may be open, by its shortest beginning.
OPEN = ("", "\x1b", "\x1b[", "\x1b]", "\x1b]\x1b")
#: Chunk numbers of a range that is read in one piece.
RANGE = 256


def shown(text: str, begun: str = "") -> tuple[str, str]:
    """What is shown of text after a sequence of which begun was read, and what is open of a sequence at its end."""
    whole, left = begun + text, ""
    if "\x1b" not in whole:
        return whole, ""
    for m in _SEQUENCE.finditer(whole):
        if m.end() == len(whole):
            left = "\x1b[" if m["bracket"] is not None else "\x1b]" + m["string"] if m["string"] is not None else "\x1b" if m["bare"] is not None else ""
    return _SEQUENCE.sub("", whole), left


def ending(text: str, keep: int) -> str:
    """The last keep characters of text."""
    return text[len(text) - keep :] if 0 < keep < len(text) else text if keep else ""


def readiness(chunks: DataFrame, patterns: DataFrame, width: int = RANGE) -> DataFrame:
    """task, seq: the chunk of chunks(task, stream, seq, text) by which each of a task's texts of patterns(task, pattern) has been shown by one of its streams."""
    importable(chunks.sparkSession)
    asked = patterns.where("task IS NOT NULL AND pattern IS NOT NULL").select("task", "pattern").distinct()
    waited = asked.groupBy("task").agg(F.collect_list("pattern").alias("patterns"))
    keep = max(0, (asked.agg(F.max(F.length("pattern"))).first()[0] or 1) - 1)  # what a text that ends in the next chunk may have of the ones before
    rows = chunks.where("task IS NOT NULL AND stream IS NOT NULL AND seq IS NOT NULL AND text IS NOT NULL").withColumn("range", F.floor(F.col("seq") / width))
    ranges = rows.groupBy("task", "stream", "range").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("chunks"))
    ranges = checkpointed(ranges)
    names, types = ["task", "stream", "range"], {f.name: f.dataType.simpleString() for f in ranges.schema}
    key = ", ".join(f"{c} {types[c]}" for c in names)

    def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = ["".join(x["text"] for x in found) for found in frame["chunks"]]
            read = [[shown(text, begun) for begun in OPEN] for text in texts]
            yield frame[names].assign(tails=[[ending(a, keep) for a, _ in each] for each in read], ends=[[b for _, b in each] for each in read])

    def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = tail = begun = None
        for frame in frames:
            found = []
            for task, name, tails, ends in zip(frame["task"], frame["stream"], frame["tails"], frame["ends"], strict=True):
                if stream != (task, name):
                    stream, tail, begun = (task, name), "", ""
                found.append((tail, begun))
                way = OPEN.index(begun)
                tail, begun = ending(tail + tails[way], keep), ends[way]
            yield frame[names].assign(tail=[a for a, _ in found], begun=[b for _, b in found])

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for task, tail, begun, texts, wanted in zip(frame["task"], frame["tail"], frame["begun"], frame["chunks"], frame["patterns"], strict=True):
                pending = list(wanted)
                for x in texts:
                    new, begun = shown(x["text"], begun)
                    tail += new
                    found += [(task, pattern, x["seq"]) for pattern in pending if pattern in tail]
                    pending = [pattern for pattern in pending if pattern not in tail]
                    if not pending:
                        break
                    tail = ending(tail, keep)
            yield pd.DataFrame(found, columns=["task", "pattern", "seq"])

    read = ranges.select(*names, "chunks").mapInPandas(answers, f"{key}, tails array<string>, ends array<string>")
    begin = read.repartition("task", "stream").sortWithinPartitions("task", "stream", "range").mapInPandas(starts, f"{key}, tail string, begun string")
    whole = ranges.join(begin.join(waited, "task"), names)  # texts meet their patterns by range, so that no task's output is one key
    seen = whole.mapInPandas(first, f"task {types['task']}, pattern string, seq long").groupBy("task", "pattern").agg(F.min("seq").alias("seq"))
    wanted = asked.groupBy("task").agg(F.count("*").alias("wanted"))
    return seen.groupBy("task").agg(F.max("seq").alias("seq"), F.count("*").alias("n")).join(wanted, "task").where("n = wanted").select("task", "seq")
