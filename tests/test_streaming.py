"""Output torn over chunks, and the streaming forms against their batch forms over several micro-batches and a restart."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.streaming import output_text, states, watch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PIECES = ["\x1b", "[", "]", "\\", "\x07", "m", "3", "é", "\n", "P", "re", "ady"]


def by_characters(text: str) -> str:
    """What is shown of a whole text, a character at a time."""
    out, k = [], 0
    while k < len(text):
        if text[k] != "\x1b":
            out.append(text[k])
            k += 1
        elif text[k + 1 : k + 2] == "[":
            k += 2
            while k < len(text) and not "@" <= text[k] <= "~":
                k += 1
            k += 1
        elif text[k + 1 : k + 2] and text[k + 1] in "]PX^_":
            k += 2
            while k < len(text) and text[k] != "\x07" and text[k : k + 2] != "\x1b\\":
                k += 2 if text[k] == "\x1b" else 1
            k += 1 if text[k : k + 1] == "\x07" else 2
        else:
            k += 2
    return "".join(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=6).map("".join), max_size=8))
def test_chunks_show_what_the_whole_text_shows(chunks):
    out, begun = "", ""
    for chunk in chunks:
        new, begun = output_text.shown(chunk, begun)
        assert begun in output_text.OPEN
        out += new
    assert out == by_characters("".join(chunks))


def test_long_unended_sequences_take_linear_time():
    assert output_text.shown("\x1b]" + "a\x1bb" * 400_000) == ("", "\x1b]")
    assert output_text.shown("\x1b[" + "1;" * 400_000) == ("", "\x1b[")
    assert output_text.shown("x" + "\x1b" * 400_001) == ("x", "\x1b")


def ready_by_hand(chunks, patterns):
    found = {}
    for task in {t for t, _ in patterns}:
        texts, pending = {}, {p for t, p in patterns if t == task}
        for _, stream, seq, text in sorted((c for c in chunks if c[0] == task), key=lambda c: (c[2], c[1], c[3])):
            texts[stream] = texts.get(stream, "") + text
            pending = {p for p in pending if p not in by_characters(texts[stream])}
            if not pending:
                found[task] = seq
                break
    return found


CHUNKS = "task string, stream string, seq long, text string"
PATTERNS = "task string, pattern string"


def random_output(seed: int):
    r = random.Random(seed)
    chunks = [(f"t{t}", r.choice("oe"), k, "".join(r.choices(PIECES + ["ready", "li", "sten"], k=r.randrange(4)))) for t in range(12) for k in range(40)]
    return chunks, [(f"t{t}", p) for t in range(12) for p in ("ready", "listen")[: 1 + t % 2]]


def test_readiness_of_torn_sequences_and_chunks_of_codes(spark):
    chunks = [("a", "o", k, x) for k, x in enumerate(["l", *["\x1b[1m"] * 9, "istening"])]
    chunks += [("b", "o", 0, "lis\x1b["), ("b", "o", 1, "0mtening"), ("c", "o", 0, "listen"), ("c", "e", 1, "ing"), ("d", "o", 0, "\x1b]0;listening\x07")]
    chunks += [("e", "o", 0, None), ("e", "o", None, "listening"), ("f", "o", 7, ""), ("g", "o", 700, "listening")]
    patterns = [(t, "listening") for t in "abcdeg"] + [("f", ""), ("a", None), ("a", "listening")]
    found = output_text.readiness(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(patterns, PATTERNS), 4)
    assert sorted(tuple(r) for r in found.collect()) == [("a", 10), ("b", 1), ("f", 7), ("g", 700)]
    none = spark.createDataFrame([], CHUNKS)
    assert output_text.readiness(none, spark.createDataFrame(patterns, PATTERNS)).count() == 0
    assert output_text.readiness(none, spark.createDataFrame([], PATTERNS)).count() == 0


@pytest.mark.parametrize("width", [1, 7, 256])
def test_readiness_by_ranges_is_readiness_by_hand(spark, width):
    chunks, patterns = random_output(5)
    found = output_text.readiness(spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(patterns, PATTERNS), width)
    assert {r.task: r.seq for r in found.collect()} == ready_by_hand(chunks, patterns)


def streamed(spark, folder, frame, order, form, parts=2, seconds=None):
    """Rows of form over the frame as a stream: micro-batches in order, a restart between them; a query without an end is stopped after some seconds."""
    rows = frame.orderBy(order).collect()
    step, source = -(-len(rows) // parts), f"{folder}/in"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for k in range(parts):
            spark.createDataFrame(rows[k * step : (k + 1) * step], frame.schema).repartition(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(frame.schema).parquet(source)
            writer = form(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
            query = writer.trigger(processingTime="1 second").start() if seconds else writer.trigger(availableNow=True).start()
            query.awaitTermination(seconds or 240)
            query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()]


def test_carried_stream_is_the_batch_form_less_what_never_loads(spark, tmp_path):
    r = random.Random(1)
    rows = [(w, 10 * k + w, [f"p{r.randrange(5)}" for _ in range(r.randrange(3))], r.random() < 0.4) for k in range(20) for w in (1, 2, 3)]
    frame = spark.createDataFrame(rows, "watcher long, first long, paths array<string>, loaded boolean")
    wanted = sorted((w, f, tuple(p), n, ok) for w, f, p, n, ok in watch.carried_batches(frame).select("watcher", "first", "paths", "loads", "loaded").collect() if ok)
    found = streamed(spark, tmp_path, frame, "first", states.carried_stream)
    assert sorted((w, f, tuple(p), n, ok) for w, f, p, n, ok in found) == wanted


def test_first_accesses_stream_is_the_batch_form(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"t{k % 4}", f"/p{r.randrange(12 if k % 4 else 4)}", r.choice(["read", "write"]), "ok", k) for k in range(240)]
    frame = spark.createDataFrame(rows, "task string, path string, operation string, result string, seq long")
    kept, over = watch.first_accesses(frame, 10)
    found = streamed(spark, tmp_path, frame, "seq", lambda s: states.first_accesses_stream(s, 10))
    assert sorted(x[:5] for x in found if not x[5]) == sorted(tuple(x) for x in kept.select("task", "path", "operation", "result", "seq").collect())
    assert sorted(x[0] for x in found if x[5]) == sorted(x.task for x in over.collect()) == ["t1", "t2", "t3"]


def test_state_is_forgotten_when_idle(spark, tmp_path):
    frame = spark.createDataFrame([("t", "/a", "read", "ok", 1), ("t", "/a", "read", "ok", 2)], "task string, path string, operation string, result string, seq long")
    assert sorted(x[4] for x in streamed(spark, tmp_path, frame, "seq", lambda s: states.first_accesses_stream(s, 10, idle=1), seconds=20)) == [1, 2]


def test_readiness_stream_is_the_batch_form(spark, tmp_path):
    chunks, patterns = random_output(9)
    frame, asked = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(patterns, PATTERNS)
    found = streamed(spark, tmp_path, frame, "seq", lambda s: states.readiness_stream(s, asked))
    assert dict(found) == ready_by_hand(chunks, patterns) and len(found) == len(dict(found))
