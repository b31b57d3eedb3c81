"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised benchmark items
scans every text once; word positions map back to characters of the original.

A window is window_words consecutive words of an item, or all words of a shorter item. A text word
inside any occurrence of a window is hit. The benchmark is read in blocks of at most block_chars
characters, each with its own automaton, so no broadcast exceeds that bound (a longer item is cut into
pieces that share all but one of a window's words): an ordinary benchmark is one block, and further
blocks scan the same rows again, adding to their hits.

Defined results: null or empty texts have no words and no hits; items that are null or have no words
have no windows; windows of an item without an id count as hits but name no item; an item_id on
several rows counts once. Repeated rows of docs each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ALNUM, alnum_words, bound_batches, encoded, map_batches
from graphloom.session import checkpointed

_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_WORD = re.compile("[0-9A-Za-z\\x80-\\U0010FFFF]+")
_AUTOMATA: dict = {}


def windows(items: list[tuple[str | None, str | None]], window_words: int) -> dict[bytes, tuple[int, set[str]]]:
    """Window text, words joined and framed by spaces -> (number of words, ids of its items)."""
    out: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        words = alnum_words(text)
        size = min(window_words, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            _, ids = out.setdefault(b" " + b" ".join(words[k : k + size]) + b" ", (size, set()))
            if item is not None:
                ids.add(str(item))
    return out


def _automaton(key: str, found: dict[bytes, tuple[int, set[str]]]):
    """The automaton of a block, kept by a worker until it is asked for another's."""
    if key not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        automaton = ahocorasick.Automaton()
        for window, (size, ids) in found.items():
            automaton.add_word(window.decode("latin-1"), (size, ids))
        if len(automaton):
            automaton.make_automaton()
        _AUTOMATA[key] = automaton
    return _AUTOMATA[key]


def hits(automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """[first, last] words of each window's occurrence, and the ids of the items."""
    if not words or not len(automaton):
        return [], set()
    line = b" " + b" ".join(words) + b" "
    matches = list(automaton.iter(line.decode("latin-1")))
    if not matches:
        return [], set()
    order = np.cumsum(np.frombuffer(line, np.uint8) == 32)  # at the space after word k: k + 2
    spans, ids = [], set()
    for end, (size, items) in matches:
        last = int(order[end]) - 2
        spans.append((last - size + 1, last))
        ids |= items
    return spans, ids


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def characters(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as [begin, end) characters of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[first][0], at[last][1]) for first, last in spans]


def item_pieces(text: str | None, window_words: int, block_chars: int) -> list[str | None]:
    """A text, or if it is over block_chars long, pieces of it of about that size that share window_words - 1 words, so that each window is whole in one."""
    if text is None or len(text) <= block_chars:
        return [text]
    words = [m.span() for m in _WORD.finditer(text)]
    out, begin = [], 0
    while begin < len(words):
        end = begin + window_words
        while end < len(words) and words[end][1] - words[begin][0] <= block_chars:
            end += 1
        out.append(text[words[begin][0] : words[min(end, len(words)) - 1][1]])
        if end >= len(words):
            break
        begin = end - window_words + 1
    return out or [None]


def item_blocks(benchmark: DataFrame, window_words: int, block_chars: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items, long ones in pieces, in blocks of at most block_chars characters; one partition is at the driver at a time."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True)
        rows = [(i, piece) for i, t in both for piece in item_pieces(t, window_words, block_chars)]
        return pa.record_batch([pa.array([i for i, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], ["i", "t"])

    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    block, size = [], 0
    for row in map_batches(items, ["i", "t"], cut, "i string, t string").toLocalIterator():
        if block and size + len(row.t or "") > block_chars:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t or "")
    if block:
        yield block


def scanned(docs: DataFrame, benchmark: DataFrame, window_words: int, block_chars: int, keep: list[str] | None = None) -> DataFrame:
    """row (the columns of docs, or those in keep), n_words, spans (merged [first, last] words hit) and items; a pass over the rows for each block of items.

    Words are counted where they are scanned: a regular expression in the JVM takes ten times as long.
    """
    context = docs.sparkSession.sparkContext
    spans, items = F.array().cast("array<struct<first:long,last:long>>"), F.array().cast("array<string>")
    text = [F.col("text").alias("_text")] if keep else []  # with all columns, the row's own
    state = docs.select(F.struct(*(keep or ["*"])).alias("row"), *text, F.lit(0).cast("long").alias("n_words"), spans.alias("spans"), items.alias("items"))
    blocks = item_blocks(benchmark, window_words, block_chars)
    block, shared = next(blocks, []), None  # without items a pass counts the words
    while block is not None:
        if shared is not None:
            state = checkpointed(state)  # so that a worker holds one automaton at a time
            shared.destroy()
        shared, block = context.broadcast(windows(block, window_words)), next(blocks, None)
        state = _pass(state, shared, uuid.uuid4().hex, block is None)
    return state


def _pass(state: DataFrame, shared: Broadcast, key: str, last: bool) -> DataFrame:
    """state(row, n_words, spans, items and, where row has no text, _text) with the hits of a block's windows; the last pass leaves _text out."""
    apart = "_text" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared.value)
        for batch in batches:
            counts, spans, items = [], [], []
            texts = encoded(batch.column("_text") if apart else batch.column("row").field("text"))
            for text, before, named in zip(texts, batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                words = text.translate(ALNUM).split()
                more, ids = hits(automaton, words)
                both = merged([(x["first"], x["last"]) for x in before] + more)
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in both])
                items.append(sorted({*named, *ids}))
            found = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.record_batch({name: found.get(name, batch.column(name)) for name in names})

    bound_batches(state.sparkSession)
    out = state.drop("_text") if last else state
    names = out.columns
    return state.mapInArrow(run, out.schema)


def _n_hit() -> Column:
    """How many words of a scanned row are hit."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda sum, x: sum + x["last"] - x["first"] + 1)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window_words: int = 13, block_chars: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items of each row of docs(doc_id, text).

    contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = scanned(docs, benchmark, window_words, block_chars, ["doc_id"]).select("row.doc_id", "n_words", _n_hit().alias("n_hit"), "items")
    return counted.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "items",
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window_words: int = 13, block_chars: int = 2_000_000) -> DataFrame:
    """The rows of docs, with all columns, that are not contaminated."""
    rows = scanned(docs, benchmark, window_words, block_chars).withColumn("n_hit", _n_hit())
    return rows.where("n_hit = 0 OR 20 * n_hit < n_words").select("row.*")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window_words: int = 13, block_chars: int = 2_000_000) -> DataFrame:
    """doc_id, begin, end: the characters of each hit passage in the original text, for removal or review."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row, spans in zip(batch.column("row").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            doc_id, text = row["doc_id"], row["text"]
            if spans:
                out += [{"doc_id": doc_id, "begin": a, "end": b} for a, b in characters(text, [(x["first"], x["last"]) for x in spans])]
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))

    return map_batches(scanned(docs.select("doc_id", "text"), benchmark, window_words, block_chars), ["row", "spans"], run, "doc_id long, begin long, end long")
