"""What a chain of filters removes in every order: each document's failures are a bit mask, a precomputed table
(masks by orders) gives the step that removes it first, and counts by part, order and step are summed.

The five filters, in the letters of NAMES: A too few words, B too few distinct words, C too many capitals,
D holds a symbol, E identical to the text of a smaller doc_id anywhere in the table. Tasks add up arrays of
one place per order and step for each part; Spark sums those.

Defined results: a null text is empty, so null and empty texts are copies of each other; a null lang is the
empty part. Rows without a doc_id are no copies, nor are others copies of theirs. Rows that share a doc_id and a
text are no copies of each other, but each counts. A doc_id that labels holds several times has a label if any of its
rows does. Texts are read whole, the longest in pieces. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches, encoded, join_hot, map_batches, pieces
from graphloom.session import checkpointed

NAMES = "ABCDE"
#: Fewest words, least share of distinct words in percent, greatest share of capitals in percent, symbols.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "#$%&*|"
#: Parts whose sums a task holds before it passes them on.
HELD_PARTS = 256
_CAPITALS = bytes(range(65, 91))


def first_failures(n: int) -> np.ndarray:
    """Table of masks by orders (in the order of permutations): the step from 0 at which the first failing filter stands, n if none fails."""
    orders = np.array(list(permutations(range(n))))
    fails = (np.arange(1 << n)[:, None, None] >> orders[None]) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), n)


def text_failures(raw: bytes, min_words: int, distinct_percent: int, capital_percent: int, symbols: str) -> int:
    """Which of the filters A to D a text fails, as bits from the lowest."""
    n, distinct = 0, set()
    for piece in pieces(raw):
        words = piece.split()
        n += len(words)
        distinct.update(words)
    points = len(raw) - int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    symbol = re.search(b"[" + re.escape(symbols.encode()) + b"]", raw) is not None if symbols else False
    return (n < min_words) | (100 * len(distinct) < distinct_percent * n) << 1 | (100 * capitals > capital_percent * points) << 2 | symbol << 3


def failures(docs: DataFrame, part: Column, min_words: int = MIN_WORDS, distinct_percent: int = DISTINCT_PERCENT, capital_percent: int = CAPITAL_PERCENT, symbols: str = SYMBOLS) -> DataFrame:
    """doc_id, part, mask of the filters it fails, n rows, for the documents of docs(doc_id, text, ...).

    Texts leave as digests. Rows alike are counted before they meet others, and a group of copies meets its smallest doc_id by
    broadcast if it is large.
    """

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = encoded(batch.column("text"))
        masks = [text_failures(raw, min_words, distinct_percent, capital_percent, symbols) for raw in raws]
        digests = [hashlib.sha256(raw).digest() for raw in raws]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    named = docs.select("doc_id", "text", F.coalesce(part, F.lit("")).alias("part"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary"
    judged = checkpointed(map_batches(named, ["doc_id", "part", "text"], judge, schema).groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")))
    groups = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("size"))
    copied = checkpointed(groups.where("first < last").drop("last"))
    placed = join_hot(judged, copied, ["digest"], "size", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return placed.groupBy("doc_id", "part", F.col("mask").bitwiseOR(F.shiftleft(copy, 4)).alias("mask")).agg(F.sum("n").alias("n"))


def labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """failed with good and toxic, from labels(doc_id, quality, toxic)."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    found = failed.select("doc_id", "part", "mask", "n").join(known, "doc_id", "left")
    return found.withColumn("good", F.coalesce("good", F.lit(False))).withColumn("toxic", F.coalesce("toxic", F.lit(False)))


def audit(rows: DataFrame, names: str = NAMES) -> DataFrame:
    """part, filter_order, step and its counts, for each part of rows(part, mask, n, good, toxic) and every order of the filters named (a letter for each bit of mask)."""
    bound_batches(rows.sparkSession)
    table, orders = first_failures(len(names)), list(permutations(range(len(names))))
    steps = len(names) + 1
    places = len(orders) * steps

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            masks = batch.column("mask").to_numpy(zero_copy_only=False)
            code = np.asarray(parts.indices)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            at = ((code[:, None] * len(orders) + np.arange(len(orders))) * steps + table[masks]).ravel()
            weights = [n] + [n * batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic")]
            sums = [np.bincount(at, np.repeat(w, len(orders)), len(parts.dictionary) * places).astype(np.int64).reshape(-1, places) for w in weights]
            seen = np.bincount(code * len(table) + masks, n, len(parts.dictionary) * len(table)).astype(np.int64).reshape(-1, len(table))
            for k, part in enumerate(parts.dictionary.to_pylist()):
                found = np.zeros((3, places + len(table)), np.int64)
                found[:, :places] = [s[k] for s in sums]
                found[0, places:] = seen[k]
                held[part] = held[part] + found if part in held else found
            if len(held) > HELD_PARTS:
                yield from arrays(held)
                held = {}
        yield from arrays(held)

    def arrays(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, found in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part] * found.shape[1]), pa.array(np.arange(found.shape[1], dtype=np.int32)), *map(pa.array, found)], ["part", "place", "n", "good", "toxic"])

    def report(found: pd.DataFrame) -> pd.DataFrame:
        """One part's sums, a fixed number of rows, as the counts of each order and step."""
        sums = np.zeros((3, places + len(table)), np.int64)
        sums[:, found["place"]] = found[["n", "good", "toxic"]].to_numpy().T
        removed, good, toxic = sums[:, :places].reshape(3, len(orders), steps)[:, :, :-1]
        masks, bits = sums[0, places:], np.arange(len(names))
        fails = (masks[:, None] * (np.arange(len(table))[:, None] >> bits & 1)).sum(axis=0)
        letter = np.array(orders)
        shares = np.bincount(letter.ravel(), removed.ravel(), len(names)).astype(np.int64)
        return pd.DataFrame(
            {
                "part": found["part"].iloc[0],
                "filter_order": np.repeat(["".join(names[f] for f in order) for order in orders], len(names)),
                "step": np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(orders)),
                "kept": (masks.sum() - removed.cumsum(axis=1)).ravel(),
                "removed": removed.ravel(),
                "redundant": (fails[letter] - removed).ravel(),
                "unique_fails": masks[1 << bits][letter].ravel(),
                "good_lost": good.ravel(),
                "toxic_lost": toxic.ravel(),
                "shapley": shares[letter].ravel(),
            }
        )

    partial = rows.select("part", "mask", "n", "good", "toxic").mapInArrow(add_up, "part string, place int, n long, good long, toxic long")
    summed = partial.groupBy("part", "place").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    counts = "kept redundant removed unique_fails good_lost toxic_lost shapley".split()
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return summed.groupBy("part").applyInPandas(report, schema).select("part", "filter_order", "step", *counts)
