"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash of doc_id. A target of r times the source takes every
block floor(r) times and, for the rest, further blocks in order up to the very word: the last block's
documents are taken in hash order and its last document in part. Those block quotas are split over the
output shards by a binary tree: each node draws, without replacement, how many blocks of each source go
left. A shard's way down the tree is seeded by the nodes alone, so every shard works out its own exact
quotas, and which permuted blocks they are, without any other. Within a shard rows follow a hash.

Defined results: a null or empty text has size 0 and is never taken from; null sources are one source,
ordered last. Repeated rows count as often as they occur. No rows give no rows; sources of size 0 have
target 0. Other columns are ignored. At most MAX_SOURCES sources are accepted (ValueError beyond): a mix
names a weight for each, and these, not the documents, are what the driver holds.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.llm.common import bound_batches, map_batches
from graphloom.llm.common import mix as scramble
from graphloom.session import checkpointed

MAX_SOURCES = 100_000
#: Documents of a block on average; blocks of a prefix-sum group.
BLOCK_DOCS, GROUP_BLOCKS = 256, 1024
#: Rounds of the network that permutes a source's blocks.
ROUNDS = 6
#: Fixed value: the words of a text.
WORDS = "[^\\x20\\x09-\\x0D]+"
_WORD = re.compile(WORDS)


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """share of all sizes dealt by weight; a target stops at most times its source, the excess is dealt again."""
    out, left = [0.0] * len(sizes), share * sum(sizes)
    waiting = set(range(len(sizes)))
    while waiting:
        weight = sum(weights[k] for k in sorted(waiting))
        full = [k for k in sorted(waiting) if left * weights[k] / weight > most * sizes[k]]
        if not full:
            for k in waiting:
                out[k] = left * weights[k] / weight
            break
        for k in full:
            out[k] = most * sizes[k]
        left -= sum(out[k] for k in full)
        waiting -= set(full)
    return out


def shard_quotas(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of the blocks of each source, in its permuted order, that go to one shard of a power of two."""
    first, number = np.zeros_like(quotas), quotas.copy()
    total, low, high = int(quotas.sum()), 0, shards
    room = lambda a, b: (b - a) * (total // shards) + max(0, min(b, total % shards) - a)
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(number, room(low, middle), method="marginals")
        if shard < middle:
            number, high = left, middle
        else:
            first, number, low = first + left, number - left, middle
    return first, number


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The values at some places of a seeded random permutation of range(n): a Feistel network over the least square of a power of two that holds n, walked until inside."""
    half = np.uint64(max(1, -(-(max(n, 2) - 1).bit_length() // 2)))
    low = np.uint64((1 << int(half)) - 1)
    keys = scramble(np.arange(1, ROUNDS + 1, dtype=np.uint64) + scramble(np.array([seed], np.uint64)))
    out, walking = np.asarray(index, np.uint64).copy(), np.arange(len(index))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & low
        for key in keys:
            left, right = right, left ^ (scramble(right + key) & low)
        out[walking] = left << half | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    shard_words: int = 20_000_000,
    least_shards: int = 16,
    seed: int = 42,
) -> DataFrame:
    """doc_id, size, source_size, target, taken and draws of each row of docs(doc_id, text, source).

    draws: epoch, shard, block, place (the order within a shard) and words of each time the document is taken,
    as the shards draw its block; taken is the sum of their words. Sources in code-point order take the weights
    in turn, over and over. There is a shard, in a power of two, for each shard_words, and least_shards at least.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long")
    sized = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"a mix of over {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    found = targets([r.words for r in totals], [weights[k % len(weights)] for k in range(len(totals))], share, most)
    sources = []
    block_docs = max(BLOCK_DOCS, sum(r.docs for r in totals) // 400_000_000)
    for k, (r, target) in enumerate(zip(totals, found, strict=True)):
        whole = int(target // r.words) if r.words else 0
        sources.append((k, r.source, r.words, target, -(-r.docs // block_docs), whole, int(math.floor(target)) - whole * r.words))
    plan = spark.createDataFrame(sources, "number int, source string, source_size long, target double, blocks long, epochs int, rest long")
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), "blocks")
    placed = sized.join(F.broadcast(plan), sized.source.eqNullSafe(plan.source)).select("doc_id", "size", "number", block.alias("block"))
    blocks = checkpointed(_with_words_before(placed.groupBy("number", "block").agg(F.sum("size").alias("words"))))
    partly = {r.number: r.n for r in blocks.join(F.broadcast(plan), "number").where("before < rest").groupBy("number").agg((F.max("block") + 1).alias("n")).collect()}
    quotas = [epochs * n + partly.get(k, 0) for k, _, _, _, n, epochs, _ in sources]
    shards = 1 << math.ceil(math.log2(max(1.0, least_shards, sum(found) / shard_words)))
    dealt = _deal(spark, [(n, epochs) for _, _, _, _, n, epochs, _ in sources], quotas, shards, seed)
    per_block = blocks.join(dealt, ["number", "block"])
    drawn = placed.join(per_block, ["number", "block"], "left").join(F.broadcast(plan.drop("source")), "number")
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    in_order = Window.partitionBy("number", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "size", "source_size", "target", "epochs", "rest", "block", "shards", "part"]
    sure = drawn.where(~F.coalesce(cut, F.lit(False))).withColumn("part", F.when(F.col("before") < F.col("rest"), F.col("size")).otherwise(0)).select(columns)
    earlier = F.col("before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    torn = drawn.where(cut).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - earlier))).select(columns)
    words = lambda x: F.when(x["epoch"] < F.col("epochs"), F.col("size")).otherwise(F.col("part")).cast("long")
    place = lambda x: F.xxhash64("doc_id", x["epoch"], x["shard"], F.lit(seed))
    draws = F.transform("shards", lambda x: F.struct(x["epoch"].alias("epoch"), x["shard"].alias("shard"), F.col("block").alias("block"), place(x).alias("place"), words(x).alias("words")))
    rows = sure.unionByName(torn).withColumn("draws", F.coalesce(F.filter(draws, lambda x: x["words"] > 0), F.array().cast(DRAWS)))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


DRAWS = T.ArrayType(T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("place", T.LongType()), T.StructField("words", T.LongType())]))


def _with_words_before(blocks: DataFrame) -> DataFrame:
    """blocks(number, block, words) with before: the words of the source's earlier blocks, by sums of groups of blocks first."""
    grouped = blocks.withColumn("run", F.floor(F.col("block") / GROUP_BLOCKS))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = grouped.groupBy("number", "run").agg(F.sum("words").alias("run_words"))
    runs = runs.withColumn("run_before", F.coalesce(F.sum("run_words").over(earlier("number", "run")), F.lit(0)))
    within = grouped.withColumn("in_run", F.coalesce(F.sum("words").over(earlier("number", "run", "block")), F.lit(0)))
    return within.join(runs.drop("run_words"), ["number", "run"]).select("number", "block", "words", (F.col("run_before") + F.col("in_run")).alias("before"))


def _deal(spark, sources: list[tuple[int, int]], quotas: list[int], shards: int, seed: int) -> DataFrame:
    """number, block and shards (epoch, shard) of every block that is taken."""
    vector = np.array(quotas, np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                first, number = shard_quotas(vector, shards, int(shard), seed)
                for k in np.flatnonzero(number):
                    n, epochs = sources[k]
                    place = permuted(np.arange(first[k], first[k] + number[k]), int(vector[k]), seed + int(k))
                    yield pd.DataFrame({"number": np.int32(k), "block": place % n, "epoch": (place // n).astype(np.int32), "shard": np.int32(shard)})

    parts = min(shards, spark.sparkContext.defaultParallelism * 4)
    rows = spark.range(0, shards, 1, parts).mapInPandas(run, "number int, block long, epoch int, shard int")
    return rows.groupBy("number", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("shards"))


def shard_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """shard, place, doc_id, words and text, a row for each draw, each shard in its shuffled order; the text of a part is cut after its words."""
    draws = mixed.select("doc_id", F.explode("draws").alias("draw")).select("doc_id", "draw.*")
    rows = draws.join(docs.select("doc_id", "text"), "doc_id").select("shard", "place", "doc_id", "words", "text")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, n in zip(batch.column("text").to_pylist(), batch.column("words").to_pylist(), strict=True):
            ends = itertools.islice(_WORD.finditer(text or ""), n - 1, n + 1)
            last, more = next(ends, None), next(ends, None)
            texts.append(text if more is None else text[: last.end()])
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    rows = map_batches(rows, rows.columns, cut, "shard int, place long, doc_id long, words long, text string")
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place").select("shard", "place", "doc_id", "words", "text")
