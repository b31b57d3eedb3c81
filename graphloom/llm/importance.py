"""Importance resampling towards a target distribution: bags of hashed word runs of the corpus and of the target
give every bucket a gain; a text's weight is the sum of its runs' gains, and Gumbel noise by doc_id turns the
highest scores into a weighted draw without replacement.

Identical texts are collapsed by grouping on the whole text; each distinct one is featurised and weighed once, its counts
multiplied by its copies, and weights join back to the documents by digest before the noise of each is added.

Defined results: a null text is empty and has no features, so it weighs 0. A null doc_id has the noise of the empty
string and comes last among ties. Rows that share a doc_id share its noise, and each counts, is ranked and returned. Texts are
read whole, the longest in pieces. Other columns are ignored. An empty target leaves the gains of an empty count; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ALNUM, bound_batches, encoded, join_hot, map_batches, pieces
from graphloom.operators.storage import ranked
from graphloom.session import checkpointed

#: Longest run of words that is a feature, buckets, seed of the noise, share drawn in percent, fewest words of a drawn document.
LONGEST, BUCKETS, SEED, PERCENT, MIN_WORDS = 1, 10_000, 2024, 10, 20
#: Runs whose buckets a worker remembers.
REMEMBERED = 1_000_000


class _Buckets(dict):
    """Run of words -> its bucket, worked out when first asked for."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, run: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[run] = zlib.crc32(run) % self.buckets
        return found


def bag(raw: bytes, longest: int, known: _Buckets) -> tuple[int, np.ndarray]:
    """(number of words, buckets of all runs of 1 to longest words) of a UTF-8 text."""
    n, found, carried = 0, [], []
    for piece in pieces(raw.translate(ALNUM)):
        words = piece.split()
        n += len(words)
        found.append(np.fromiter((known[w] for w in words), np.int32, len(words)))
        joined = carried + words
        for size in range(2, longest + 1):
            skip = max(0, len(carried) - size + 1)  # runs that end before this piece are counted already
            runs = [b" ".join(joined[k : k + size]) for k in range(skip, len(joined) - size + 1)]
            found.append(np.fromiter((known[r] for r in runs), np.int32, len(runs)))
        carried = joined[max(0, len(joined) - longest + 1) :] if longest > 1 else []
    return n, np.concatenate(found) if found else np.empty(0, np.int32)


def featurise(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """digest, copies, n_words and the buckets of every distinct text of texts(text, ...), written to the checkpoint folder."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            raws = encoded(batch.column("text"))
            bags = [bag(raw, longest, known) for raw in raws]
            digests = pa.array([hashlib.sha256(raw).digest() for raw in raws], pa.binary())
            held = pa.array([b.astype(kind).tobytes() for _, b in bags], pa.binary())
            yield pa.RecordBatch.from_arrays([digests, batch.column("copies"), pa.array([n for n, _ in bags], pa.int64()), held], ["digest", "copies", "n_words", "buckets"])

    bound_batches(texts.sparkSession)
    distinct = texts.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    return checkpointed(distinct.mapInArrow(run, "digest binary, copies long, n_words long, buckets binary"))


def counts(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all documents: tasks add up arrays of buckets numbers, Spark sums them, and only those come to the driver."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for held, copies in zip(batch.column("buckets").to_pylist(), batch.column("copies").to_pylist(), strict=True):
                places, n = np.unique(np.frombuffer(held, kind), return_counts=True)
                sums[places] += n * copies
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], ["bucket", "n"])

    total = np.zeros(buckets, np.int64)
    for row in featured.select("copies", "buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the log ratio of its smoothed shares of target and source, rounded down."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda a, b: float((b + 1) * (s + n)) / float((a + 1) * (t + n))
    return np.array([math.floor(1000 * math.log(ratio(int(a), int(b)))) for a, b in zip(source, target, strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the digest of seed and doc_id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null if not drawn) of every document of docs, drawn towards the texts of target(text, ...).

    Of the documents with at least min_words words, percent in the hundred are drawn, rounded down.
    """
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    featured = featurise(docs, longest, buckets)
    gain = gains(counts(featured, buckets), counts(featurise(target, longest, buckets), buckets))

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [np.frombuffer(x, kind) for x in batch.column("buckets").to_pylist()]
        sizes, weights = pa.array([len(x) for x in held], pa.int64()), pa.array([int(gain[x].sum()) for x in held], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("copies"), batch.column("n_words"), sizes, weights], ["digest", "copies", "n_words", "n_features", "weight"])

    weights = checkpointed(map_batches(featured, ["digest", "copies", "n_words", "buckets"], weigh, "digest binary, copies long, n_words long, n_features long, weight long"))
    mine = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    joined = join_hot(mine, weights, ["digest"], "copies").drop("digest")
    scored = checkpointed(joined.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = scored.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    placed = ranked(able, F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "n_words")
    unable = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")).unionByName(unable)
