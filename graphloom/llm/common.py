"""What several operators share: bounded Arrow batches, words of a text, 64-bit word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import checkpointed, importable

#: Rows of an Arrow batch; texts of 100 kB then make 25 MB.
BATCH_ROWS = 256
#: A-Z to a-z, everything else as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes hashed at a time.
HASH_BYTES = 1 << 20

#: A key with more rows than HOT doesn't meet its rows in one task; up to FEW such keys are broadcast.
HOT, FEW = 2048, 100_000

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def map_batches(df: DataFrame, columns: list[str], function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """df.select(columns) through a function of record batches of at most BATCH_ROWS rows."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return df.select(*columns).mapInArrow(run, schema)


def filter_batches(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of df, with all their columns, whose place in keep(batch) is true."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def bound_batches(spark: SparkSession) -> None:
    """From now on Arrow batches hold at most BATCH_ROWS rows, so that very long texts fit a worker's memory."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def alnum_words(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _PRIME), ("down", np.uint64(pow(int(_PRIME), -1, 1 << 64)))):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _POWERS[key] = np.multiply.accumulate(powers)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def hash_words(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, in order, without a Python loop over words."""
    if not raw:
        return np.empty(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grouped_hashes(raws: list[bytes]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first index, word hashes of each text) for runs of texts; a text over HASH_BYTES is hashed in pieces cut at white space."""
    start = 0
    while start < len(raws):
        end, size = start, 0
        while end < len(raws) and (end == start or size + len(raws[end]) < HASH_BYTES):
            size += len(raws[end]) + 1
            end += 1
        if size > HASH_BYTES:
            yield start, [np.concatenate([hash_words(piece) for piece in pieces(raws[start])])]
        else:
            hashes = hash_words(b" ".join(raws[start:end]))
            counts = [len(raw.split()) for raw in raws[start:end]]
            yield start, np.split(hashes, np.cumsum(counts)[:-1])
        start = end


def pieces(raw: bytes) -> Iterator[bytes]:
    """raw cut at white space into pieces of about HASH_BYTES; a longer word stays whole."""
    at = 0
    while at < len(raw):
        end = at + HASH_BYTES
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield raw[at:end]
        at = end


def encoded(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def join_hot(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows.join(lookup, keys, how) for a lookup of one row a key, whose column weight (dropped) is about how many of rows have the key; how is inner or left.

    Keys of over HOT rows are broadcast, the others joined by shuffle. Should over FEW keys be hot, all are
    joined by shuffle and adaptive execution splits what is skewed.
    """
    hot = lookup.where(F.col(weight) > HOT)
    if not 0 < hot.limit(FEW + 1).count() <= FEW:
        return rows.join(lookup.drop(weight), keys, how)
    cold = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(lookup.where(F.col(weight) <= HOT).drop(weight), keys, how)
    return rows.join(F.broadcast(hot.drop(weight)), keys).unionByName(cold)


def with_few(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """rows.join(lookup, keys, "left") for a lookup that is small as a rule: broadcast if it is (FEW rows), joined by shuffle if not."""
    return rows.join(F.broadcast(lookup) if lookup.limit(FEW + 1).count() <= FEW else lookup, keys, "left")


def join_spread(rows: DataFrame, lookup: DataFrame, key: str, other: str) -> DataFrame:
    """rows.join(lookup, key) for a lookup of one row a key: a key that over HOT rows have meets them in as many tasks as that takes, dealt by a hash of their column other."""
    hot = checkpointed(rows.groupBy(key).agg(F.ceil(F.count("*") / HOT).cast("int").alias("salts")).where("salts > 1"))
    salted = lambda df: with_few(df, hot, [key]).withColumn("salts", F.coalesce("salts", F.lit(1)))
    copies = salted(lookup).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return salted(rows).withColumn("salt", F.pmod(F.xxhash64(other), "salts").cast("int")).drop("salts").join(copies, [key, "salt"]).drop("salt")
