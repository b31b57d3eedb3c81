"""Eviction, references and prefetching of stored results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import checkpointed


def references(entry_blobs: DataFrame, blobs: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """How many entries cite each of blobs(blob, size), 0 included; with pins(blob) also whether one of them holds it."""
    counts = entry_blobs.groupBy("blob").agg(F.countDistinct("entry").alias("entries"))
    cited = blobs.join(counts, "blob", "left").select("blob", "size", F.coalesce("entries", F.lit(0)).alias("entries"))
    if pins is None:
        return cited
    return cited.join(pins.select("blob", F.lit(True).alias("pinned")).distinct(), "blob", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank, their place in the whole order from 1, without one task that sorts them all.

    A range sort leaves each partition its share in order; ranks count on from the earlier partitions' sizes.
    """
    placed = checkpointed(rows.orderBy(*order).select("*", F.monotonically_increasing_id().alias("_at")))
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).withColumn("rank", local).join(F.broadcast(offsets), "_part").withColumn("rank", F.col("_before") + F.col("rank") + 1).select(*rows.columns, "rank")


def sums_before(rows: DataFrame, key: str, value: str, width: int = 4096, descending: bool = False) -> DataFrame:
    """rows(key, value), keys being numbers in use once, with before: the sum of earlier keys' values; sums of ranges of keys come first, so that a task orders one range or one row for each."""
    wide = rows.withColumn("_wide", F.floor(F.col(key) / width))
    order = lambda c: F.desc(c) if descending else F.asc(c)
    earlier = Window.orderBy(order("_wide")).rowsBetween(Window.unboundedPreceding, -1)
    tops = wide.groupBy("_wide").agg(F.sum(value).alias("_sum")).select("_wide", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_wide").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, -1)
    return wide.withColumn("_here", F.coalesce(F.sum(value).over(within), F.lit(0))).join(tops, "_wide").withColumn("before", F.col("_before") + F.col("_here")).drop("_wide", "_here", "_before")


def _running(rows: DataFrame, value: str, name: str, width: int = 4096) -> DataFrame:
    """rows(rank, value) with the sum up to each rank, by sums of ranges of ranks first."""
    ranges = rows.withColumn("range", F.floor((F.col("rank") - 1) / width))
    before = sums_before(ranges.groupBy("range").agg(F.sum(value).alias("total")), "range", "total").select("range", "before")
    within = Window.partitionBy("range").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranges.withColumn("here", F.sum(value).over(within)).join(before, "range").withColumn(name, F.col("before") + F.col("here")).drop("range", "here", "before")


def evictions(entries: DataFrame, entry_blobs: DataFrame, blobs: DataFrame, limit: int, unused_before: int, pins: DataFrame | None = None) -> DataFrame:
    """entry, rank, freed of the entries(entry, used, size) to evict, least recently used first.

    A blob's bytes go with the last entry citing it, those of one that pins(blob) holds with none. Over the limit, eviction stops a tenth below it; an
    entry not used since unused_before goes in any case. As entries go in order of use, what goes is a prefix.
    """
    lru = ranked(entries.select("entry", "used", "size"), "used", "entry")
    last = entry_blobs.join(lru.select("entry", "rank"), "entry").groupBy("blob").agg(F.max("rank").alias("rank"))
    going = last if pins is None else last.join(pins.select("blob"), "blob", "left_anti")
    with_last = going.join(blobs, "blob").groupBy("rank").agg(F.sum("size").alias("blob_bytes"))
    freeing = lru.join(with_last, "rank", "left").withColumn("freed", F.col("size") + F.coalesce("blob_bytes", F.lit(0)))
    cited = blobs.join(entry_blobs.select("blob").distinct(), "blob", "left_semi")
    total = (entries.agg(F.sum("size")).first()[0] or 0) + (cited.agg(F.sum("size")).first()[0] or 0)
    target = limit - limit // 10 if total > limit else limit
    running = _running(freeing, "freed", "freed_so_far")
    stays = (F.lit(total) - F.col("freed_so_far") + F.col("freed") <= target) & (F.col("used") >= unused_before)
    return running.where(~stays).select("entry", "rank", "freed")


def last_seen(listings: DataFrame) -> DataFrame:
    """The latest time of each key of listings(key, time)."""
    return listings.groupBy("key").agg(F.max("time").alias("time"))


def prefetch_order(members: DataFrame, hit: str, runs: int = 3) -> DataFrame:
    """member, place: what to fetch after a hit, of members(run, time, pos, member): the newest runs that hold it, each first what
    came after it, nearest first, then what came before, nearest first; a member's first place counts."""
    at = members.where(F.col("member") == hit).groupBy("run", "time").agg(F.min("pos").alias("at"))
    newest = at.orderBy(F.desc("time"), F.desc("run")).limit(runs)
    follows = members.drop("time").join(F.broadcast(newest), "run").where("pos <> at")
    order = F.struct((-F.col("time")).alias("time"), (-F.col("run")).alias("run"), (F.col("pos") < F.col("at")).alias("before"), F.abs(F.col("pos") - F.col("at")).alias("far"))
    first = follows.where(F.col("member") != hit).groupBy("member").agg(F.min(order).alias("order"))
    return ranked(first, "order").select("member", F.col("rank").alias("place"))


def unique_prefixes(keys: DataFrame, length: int = 16) -> DataFrame:
    """prefix, key of the keys(key) whose first `length` characters are no other's; ambiguous ones are left out."""
    return keys.select("key").distinct().groupBy(F.substring("key", 1, length).alias("prefix")).agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").select("prefix", "key")


def followed(members: DataFrame, keys: DataFrame, length: int = 16) -> DataFrame:
    """members(run, member) of the runs with the whole key each prefix names, where it names one."""
    return members.join(unique_prefixes(keys, length), members.member == F.col("prefix")).drop("prefix")


#: Fixed values of the filter's form: positions a key, and the share of false positives it is sized for.
BLOOM_KEYS, BLOOM_RATE = 7, 0.01


def bloom_bits(n: int, rate: float = BLOOM_RATE) -> int:
    """Bits of a filter of n keys: 64 at least."""
    return max(64, math.ceil(-max(1, n) * math.log(rate) / math.log(2) ** 2))


def bloom_filter(keys: DataFrame, bits: int | None = None, hashes: int = BLOOM_KEYS) -> DataFrame:
    """byte, value: the non-zero bytes of a Bloom filter of keys(key: hex digits, 32 at least), bit p in byte p div 8 at p mod 8.

    Position i is (h1 + i * h2) mod 2^64 mod bits; h1 and h2, made odd, are the first 8 bytes of the key and the next, the lowest first.
    """
    bits = bits or bloom_bits(keys.select("key").distinct().count())
    little = lambda at: F.concat(*(F.substring("key", at + 14 - 2 * k, 2) for k in range(8)))
    number = lambda at: F.conv(little(at), 16, 10).cast("decimal(38,0)")
    whole = F.lit(str(2**64)).cast("decimal(38,0)")
    h1, low = number(1), number(17)
    h2 = low + (1 - low % 2)
    at = [(((h1 + (h2 * k).cast("decimal(38,0)")) % whole).cast("decimal(38,0)") % bits).cast("long") for k in range(hashes)]
    positions = keys.select("key").distinct().select(F.explode(F.array(*at)).alias("p")).distinct()
    bytes_ = positions.groupBy(F.floor(F.col("p") / 8).alias("byte")).agg(F.sum(F.pow(F.lit(2.0), F.col("p") % 8)).alias("value"))
    return bytes_.select(F.col("byte").cast("long").alias("byte"), F.col("value").cast("long").alias("value"))


def warm_choice(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """task, record of records(task, record, key, worktree, portable, behind, started) to start each of wanted(task, key, worktree) from: the best key match
    (equal, then a beginning), then its own worktree (others if portable), then the fewest commits behind (null last), then the newest."""
    from graphloom.operators.verdicts import key_match

    rows = records.join(wanted.select("task", F.col("key").alias("current"), F.col("worktree").alias("own")), "task")
    quality = key_match(F.col("current"), F.col("key"))
    other = F.col("worktree") != F.col("own")
    rank = F.struct(quality.alias("quality"), other.alias("other"), F.col("behind").isNull().alias("unknown"), "behind", (-F.col("started")).alias("age"), "record")
    fit = rows.withColumn("rank", rank).where(F.col("rank.quality").isNotNull() & (~F.col("rank.other") | F.col("portable")))
    return fit.groupBy("task").agg(F.min("rank").alias("rank")).select("task", "rank.record")
