"""Results looked up in two stages: a task's weak key leads to the path sets that runs of it recorded, a set with how its
paths are now gives a strong key, and the first set whose key has a result is the hit.

sets(weak, place, pos, kind, path): the paths of the set at pos, by what was done to them (kind), held 'here' or 'there'
(in the shared store). values(path, value): how paths are now; null for one that can't be keyed, no row for a missing one.
results(key, place): keys with a result.

Digests are trees: paths by the first digits of their own digest, so a set that holds a third of all paths is hashed in
many tasks and none holds more than a bucket of it. Repeated rows count once; null paths are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import FEW

KEPT = 8  # path sets tried for a weak key
SPREAD = 16  # tasks that one path's rows are joined in
_SET = ["weak", "place", "pos"]


def _leaf(*parts: Column) -> Column:
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.sha2(F.concat(*sized), 256)


def _root(leaves: DataFrame, keys: list[str], columns: list[str], flag: str) -> DataFrame:
    """keys and, of each column of leaf digests, the digest of the distinct ones in order: within 65,536 buckets by leaf, then 256, then all; and whether flag is true anywhere.

    Digests travel as bytes, which sort as their digits do and take half the room.
    """
    digits = lambda x: F.lower(F.hex(x))
    joined = lambda c: F.unhex(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_set(c)), digits)), 256)).alias(c)
    held = F.bool_or(flag).alias(flag)
    packed = leaves.select(*keys, flag, F.substring(digits(F.col("leaf")), 1, 4).alias("_b"), *columns)
    low = packed.groupBy(*keys, "_b").agg(*map(joined, columns), held)
    middle = low.groupBy(*keys, F.substring("_b", 1, 2).alias("_b")).agg(*map(joined, columns), held)
    return middle.groupBy(*keys).agg(*map(joined, columns), held).select(*keys, flag, *(digits(F.col(c)).alias(c) for c in columns))


def strong_keys(sets: DataFrame, values: DataFrame) -> DataFrame:
    """weak, place, pos, digest, strong of each path set: the digest of its paths, and the key with how they are now; a set with a path that can't be keyed has no key."""
    now = values.where("path IS NOT NULL").groupBy("path").agg(F.min("value").alias("value"), F.bool_or(F.col("value").isNull()).alias("unkeyed"))
    rows = sets.where("path IS NOT NULL").select(*_SET, "kind", "path")
    if now.limit(FEW + 1).count() <= FEW:
        rows = rows.join(F.broadcast(now), "path", "left")
    else:  # merged, as a plan takes values repeated SPREAD times for no more than the file they are from
        spread = now.withColumn("_s", F.explode(F.array(*map(F.lit, range(SPREAD))))).hint("merge")
        rows = rows.withColumn("_s", F.pmod(F.xxhash64(*_SET), F.lit(SPREAD)).cast("int")).join(spread, ["path", "_s"], "left")
    seen = F.when(F.col("unkeyed").isNull(), "missing").when(F.col("unkeyed"), "unkeyed").otherwise(F.concat(F.lit("="), F.col("value")))
    leaf, state = _leaf(F.col("kind"), F.col("path")), _leaf(F.col("kind"), F.col("path"), seen)
    leaves = rows.select(*_SET, F.unhex(leaf).alias("leaf"), F.unhex(state).alias("state"), F.coalesce("unkeyed", F.lit(False)).alias("unkeyed"))
    found = _root(leaves, _SET, ["leaf", "state"], "unkeyed")
    strong = F.when(~F.col("unkeyed"), _leaf(F.col("weak"), F.col("leaf"), F.col("state")))
    return found.select(*_SET, F.col("leaf").alias("digest"), strong.alias("strong"))


def tried(keys: DataFrame, kept: int = KEPT) -> DataFrame:
    """The strong_keys that a lookup tries, with turn, their place in it from 1: sets here first, then those of the store that are new, kept in all."""
    order = F.struct((F.col("place") != "here").alias("there"), "pos")
    first = keys.groupBy("weak", "digest").agg(F.min(order).alias("o"), F.max("strong").alias("strong"))
    turn = F.row_number().over(Window.partitionBy("weak").orderBy("o", "digest"))
    return first.withColumn("turn", turn).where(F.col("turn") <= kept).select("weak", F.when(F.col("o.there"), "there").otherwise("here").alias("place"), "digest", "strong", "turn")


def _places(results: DataFrame) -> DataFrame:
    return results.groupBy("key").agg(F.bool_or(F.col("place") == "here").alias("here"), F.bool_or(F.col("place") != "here").alias("there"))


def lookups(keys: DataFrame, results: DataFrame, kept: int = KEPT) -> DataFrame:
    """weak, sets, sets_here, own, local, remote: path sets tried in all and here, and the first key with a result here of a set
    here (own), of any set here (local), and, none being here, in the store (remote)."""
    found = tried(keys, kept).join(_places(results).withColumnRenamed("key", "strong"), "strong", "left")
    first = lambda where: F.min_by("strong", F.when(where, F.col("turn")))
    return found.groupBy("weak").agg(
        F.count("*").alias("sets"), F.count_if(F.col("place") == "here").alias("sets_here"),
        first(F.col("here") & (F.col("place") == "here")).alias("own"), first(F.col("here")).alias("local"), first(F.col("there")).alias("remote"),
    )


def recorded_verdicts(tasks: DataFrame, keys: DataFrame, results: DataFrame, kept: int = KEPT) -> DataFrame:
    """task, verdict, key of tasks(task, weak, mode, cold, declared, covered, unkeyable, ran): hit, declared, saved, missed, unrecorded, failed, or null.

    mode 'on' restores by recordings, 'record' only saves; cold looks nothing up; covered says that declared inputs cover what
    path sets read, so that the declared key counts beside them; ran is what became of the recording if the task had to run:
    saved, refused, unsaved, unkept or null. The store is asked unless no set is here and the declared key has a result here.
    The key is that of the result taken.
    """
    under = _places(results).select(F.col("key").alias("declared"), F.col("here").alias("_here"), F.col("there").alias("_there"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = tasks.join(lookups(keys, results, kept), "weak", "left").join(under, "declared", "left")
    on, cold = F.col("mode").eqNullSafe("on"), no("cold")
    here = F.coalesce("sets_here", F.lit(0))
    asks = (here > 0) | ~no("_here")
    had = F.when(on & ~cold & asks, F.coalesce("sets", F.lit(0))).otherwise(here) > 0
    restored = F.when(on & ~cold & ~no("unkeyable"), F.coalesce("own", F.when(asks, F.coalesce("local", "remote"))))
    rows = rows.select("task", "mode", "declared", "ran", on.alias("on"), no("unkeyable").alias("unkeyable"), had.alias("had"), restored.alias("hit"), (~cold & (no("_here") | no("_there")) & (~on | ~had | no("covered"))).alias("under"))
    ran = F.when(F.col("ran") == "saved", "saved").when(F.col("ran").isin("refused", "unsaved"), "failed").when(F.col("on"), F.when(F.col("had"), "missed").otherwise("unrecorded"))
    verdict = (
        F.when(F.col("unkeyable"), F.when(F.col("on") | ~F.col("under") & (F.col("ran") == "refused"), "failed"))
        .when(F.col("hit").isNotNull(), "hit")
        .when(F.col("under"), F.when(F.col("on"), F.when(F.col("had"), "declared").otherwise("unrecorded")))
        .otherwise(ran)
    )
    return rows.select("task", verdict.alias("verdict"), F.when(F.col("hit").isNotNull(), F.col("hit")).when(F.col("under"), F.col("declared")).alias("key"))
