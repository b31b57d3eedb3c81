"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

A vector is rotated at random; the signs of what comes out are its code, and the inner product of the rotated
vector and its code is stored as its correction factor. Another vector, rotated alike, times the code and
divided by the factor estimates their cosine without bias; its deviation is known, so pairs whose upper
confidence bound is below the threshold are dropped and the others are recomputed exactly in double precision.
Before that the bits alone are compared: the share of unequal ones estimates the angle.

Near vectors meet in hash tables, whose keys are the largest coordinates after further rotations, as many tables
as a pair at the threshold needs to meet with RECALL. Tight groups never list their pairs: a vector joins a
ball around the first vector of a bucket it surely links with, all members of a ball of less than half the
threshold's angle link, and only balls that meet in a table are compared, by their centres first: two balls
so near that all members link are counted as wholes, ones so far that none do are dropped, the rest are
compared by member. What is listed are pairs of balls that meet and may hold a link; members are counted.

Defined results: null, zero and empty vectors, and ones with null or non-finite components, link with
nothing and are their own component. Vectors of different lengths don't link. Repeated rows are vectors of
their own, linked with each other; exact copies are one class until the end. Rows of a null vec_id link as
others do and have no component of their own id. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches, join_hot, join_spread, with_few
from graphloom.llm.components import smallest_reachable
from graphloom.session import checkpointed

#: Chance that a pair at the threshold meets in a table; deviations a confidence bound allows.
RECALL, DEVIATIONS = 0.999, 5.0
#: Bits of a code at least; bits of it that are compared first; rows of a block of a bucket or of a pair of balls.
CODE_BITS, KEPT_BITS, BLOCK = 256, 128, 1024
#: Degrees taken off every bound for rounding.
SLACK = 1e-4
#: Where the rotations of the codes begin among all seeds.
CODES = 100_000


@lru_cache(maxsize=128)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).T.astype(np.float32)


def turned(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Unit vectors after the rotations of a code, as many as give CODE_BITS coordinates, one after the other."""
    dim = vectors.shape[1]
    return np.concatenate([vectors.astype(np.float32) @ rotation(dim, seed + CODES + k) for k in range(-(-CODE_BITS // dim))], axis=1)


def codes(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(sign bits, correction factor: the sum over rotations of the inner products of rotated vector and code) of unit vectors."""
    coordinates = turned(vectors, seed)
    return coordinates > 0, np.abs(coordinates).sum(axis=1, dtype=float) / math.sqrt(vectors.shape[1])


def estimates(vectors: np.ndarray, signs: np.ndarray, factor: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(unbiased estimates of the cosine of unit vectors and those with signs and factor, row by row; their deviation as a multiple of the sine).

    The rotated vector is cosine times the other's plus a part at right angles to it, whose product with
    the code has mean 0 and, over all its directions, a variance of one less the squared inner product, over dim - 1.
    """
    dim = vectors.shape[1]
    rotations = signs.shape[1] // dim
    value = np.where(signs, 1.0, -1.0)
    value *= turned(vectors, seed)
    each = factor / rotations
    spread = np.sqrt(rotations * np.maximum(0.0, 1 - each**2) / max(1, dim - 1)) / factor
    return value.sum(axis=1) / math.sqrt(dim) / factor, spread


def shape(n: int, dim: int) -> list[int]:
    """Coordinates that each part of a key looks at, so that about eight of n random vectors share a key: a part tells 2 * coordinates values."""
    bits, whole = max(3.0, math.log2(max(2, n) / 8)), 1 + math.log2(dim)
    parts = [dim] * int(bits / whole)
    rest = bits - len(parts) * whole
    return parts + [max(1, min(dim, round(2 ** (rest - 1))))] * (rest >= 0.5 or not parts)


@lru_cache(maxsize=256)
def meets(dim: int, coordinates: int, cosine: float) -> float:
    """The chance, by simulation and less three deviations, that two unit vectors have the same largest of so many coordinates."""
    rng, n = np.random.default_rng([dim, coordinates]), max(2000, min(20_000, 4_000_000 // dim))
    x, y = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= np.einsum("ij,ij->i", x, y)[:, None] * x
    y = cosine * x + (math.sqrt(max(0.0, 1 - cosine**2)) * y / np.maximum(np.linalg.norm(y, axis=1), 1e-300)[:, None] if dim > 1 else 0)
    share = float((_largest(x[:, :coordinates]) == _largest(y[:, :coordinates])).mean())
    return max(0.01, share - 3 * math.sqrt(share * (1 - share) / n))


def tables(n: int, dim: int, cosine: float) -> int:
    """Tables in which a pair at a cosine meets at least once with RECALL."""
    same = math.prod(meets(dim, coordinates, cosine) for coordinates in shape(n, dim))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - min(same, RECALL)))


def _largest(coordinates: np.ndarray) -> np.ndarray:
    """Which coordinate is the largest in size, and its sign, as one number for each row."""
    at = np.abs(coordinates).argmax(axis=1)
    return 2 * at + (coordinates[np.arange(len(at)), at] > 0)


def keys(vectors: np.ndarray, parts: list[int], n_tables: int, seed: int) -> np.ndarray:
    """A row of n_tables keys for each unit vector."""
    dim, out = vectors.shape[1], np.zeros((len(vectors), n_tables), np.int64)
    rows = vectors.astype(np.float32)
    for table in range(n_tables):
        for k, coordinates in enumerate(parts):
            out[:, table] = out[:, table] * (2 * dim + 1) + _largest(rows @ rotation(dim, seed + table * len(parts) + k)[:, :coordinates])
    return out


def _bits_near(left: str, right: str, degrees: Column) -> Column:
    """Whether so many of the KEPT_BITS of two rows are equal as an angle of degrees allows, within the confidence bound."""
    apart = sum((F.bit_count(F.col(f"{left}.c{k}").bitwiseXOR(F.col(f"{right}.c{k}"))) for k in range(KEPT_BITS // 64)), F.lit(0))
    share = F.least(F.lit(0.5), degrees / 180.0)
    return apart <= KEPT_BITS * share + DEVIATIONS * F.sqrt(KEPT_BITS * share * (1 - share)) + 1


def _units(lists: list) -> np.ndarray:
    """Usable vectors of one length as unit vectors in double precision."""
    rows = np.array([np.asarray(x, dtype=float) for x in lists])
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _keyed(n: int, tight: float, threshold: float, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["embedding"].map(len)):
                units = _units(list(part["embedding"]))
                found = keys(units, shape(n, dim), tables(n, dim, threshold), seed)
                signs, factor = codes(units, seed)
                packed = np.packbits(np.pad(signs, ((0, 0), (0, -signs.shape[1] % 64))), axis=1)
                kept = np.ascontiguousarray(packed).view(np.int64)
                out = {"id": part["id"].to_numpy(), "dim": np.int32(dim), "keys": list(found), "n_tight": np.int32(min(tables(n, dim, tight), found.shape[1]))}
                yield pd.DataFrame(out | {f"c{k}": kept[:, k] for k in range(KEPT_BITS // 64)} | {"code": [x.tobytes() for x in packed], "factor": factor})

    return run


def _possible(seed: int):
    """Of rows a, b, degrees, x (the vector of a), code and factor (of b), those whose upper confidence bound allows an angle of degrees."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby(frame["x"].map(len)):
                bits = -(-CODE_BITS // dim) * dim
                part = part[part["code"].map(len) == -(-bits // 64) * 8]
                if len(part):
                    signs = np.unpackbits(np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1), axis=1)[:, :bits] > 0
                    value, deviation = estimates(_units(list(part["x"])), signs, part["factor"].to_numpy(), seed)
                    angle = np.radians(np.minimum(180.0, part["degrees"].to_numpy() + SLACK))
                    most_sine = np.where(angle < np.pi / 2, np.sin(angle), 1.0)  # of the pairs that are so near
                    yield part.loc[value + DEVIATIONS * deviation * most_sine + 1e-6 >= np.cos(angle), ["a", "b", "x"]]

    return run


def _cosines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b and cosine of rows a, b, x, y with two vectors; vectors of different lengths have none."""
    for frame in frames:
        for dim, part in frame.groupby(frame["x"].map(len)):
            part = part[part["y"].map(len) == dim]
            if len(part):
                cosine = np.einsum("ij,ij->i", _units(list(part["x"])), _units(list(part["y"])))
                yield pd.DataFrame({"a": part["a"], "b": part["b"], "cosine": cosine})


def recomputed(pairs: DataFrame, coded: DataFrame, vectors: DataFrame, seed: int) -> DataFrame:
    """a, b and the exact cosine of those of pairs(a, b, degrees) that by the estimate may be so near; coded(id, code, factor), vectors(id, embedding)."""
    left = join_spread(pairs, vectors.select(F.col("id").alias("a"), F.col("embedding").alias("x")), "a", "b")
    left = left.join(coded.select(F.col("id").alias("b"), "code", "factor"), "b")
    possible = left.select("a", "b", "degrees", "x", "code", "factor").mapInPandas(_possible(seed), "a long, b long, x array<double>")
    both = possible.join(vectors.select(F.col("id").alias("b"), F.col("embedding").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(_cosines, "a long, b long, cosine double")


def _member_links(threshold: float):
    """Links between the members of two balls, of rows with side 0 or 1: one line for each member that has any, with their number and one partner."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group.side == 0], group[group.side == 1]
        linked = _units(list(left["embedding"])) @ _units(list(right["embedding"])).T >= threshold
        out = []
        for mine, others, hit in ((left, right, linked), (right, left, linked.T)):
            rows = hit.any(axis=1)
            weight = others["copies"].to_numpy()
            out.append(pd.DataFrame({"id": mine["id"].to_numpy()[rows], "partner": others["id"].to_numpy()[hit[rows].argmax(axis=1)], "links": (hit[rows] * weight).sum(axis=1)}))
        return pd.concat(out).astype("int64")

    return run


def _meetings(rows: DataFrame, degrees: float) -> DataFrame:
    """a < b and degrees: pairs of balls of rows(bucket, ball, radius, c0, ...) that share a bucket and whose bits allow a link.

    A bucket of over BLOCK rows is cut in blocks, and a row goes to each pair of blocks with its own.
    """
    crowded = checkpointed(rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")).where("n_blocks > 1"))
    reach = F.lit(degrees) + F.col("l.radius") + F.col("r.radius") + SLACK
    near = (F.col("l.ball") < F.col("r.ball")) & _bits_near("l", "r", reach)
    pair = [F.col("l.ball").alias("a"), F.col("r.ball").alias("b"), reach.alias("degrees")]
    placed = with_few(rows, crowded, ["bucket"])
    plain = placed.where("n_blocks IS NULL").drop("n_blocks")
    found = plain.alias("l").join(plain.alias("r"), "bucket").where(near).select(pair)
    own = F.pmod(F.xxhash64("ball", F.lit(3)), F.col("n_blocks")).cast("int")
    blocks = placed.where("n_blocks IS NOT NULL").withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    blocks = blocks.withColumn("low", F.least("own", "with")).withColumn("high", F.greatest("own", "with"))
    ones, others = blocks.where("own = low").alias("l"), blocks.where("own = high").alias("r")
    met = ones.join(others, ["bucket", "low", "high"]).where(F.col("l.ball") != F.col("r.ball")).where(_bits_near("l", "r", reach))
    both = [F.least("l.ball", "r.ball").alias("a"), F.greatest("l.ball", "r.ball").alias("b"), reach.alias("degrees")]
    return checkpointed(found.union(met.select(both)).distinct())


def link(embeddings: DataFrame, threshold: float = 0.9, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of embeddings(vec_id, embedding)."""
    spark = embeddings.sparkSession
    bound_batches(spark)
    angle = math.degrees(math.acos(threshold))
    vector = F.col("embedding").cast("array<double>")
    usable = F.coalesce(
        (F.size(vector) > 0)
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), usable.alias("usable"))
    rows = rows.withColumn("h1", F.when(F.col("usable"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("usable"), F.xxhash64("embedding", F.lit(1))))
    classes = checkpointed(
        rows.where("usable").groupBy("h1", "h2").agg(F.coalesce(F.min("vec_id"), F.min("h1")).alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    )
    n = classes.count()
    half = angle / 2 - 2 * SLACK
    kept = [f"c{k}" for k in range(KEPT_BITS // 64)]
    schema = f"id long, dim int, keys array<long>, n_tight int, {', '.join(f'{c} long' for c in kept)}, code binary, factor double"
    keyed = checkpointed(classes.select("id", "embedding").mapInPandas(_keyed(n, math.cos(math.radians(half)), threshold, seed), schema))
    coded = keyed.select("id", "code", "factor")
    bucket = lambda rows, names: rows.select(*names, "dim", F.posexplode("keys").alias("table", "key")).select(*names, F.xxhash64("dim", "table", "key").alias("bucket"))

    # balls: each vector with the smallest of its buckets' first vectors that it surely shares a link's half angle with
    tight = bucket(keyed.withColumn("keys", F.slice("keys", F.lit(1), F.col("n_tight"))), ["id", *kept])
    order = F.struct(F.xxhash64("id", F.lit(seed)).alias("rank"), F.col("id").alias("lead"), *kept)
    leads = checkpointed(tight.groupBy("bucket").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1"))
    tries = join_hot(tight, leads.select("bucket", "first", "n"), ["bucket"], "n").select(F.struct("id", *kept).alias("own"), "first")
    tries = tries.where((F.col("first.lead") != F.col("own.id")) & _bits_near("own", "first", F.lit(half)))
    tries = checkpointed(tries.select(F.col("first.lead").alias("a"), F.col("own.id").alias("b"), F.lit(half).alias("degrees")).distinct())
    near = recomputed(tries, coded, classes, seed).withColumn("degrees", F.degrees(F.acos(F.least("cosine", F.lit(1.0)))))
    near = checkpointed(near.where(F.col("degrees") <= half).select(F.col("b").alias("a"), F.col("a").alias("b"), "degrees"))
    chosen = near.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(seed)).alias("rank"), F.col("b"), F.col("degrees"))).alias("of"))
    roots = classes.join(chosen, classes.id == chosen.a, "left_anti").select(F.col("id").alias("root"), F.lit(1).alias("one"))
    led = roots.join(near.groupBy(F.col("b").alias("root")).agg(F.count("*").alias("led")), "root").drop("one")
    direct = join_hot(near.withColumnRenamed("b", "root"), checkpointed(led), ["root"], "led")
    direct = direct.groupBy("a").agg(F.min(F.struct(F.xxhash64("root", F.lit(seed)).alias("rank"), F.col("root").alias("b"), F.col("degrees"))).alias("of"))
    members = checkpointed(
        classes.join(direct, classes.id == direct.a, "left").select(
            "h1", "h2", "id", "copies", F.coalesce("of.b", "id").alias("ball"), F.coalesce(F.col("of.degrees") + SLACK, F.lit(0.0)).alias("degrees")
        )
    )
    balls = checkpointed(members.groupBy("ball").agg(F.max("degrees").alias("radius"), F.sum("copies").alias("weight"), F.count("*").alias("members")))

    # balls that meet in a table, near enough by bits and estimate; then the exact cosines of their centres
    heavy = balls.where("members > 1").select("ball", "radius", "members")
    placed = join_hot(members.select("id", "ball"), heavy.drop("radius"), ["ball"], "members").join(keyed, "id")
    places = bucket(placed, ["ball"]).distinct().join(heavy.drop("members").join(keyed.select(F.col("id").alias("ball"), *kept), "ball"), "ball")
    single = keyed.join(balls.where("members = 1").select(F.col("ball").alias("id")), "id").withColumn("ball", F.col("id")).withColumn("radius", F.lit(0.0))
    columns = ["bucket", "ball", "radius", *kept]
    candidates = _meetings(places.select(columns).unionByName(bucket(single, ["ball", "radius", *kept]).select(columns)), angle)
    a, b = balls.select([F.col(c).alias(f"{c}_a") for c in balls.columns]), balls.select([F.col(c).alias(f"{c}_b") for c in balls.columns])
    centres = recomputed(candidates, coded, classes, seed).join(a, F.col("a") == a.ball_a).join(b, F.col("b") == b.ball_b)
    apart = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least("cosine", F.lit(1.0)))))
    reach = F.col("radius_a") + F.col("radius_b") + SLACK
    exact = (F.col("members_a") == 1) & (F.col("members_b") == 1)
    pairs = checkpointed(
        centres.withColumn("all", F.when(exact, F.col("cosine") >= threshold).otherwise(apart + reach <= angle))
        .withColumn("none", F.when(exact, F.col("cosine") < threshold).otherwise(apart - reach > angle))
        .where("NOT none")
        .select("a", "b", "all", "weight_a", "weight_b", "members_a", "members_b")
    )
    sure, open_pairs = pairs.where("all"), pairs.where("NOT all")
    of_balls = sure.select(F.col("a").alias("ball"), F.col("weight_b").alias("links")).union(sure.select("b", "weight_a")).groupBy("ball").agg(F.sum("links").alias("ball_links"))
    full = members.join(classes.select("id", "embedding"), "id")
    parts_a, parts_b = F.ceil(F.col("members_a") / BLOCK).cast("int"), F.ceil(F.col("members_b") / BLOCK).cast("int")
    sided = open_pairs.select("a", "b", parts_a.alias("parts_a"), parts_b.alias("parts_b"))
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), n).cast("int")
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sided.join(full, sided.a == full.ball).select("a", "b", part(F.col("parts_a")).alias("i"), cells("parts_b").alias("j"), F.lit(0).alias("side"), "id", "copies", "embedding")
    right = sided.join(full, sided.b == full.ball).select("a", "b", cells("parts_a").alias("i"), part(F.col("parts_b")).alias("j"), F.lit(1).alias("side"), "id", "copies", "embedding")
    found = checkpointed(left.unionByName(right).groupBy("a", "b", "i", "j").applyInPandas(_member_links(threshold), "id long, partner long, links long"))

    # links of each class, and components over balls, pairs of balls and single links
    own = members.join(balls.select("ball", "weight"), "ball").join(of_balls, "ball", "left")
    own = own.join(found.groupBy("id").agg(F.sum("links").alias("more")), "id", "left")
    links = F.col("weight") - 1 + F.coalesce("ball_links", F.lit(0)) + F.coalesce("more", F.lit(0))
    edges = members.select(F.col("id").alias("a"), F.col("ball").alias("b")).union(sure.select("a", "b")).union(found.select("id", "partner"))
    components = smallest_reachable(edges.where("a <> b"))
    of_class = checkpointed(own.join(components, "id", "left").select("h1", "h2", links.alias("links"), F.coalesce("component", "id").alias("component"), "copies"))
    # vectors that link with nothing have no class; a class of many copies meets them by broadcast
    alone = rows.where("NOT usable").select("vec_id", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component"))
    out = join_hot(rows.where("usable").select("vec_id", "h1", "h2"), of_class, ["h1", "h2"], "copies").select("vec_id", "links", "component").unionByName(alone)
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
