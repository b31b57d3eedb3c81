"""Recursion over edges(source, target), where source depends on target: closures, explained breadth-first
search, longest paths and cycles. Each loop keeps only its frontier's new rows in play and cuts lineage by
checkpoint; what follows one pointer an id (parents, unbranched chains) goes by doubling.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.storage import ranked
from graphloom.session import FEW, met
from graphloom.session import counted as checkpointed


def _steps(edges: DataFrame, dependents: bool) -> DataFrame:
    """at, next: from a dependency to its dependents, or the other way."""
    near, far = ("target", "source") if dependents else ("source", "target")
    return edges.select(F.col(near).alias("at"), F.col(far).alias("next")).distinct()


def _near(frontier: DataFrame, n: int) -> DataFrame:
    """A frontier, n rows of which were counted, for a join with steps: few are broadcast, so that no round deals all steps out."""
    return F.broadcast(frontier) if n <= FEW else frontier


def reachable(seeds: DataFrame, edges: DataFrame, dependents: bool = True) -> DataFrame:
    """id, depth of the seeds(id) and all they reach, with the fewest steps; cycles are safe."""
    steps = checkpointed(_steps(edges, dependents))
    seen = frontier = checkpointed(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    level = 0
    while n := frontier.limit(FEW + 1).count():
        level += 1
        ahead = _near(frontier, n).join(steps, frontier.id == steps["at"]).select(F.col("next").alias("id")).distinct()
        frontier = checkpointed(ahead.join(seen, "id", "left_anti").withColumn("depth", F.lit(level)))
        seen = checkpointed(seen.union(frontier)) if level % 4 == 0 else seen.union(frontier)
    return seen


def reachable_by_doubling(seeds: DataFrame, edges: DataFrame, dependents: bool = True) -> DataFrame:
    """As reachable, in about log2 of the longest shortest path rounds: for long chains with few branches.

    Round k has every id within 2^k - 1 steps and the pairs of exactly 2^k steps, so depths are exact sums.
    Where pairs multiply, as in a lattice, they would become all pairs: beyond four times the edges it goes on as reachable does.
    """
    steps = checkpointed(_steps(edges, dependents))
    seen = checkpointed(seeds.select("id").distinct().withColumn("depth", F.lit(0).cast("long")))
    length, before, most = 1, -1, 4 * steps.count()
    while True:
        ahead = seen.join(steps, seen.id == steps["at"]).select(F.col("next").alias("id"), (F.col("depth") + length).alias("depth"))
        seen = checkpointed(seen.union(ahead).groupBy("id").agg(F.min("depth").alias("depth")))
        now = seen.count()
        if now == before:
            return seen
        before = now
        after = steps.select(F.col("at").alias("mid"), F.col("next").alias("end"))
        steps = checkpointed(steps.join(after, steps["next"] == after.mid).select("at", F.col("end").alias("next")).distinct())
        if steps.count() > most:
            return reachable(seeds, edges, dependents)
        length *= 2


#: Groups whose numbers share a row of words of 64 bits.
WORDS = 8


def reachable_pairs(seeds: DataFrame, edges: DataFrame, dependents: bool = False) -> DataFrame:
    """group, id reached within each group of seeds(group, id), seeds included.

    There may be as many pairs as groups times ids. Until the end they stand as bits, a row for an id and each 512 groups in order that
    have it, so that a round deals out and keeps words of bits, not pairs.
    """
    steps = checkpointed(_steps(edges, dependents))
    groups = checkpointed(ranked(seeds.select("group").distinct(), "group").select(F.col("group").alias("_group"), (F.col("rank") - 1).alias("at")))
    words = [f"w{k}" for k in range(WORDS)]
    ored = lambda names: [F.bit_or(c).alias(c) for c in names]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))
    placed = seeds.select("group", "id").join(met(groups), F.col("group").eqNullSafe(F.col("_group")))
    word = F.shiftright("at", 6).bitwiseAND(WORDS - 1)
    first = placed.groupBy("id", F.floor(F.col("at") / (64 * WORDS)).alias("chunk")).agg(*(F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(c) for k, c in enumerate(words)))
    seen = frontier = checkpointed(first)
    none, level = F.lit(0).cast("long"), 0
    while n := frontier.limit(FEW + 1).count():
        level += 1
        ahead = _near(frontier, n).join(steps, frontier.id == steps["at"]).select(F.col("next").alias("id"), "chunk", *(none.alias(c) for c in words), *(F.col(c).alias(f"new_{c}") for c in words))
        both = ahead.unionByName(seen.select("id", "chunk", *words, *(none.alias(f"new_{c}") for c in words)))
        both = both.groupBy("id", "chunk").agg(*ored(words), *ored(f"new_{c}" for c in words))
        fresh = both.select("id", "chunk", *(F.col(f"new_{c}").bitwiseAND(F.bitwise_not(c)).alias(c) for c in words))
        frontier = checkpointed(fresh.where(" OR ".join(f"{c} <> 0" for c in words)))
        seen = checkpointed(seen.unionByName(frontier).groupBy("id", "chunk").agg(*ored(words))) if level % 8 == 0 else seen.unionByName(frontier)
    whole = seen.groupBy("id", "chunk").agg(*ored(words))
    each = whole.select("id", "chunk", F.posexplode(F.array(*words)).alias("word", "bits")).where("bits <> 0")
    found = each.select("id", "chunk", "word", F.explode(F.expr("filter(sequence(0, 63), i -> getbit(bits, i) = 1)")).alias("bit"))
    found = found.select("id", ((F.col("chunk") * WORDS + F.col("word")) * 64 + F.col("bit")).alias("at"))
    return found.join(met(groups), "at").select(F.col("_group").alias("group"), "id")


def discovered(touched: DataFrame, edges: DataFrame) -> DataFrame:
    """id, depth, parent, first, rank: what touched(id) ids affect, breadth first, with each id's first discoverer and the touched id where that way begins.

    Ranks are places within a depth: a queue that starts with the touched ids in order visits ids in the
    order of their parents' ranks, then of ids. Rows don't grow with the depth; chains() unrolls them.
    """
    steps = checkpointed(_steps(edges, True))
    start = ranked(touched.select("id").distinct(), "id")
    seen = frontier = checkpointed(start.select("id", F.lit(0).alias("depth"), F.lit(None).cast(start.schema["id"].dataType).alias("parent"), F.col("id").alias("first"), "rank"))
    depth = 0
    while n := frontier.limit(FEW + 1).count():
        depth += 1
        ahead = _near(frontier, n).join(steps, frontier.id == steps["at"]).groupBy(F.col("next").alias("id")).agg(F.min(F.struct("rank", F.col("at").alias("parent"), "first")).alias("via"))
        found = checkpointed(ahead.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "via.parent", "via.first", F.col("via.rank").alias("before")))
        if found.limit(FEW + 1).count() <= FEW:  # few enough for one task to order
            frontier = found.withColumn("rank", F.row_number().over(Window.orderBy("before", "id")).cast("long"))
        else:
            frontier = ranked(found, "before", "id")
        frontier = frontier.select("id", "depth", "parent", "first", "rank")
        seen = checkpointed(seen.union(frontier)) if depth % 4 == 0 else seen.union(frontier)
    return seen


def above(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """start, id, steps: for each of starts(id), itself and all that pointers(id, parent), one an id, lead to; a cycle is gone round once.

    Rounds double the pointers' reach, which keep one row an id, so there are about log2 of the longest way.
    """
    jump = checkpointed(pointers.where("parent IS NOT NULL").select("id", "parent"))
    found = checkpointed(starts.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("steps")).distinct())
    length, before = 1, -1
    while True:
        ahead = found.join(jump, "id").select("start", F.col("parent").alias("id"), (F.col("steps") + length).alias("steps"))
        found = checkpointed(found.union(ahead).groupBy("start", "id").agg(F.min("steps").alias("steps")))
        now = found.count()
        if now == before:
            return found
        before, length = now, 2 * length
        further = jump.select(F.col("id").alias("parent"), F.col("parent").alias("further"))
        jump = checkpointed(jump.join(further, "parent").select("id", F.col("further").alias("parent")))


def chains(found: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """id, chain: the ids from the touched one to each of wanted(id), or of all that discovered() found."""
    if wanted is None:
        return _all_chains(found.select("id", "parent"))
    rows = above(found.select("id", "parent"), wanted)
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("place"), "id"))), lambda x: x["id"])
    return rows.groupBy("start").agg(listed.alias("chain")).withColumnRenamed("start", "id")


def _all_chains(pointers: DataFrame) -> DataFrame:
    """id, chain of every id of a forest of pointers(id, parent).

    Each round an unfinished piece of a chain takes the piece that ends above it, so pieces double, there are about log2 of the
    longest chain rounds, and what is finished isn't written again.
    """
    pieces = checkpointed(pointers.select("id", F.col("parent").alias("up"), F.array("id").alias("chain")))
    done, growing = pieces.where("up IS NULL"), pieces.where("up IS NOT NULL")
    while growing.limit(1).count():
        tops = done.unionByName(growing).select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("chain").alias("before"))
        pieces = checkpointed(growing.join(tops, "up").select("id", F.col("further").alias("up"), F.concat("before", "chain").alias("chain")))
        done, growing = done.unionByName(pieces.where("up IS NULL")), pieces.where("up IS NOT NULL")
    return done.select("id", "chain")


def explained(touched: DataFrame, edges: DataFrame) -> DataFrame:
    """id, depth, parent, first, also, rank: what touched(id) ids affect, breadth first.

    parent is the first discoverer, first the touched id at the chain's begin; chains() unrolls whole chains of ids asked for. also: the other affected
    dependencies of an id that isn't touched itself.
    """
    seen = checkpointed(discovered(touched, edges))
    direct = edges.select("source", "target").distinct().join(seen.select(F.col("id").alias("target")), "target")
    others = seen.join(direct, seen.id == direct.source).where(F.col("parent").isNotNull() & (F.col("target") != F.col("parent")))
    also = others.groupBy("id").agg(F.array_sort(F.collect_set("target")).alias("also"))
    none = F.array().cast(also.schema["also"].dataType)
    return seen.join(also, "id", "left").withColumn("also", F.coalesce("also", none))


#: Links that one task may settle.
SMALL = 100_000


class Cyclic(ValueError):
    """Edges have a cycle where none may be."""

    def __init__(self) -> None:
        super().__init__("the edges have a cycle")


def _core(links: pd.DataFrame, nodes: pd.DataFrame, mark: bool) -> pd.DataFrame:
    """id, value of a small graph's nodes, by one pass in topological order; what a cycle holds up has null, or 1 if loops are marked."""
    ahead: dict = {}
    held = dict.fromkeys(nodes["id"].tolist(), 0)
    for near, far, cost in zip(links["near"].tolist(), links["far"].tolist(), links["cost"].tolist(), strict=True):
        ahead.setdefault(near, []).append((far, cost))
        held[far] += 1
    value = {k: None if f != f or f is None else int(f) for k, f in zip(nodes["id"].tolist(), nodes["floor"].tolist(), strict=True)}
    ready, out = [k for k, n in held.items() if not n], {}
    while ready:
        here = ready.pop()
        out[here] = value[here] or 0
        for far, cost in ahead.get(here, ()):
            value[far] = max(out[here] + cost, value[far]) if value[far] is not None else out[here] + cost
            held[far] -= 1
            if not held[far]:
                ready.append(far)
    ids = nodes["id"].tolist()
    return pd.DataFrame({"id": ids, "value": pd.array([out.get(k, 1 if mark else None) for k in ids], "Int64")})


def settled(nodes: DataFrame, links: DataFrame, mark: bool = False) -> DataFrame:
    """id, value of nodes(id, floor) over links(near, far, cost): the most of an id's floor and of value + cost of what is near to it; 0 for an id with neither.

    Levels are settled from their beginnings, one a round, until at most SMALL links are left, which one task settles in order.
    An id that is linked to itself is on a cycle, as is one that no beginning leads to: with mark it has the value 1 and what it leads to too (costs being 0), without Cyclic is raised.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    waiting, links = checkpointed(nodes.select("id", F.col("floor").cast("long").alias("floor"))), links.groupBy("near", "far").agg(F.max(F.col("cost").cast("long")).alias("cost"))
    done: list[DataFrame] = []
    while True:
        loops = checkpointed(links)
        looped = loops.where("near = far").select(F.col("near").alias("id"))
        if looped.limit(1).count():
            if not mark:
                raise Cyclic
            waiting = checkpointed(waiting.join(looped.withColumn("loop", F.lit(1).cast("long")), "id", "left").select("id", F.greatest("floor", "loop").alias("floor")))
        links = loops.where("near <> far")
        if links.limit(SMALL + 1).count() <= SMALL:
            break
        ready = checkpointed(waiting.join(links.select(F.col("far").alias("id")).distinct(), "id", "left_anti").select("id", F.coalesce("floor", F.lit(0)).cast("long").alias("value")))
        if not ready.limit(1).count():
            if not mark:
                raise Cyclic
            # everything left comes after something, so all of it is on a cycle or after one
            return _together([*done, waiting.select("id", F.lit(1).cast("long").alias("value"))])
        done.append(ready)
        gone, pushed = ready.select("id"), links.join(ready, links.near == ready.id).select(F.col("far").alias("id"), (F.col("value") + F.col("cost")).alias("more"))
        links = links.join(gone.withColumnRenamed("id", "near"), "near", "left_anti")
        best = pushed.groupBy("id").agg(F.max("more").alias("more"))
        waiting = checkpointed(waiting.join(gone, "id", "left_anti").join(best, "id", "left").select("id", F.greatest("floor", "more").alias("floor")))
    linked = links.select(F.col("near").alias("id")).union(links.select("far")).distinct()
    done.append(waiting.join(linked, "id", "left_anti").select("id", F.coalesce("floor", F.lit(0)).cast("long").alias("value")))
    inside = waiting.join(linked, "id", "left_semi").groupBy(F.lit(0).alias("one"))
    solved = links.groupBy(F.lit(0).alias("one")).cogroup(inside).applyInPandas(lambda a, b: _core(a, b, mark), f"id {kind}, value long")
    solved = checkpointed(solved)
    if solved.where("value IS NULL").limit(1).count():
        raise Cyclic
    return _together([*done, solved])


def _together(done: list[DataFrame]) -> DataFrame:
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return checkpointed(found)


def longest_paths(nodes: DataFrame, edges: DataFrame, dependents: bool = False) -> DataFrame:
    """id, length, via: the heaviest sum of weights of a chain ending at id of nodes(id, weight), and the
    neighbour it comes through, the first of those with most (null where a chain begins).

    Chains run up the dependencies, or with dependents up what depends on them. Unbranched stretches, where
    each id leads to one other and that one comes from no other, are summed by doubling and stand as one; the
    rest is settled as settled() says. A cycle raises ValueError.
    """
    known = nodes.select("id")
    inside = edges.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    steps = checkpointed(_steps(inside, not dependents))  # a chain goes from `at` on to `next`
    ways, comes = steps.groupBy("at").agg(F.count("*").alias("ways")), steps.groupBy("next").agg(F.count("*").alias("comes"))
    tight = steps.join(ways.where("ways = 1"), "at").join(comes.where("comes = 1"), "next").select(F.col("next").alias("id"), F.col("at").alias("parent"))
    stretch = checkpointed(_stretches(nodes, checkpointed(tight)))
    heads = checkpointed(stretch.groupBy("head").agg(F.max("so_far").alias("weight"), F.max_by("id", "place").alias("tail")))
    loose = steps.join(tight.select(F.col("id").alias("next"), F.col("parent").alias("at")), ["at", "next"], "left_anti")
    between = loose.join(heads.select(F.col("tail").alias("at"), F.col("head").alias("near"), F.col("weight").alias("cost")), "at").select("near", F.col("next").alias("far"), "cost")
    bases = settled(heads.select(F.col("head").alias("id"), F.lit(None).cast("long").alias("floor")), between)
    lengths = checkpointed(stretch.join(bases.withColumnRenamed("id", "head"), "head").select("id", (F.col("value") + F.col("so_far")).alias("length"), "weight"))
    best = steps.join(lengths.select(F.col("id").alias("at"), F.col("length").alias("before")), "at").groupBy(F.col("next").alias("id")).agg(F.min_by("at", F.struct(-F.col("before"), "at")).alias("via"))
    return lengths.select("id", "length").join(best, "id", "left")


def _stretches(nodes: DataFrame, tight: DataFrame) -> DataFrame:
    """id, weight, head, place, so_far: where each id stands in its stretch of tight(id, parent) links, and the weights up to it."""
    rows = nodes.select("id", "weight").join(tight, "id", "left")
    state = checkpointed(rows.select("id", "weight", F.col("parent").alias("before"), F.coalesce("parent", "id").alias("up"), F.col("weight").alias("sum"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("parent").isNull().alias("done")))
    limit = state.count()
    reach = 1
    while state.where("NOT done").limit(1).count():
        if reach > 2 * limit:
            raise Cyclic
        top = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("place").alias("place2"), F.col("done").alias("done2"))
        done, open_rows = state.where("done"), state.where("NOT done").join(top, "up")
        # a finished one above is a head or hangs on its head: its sum counts from there
        moved = open_rows.select("id", "weight", "before", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("place") + F.col("place2")).alias("place"), F.col("done2").alias("done"))
        state = checkpointed(done.unionByName(moved))
        reach *= 2
    return state.select("id", "weight", F.col("up").alias("head"), "place", F.col("sum").alias("so_far"))


def critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """position, id, weight along the heaviest chain; of equal ones the first end by id, then the first neighbours. A part of weight 0 before the first weight is left out."""
    settled = checkpointed(longest_paths(nodes, edges).where("length > 0"))
    end = settled.orderBy(F.desc("length"), "id").limit(1).select("id")
    path = above(settled.select("id", F.col("via").alias("parent")), end).join(settled.select("id"), "id")
    most = F.max("steps").over(Window.partitionBy("start"))
    return path.withColumn("position", (most - F.col("steps")).cast("int")).join(nodes, "id").select("position", "id", "weight")


def _ends(edges: DataFrame) -> DataFrame:
    """id, floor (null) of all that edges name, as settled() takes nodes."""
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().withColumn("floor", F.lit(None).cast("long"))


def cyclic_part(edges: DataFrame) -> DataFrame:
    """source, target of the edges that lead to a cycle."""
    each = checkpointed(edges.select("source", "target").distinct())
    leads = settled(_ends(each), each.select(F.col("target").alias("near"), F.col("source").alias("far"), F.lit(0).alias("cost")), mark=True).where("value > 0")
    return checkpointed(each.join(leads.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target"))


def has_cycle(edges: DataFrame) -> bool:
    """Whether some id reaches itself."""
    return bool(cyclic_part(edges).limit(1).count())


def cycle(edges: DataFrame) -> DataFrame:
    """place, id of one cycle, from its smallest id on: the one that the smallest id leads to over everyone's smallest dependency that leads to one; no rows without a cycle."""
    first = checkpointed(cyclic_part(edges).groupBy(F.col("source").alias("id")).agg(F.min("target").alias("parent")))
    start = first.agg(F.min("id").alias("id")).where("id IS NOT NULL")
    end = above(first, start).orderBy(F.desc("steps")).limit(1).select("id")  # the last one new on the way is on the cycle
    round_ = checkpointed(above(first, end))
    least = round_.agg(F.min("id").alias("id")).where("id IS NOT NULL")
    return above(first, least).select(F.col("steps").alias("place"), "id")


#: Edges of the part that leads to cycles, which a depth-first search, a sequence by nature, takes to the driver.
MOST_CYCLIC = 1_000_000


def acyclic(edges: DataFrame) -> DataFrame:
    """edges without those that close a cycle in a depth-first search in order of ids.

    Only edges that lead to cycles can be on such a search's way to a cycle; these come to the driver, at most
    MOST_CYCLIC of them (ValueError beyond), the others stay where they are.
    """
    part = cyclic_part(edges).limit(MOST_CYCLIC + 1).collect()
    if len(part) > MOST_CYCLIC:
        raise ValueError(f"over {MOST_CYCLIC} edges lead to cycles")
    after: dict = {}
    for r in part:
        after.setdefault(r.source, []).append(r.target)
    closing, visited = [], set()
    for root in sorted(after):
        if root in visited:
            continue
        visited.add(root)
        on_path, stack = {root}, [(root, iter(sorted(after[root])))]
        while stack:
            here, ahead = stack[-1]
            target = next(ahead, None)
            if target is None:
                stack.pop()
                on_path.discard(here)
            elif target in on_path:
                closing.append((here, target))
            elif target not in visited:
                visited.add(target)
                on_path.add(target)
                stack.append((target, iter(sorted(after.get(target, ())))))
    kind = edges.select("source", "target").schema
    return edges.join(edges.sparkSession.createDataFrame(closing, kind), ["source", "target"], "left_anti")
