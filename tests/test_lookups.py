"""Lookups through path sets against a plain search, one set after another."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from graphloom.operators import pathsets

SETS = "weak string, place string, pos long, kind string, path string"
TASKS = "task long, weak string, mode string, cold boolean, declared string, covered boolean, unkeyable boolean, ran string"


def test_keys_depend_on_paths_kinds_and_how_paths_are(spark):
    rows = [("w", "here", 1, "read", "a"), ("w", "here", 1, "read", "b"), ("w", "here", 2, "read", "b"), ("w", "here", 2, "read", "a"), ("w", "here", 2, "read", "a"), ("w", "here", 3, "list", "a"),
            ("w", "here", 4, "read", "gone"), ("w", "here", 5, "read", "odd"), ("w", "here", 6, "read", None), ("v", "here", 1, "read", "gone")]
    sets = spark.createDataFrame(rows, SETS)
    keys = lambda *values: {(r.weak, r.pos): (r.digest, r.strong) for r in pathsets.strong_keys(sets, spark.createDataFrame(values, "path string, value string")).collect()}
    one, two = keys(("a", "1"), ("b", "1"), ("odd", None)), keys(("a", "1"), ("b", "2"), ("odd", "1"), ("gone", "missing"), (None, "x"))
    assert set(one) == {("w", n) for n in range(1, 6)} | {("v", 1)}  # a set without a path is none
    assert one["w", 1] == one["w", 2] and len({one["w", n] for n in range(1, 6)}) == 4
    assert one["w", 5][1] is None and two["w", 5][1] is not None
    assert {n for n in range(1, 6) if one["w", n][1] != two["w", n][1]} == {1, 2, 4, 5} and all(one[k][0] == two[k][0] for k in one)
    assert one["v", 1][0] == one["w", 4][0] and one["v", 1][1] != one["w", 4][1]


def test_a_path_in_a_third_of_all_sets_is_spread(spark):
    sets = spark.range(60_000).select(F.lit("w").alias("weak"), F.lit("here").alias("place"), (F.col("id") % 20_000).alias("pos"), F.lit("read").alias("kind"), F.when(F.col("id") < 20_000, "hot").otherwise(F.col("id").cast("string")).alias("path"))
    keys = pathsets.strong_keys(sets, spark.createDataFrame([("hot", "1")], "path string, value string"))
    assert keys.select("digest").distinct().count() == 20_000 and keys.where("strong IS NULL").count() == 0


def _plain(tasks, keys, places):
    """The lookup as its rules read, task by task."""
    out = {}
    for task, weak, mode, cold, declared, covered, unkeyable, ran in tasks:
        mine = sorted((k for k in keys if k[0] == weak), key=lambda k: (k[1] != "here", k[2]))
        sets = [(d, s) for _, place, _, d, s in mine if place == "here"][:8]
        local = lambda found: next((s for _, s in found if s and (s, "here") in places), None)
        there = lambda key: (key, "there") in places
        here_declared, hit = (declared, "here") in places, None
        if mode == "on" and not cold:
            hit = local(sets)
            if hit is None and (sets or not here_declared):
                for _, place, _, d, s in mine:
                    if place != "here" and len(sets) < 8 and d not in [x for x, _ in sets]:
                        sets.append((d, s))
                hit = local(sets) or next((s for _, s in sets if s and there(s)), None)
        by_declared = mode != "on" or not sets or (not cold and covered)
        under = not cold and by_declared and (here_declared or there(declared))
        on = mode == "on"
        if unkeyable:
            out[task] = ("failed" if on or (not under and ran == "refused") else None, declared if under else None)
        elif hit:
            out[task] = ("hit", hit)
        elif under:
            out[task] = (("declared" if sets else "unrecorded") if on else None, declared)
        else:
            out[task] = ({"saved": "saved", "refused": "failed", "unsaved": "failed"}.get(ran) or (("missed" if sets else "unrecorded") if on else None), None)
    return out


def test_verdicts_are_as_a_plain_search_gives(spark):
    draw = random.Random(3)
    pick = draw.choice
    keys, seen = [], set()
    for w in range(40):
        for place in ("here", "there"):
            for pos in range(pick([0, 0, 1, 3, 9])):
                digest = f"set{pick(range(12))}"
                if place == "there" or (w, digest) not in seen:  # sets here differ
                    seen.add((w, digest))
                    keys.append((f"w{w}", place, pos, digest, None if int(digest[3:]) % 5 == 4 else f"s{w}-{digest}"))
    strong = sorted({k[4] for k in keys if k[4]})
    places = {(s, pick(["here", "there"])) for s in draw.sample(strong, len(strong) // 4)} | {(f"d{n}", pick(["here", "there"])) for n in range(4)}
    tasks = [(n, f"w{pick(range(45))}", pick(["on", "on", "record", None]), pick([True, False, False]), f"d{pick(range(9))}", pick([True, False]), n % 11 == 0, pick(["saved", "refused", "unsaved", "unkept", None])) for n in range(600)]
    found = pathsets.recorded_verdicts(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(keys, "weak string, place string, pos long, digest string, strong string"), spark.createDataFrame(sorted(places), "key string, place string"))
    wanted = _plain(tasks, keys, places)
    assert {r.task: (r.verdict, r.key) for r in found.collect()} == wanted
    assert {v for v, _ in wanted.values()} == {"hit", "declared", "saved", "missed", "unrecorded", "failed", None}
