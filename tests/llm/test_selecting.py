"""Filter audit, importance resampling and substring dedup against plain Python versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import filter_audit, importance, substring_dedup
from graphloom.llm.fm_index import FMIndex
from tests.llm.fixtures import documents, empty, text

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SHORT = dict(min_words=10, distinct_percent=90, capital_percent=3, symbols="#|")


def plain_words(value: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", value or "")


def brute_audit(rows, labels):
    """{(part, order, step): counts} from rows (doc_id, part, text)."""
    seen = {}
    for doc, _, body in rows:
        if doc is not None:
            seen[body or ""] = min(doc, seen.get(body or "", doc))
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    judged = []
    for doc, part, body in rows:
        words, body = plain_words(body), body or ""
        fails = {
            "A": len(words) < 10,
            "B": 100 * len(set(words)) < 90 * len(words),
            "C": 100 * len(re.findall("[A-Z]", body)) > 3 * len(body),
            "D": bool(re.search("[#|]", body)),
            "E": doc is not None and doc > seen.get(body, doc),
        }
        judged.append((part or "", doc, {f for f, x in fails.items() if x}))
    out = {}
    for part in {p for p, _, _ in judged}:
        here = [(d, f) for p, d, f in judged if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(here)
            for step, name in enumerate(order, 1):
                removed = [d for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                fails = sum(name in f for _, f in here)
                out[part, order, step] = [len(left), len(removed), fails - len(removed), sum(f == {name} for _, f in here), sum(d in good for d in removed), sum(d in toxic for d in removed)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(sum(v[1] for k, v in out.items() if k[0] == part and k[1][k[2] - 1] == key[1][key[2] - 1]))
    return out


def test_first_failures_table():
    table = filter_audit.first_failures(5)
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    for mask in range(32):
        for k, order in enumerate(permutations(range(5))):
            assert table[mask, k] == next((s for s, f in enumerate(order) if mask >> f & 1), 5)


def test_audit_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    docs = documents(spark, 30)
    rows = [(r.doc_id, rng.choice(["x", "y", None]), r.text) for r in docs.collect()]
    rows += [(k, "z", t) for k, t in ((7000, "UPPER " * 12), (7001, "a # b"), (7002, "UPPER " * 12), (7002, "UPPER " * 12), (6999, ""), (7003, "é" * 9 + "AB"))]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(20)] + [(3, 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(d, t, p, "clash", 1) for d, p, t in rows], "doc_id long, text string, lang string, mask string, n int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr("graphloom.llm.common.HOT", 2)  # groups of copies take the broadcast path
    found = filter_audit.audit(filter_audit.labelled(filter_audit.failures(frame, F.col("lang"), **SHORT), known))
    counts = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in counts] for r in found.collect()} == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    none = empty(spark).withColumn("lang", F.col("lang").cast("string"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.labelled(filter_audit.failures(none, F.col("lang")), labels)).count() == 0


def grams(value: str | None, longest: int) -> list[str]:
    words = ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), value or ""))
    return [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def brute_resample(rows, target, longest, buckets, percent, min_words):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, b in rows for g in grams(b, longest))
    t = Counter(bucket(g) for b in target for g in grams(b, longest))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc, body in rows:
        mine = grams(body, longest)
        weight = sum(gain(bucket(g)) for g in mine)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(mine), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(grams(body, 1)) >= min_words])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 97), (2, 70_000)])
def test_resample_matches_brute_force(spark, monkeypatch, longest, buckets):
    docs = documents(spark, 40)
    target = [text(random.Random(k), 30) for k in range(5)] + [None, ""]
    monkeypatch.setattr("graphloom.llm.common.HASH_BYTES", 50)  # texts are read in pieces
    monkeypatch.setattr("graphloom.llm.common.HOT", 2)
    found = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest, buckets, percent=30, min_words=15)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()), key=repr)
    assert got == brute_resample(rows, target, longest, buckets, 30, 15)


def test_runs_over_pieces(monkeypatch):
    value = text(random.Random(8), 400).encode()
    whole = importance.bag(value, 3, importance._Buckets(1000))
    monkeypatch.setattr("graphloom.llm.common.HASH_BYTES", 11)
    pieces = importance.bag(value, 3, importance._Buckets(1000))
    assert whole[0] == pieces[0] == 400 and sorted(whole[1]) == sorted(pieces[1])


def test_resampling_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(empty(spark), docs).count() == 0
    assert importance.resample(docs, empty(spark).select("text"), percent=100, min_words=1).select("n_features", "rank").collect() == [(3, 1)]


def brute_matches(sequences, owners, limit, query):
    lengths, least = [], []
    for k in range(len(query)):
        n, owner = 0, -1
        for size in range(1, min(limit, len(query) - k) + 1):
            met = [o for s, o in zip(sequences, owners, strict=True) for at in range(len(s) - size + 1) if (s[at : at + size] == query[k : k + size]).all()]
            if not met:
                break
            n, owner = size, min(met) if size == limit else -1
        lengths.append(n)
        least.append(owner)
    return lengths, least


@pytest.mark.parametrize("seed", range(25))
def test_matching_statistics_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    limit, symbols = int(rng.integers(1, 9)), int(rng.integers(1, 6))
    sequences = [rng.integers(0, symbols, rng.integers(1, 20)) for _ in range(rng.integers(1, 8))]
    owners = rng.integers(0, 100, len(sequences))
    queries = [rng.integers(-1, symbols + 2, rng.integers(0, 25)) for _ in range(4)] + [sequences[0]]
    for query, (lengths, least) in zip(queries, FMIndex(sequences, owners, limit).matches(queries), strict=True):
        assert (list(lengths), list(least)) == brute_matches(sequences, owners, limit, query)


def brute_dedupe(rows, window):
    starts: dict[tuple, int] = {}
    for doc, body in rows:
        words = plain_words(body)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if doc is not None:
                starts[key] = min(doc, starts.get(key, doc))
    out = []
    for doc, body in rows:
        words = plain_words(body)
        gone = {k + j for k in range(len(words) - window + 1) if doc is not None and starts[tuple(words[k : k + window])] < doc for j in range(window)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(spark):
    """documents() with shared passages that go on differently, repeats of one word, and texts that differ in white space."""
    rng = random.Random(9)
    shared = [text(rng, n) for n in (30, 14, 9, 60)]
    rows = [(r.doc_id, r.text) for r in documents(spark, 30).collect() if r.doc_id != 5004]
    rows += [(8000 + k, " ".join([text(rng, rng.randint(0, 15)), rng.choice(shared), text(rng, rng.randint(0, 15)), rng.choice(shared)])) for k in range(40)]
    rows += [(8100, "word " * 400), (8101, "word " * 300 + "end"), (8102, " ".join(["word"] * 11)), (8103, "a b " * 200), (8103, shared[3]), (8103, shared[3]), (8104, shared[3].replace(" ", " \n\t")), (None, shared[3])]
    rows.append((8105, text(rng, 2000) + " " + shared[3]))
    return rows


@pytest.mark.parametrize("window, anchor, hot", [(12, 4, 2048), (12, 4, 2), (10, 10, 1), (5, 9, 2048)])
def test_dedupe_matches_brute_force(spark, monkeypatch, window, anchor, hot):
    rows = passages(spark)
    monkeypatch.setattr("graphloom.llm.common.HOT", 2)
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, digest string, owner int")
    found = substring_dedup.dedupe(docs, window, anchor, hot)
    got = found.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute_dedupe(rows, window)
    assert all(r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got) and any(r.kept for r in got)


def test_segments_in_blocks(monkeypatch):
    """Every window has the same anchor however its text is cut."""
    value = substring_dedup.normal((text(random.Random(1), 700) + " x" * 300).encode())
    spread = lambda: {first + k: key for key, _, first, size in zip(*map(list, substring_dedup.segments(value, 12, 5)), strict=True) for k in range(size)}
    whole = spread()
    assert sorted(whole) == list(range(1000 - 11))
    monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", 64)
    monkeypatch.setattr(substring_dedup, "SEGMENT_WINDOWS", 7)
    assert spread() == whole


def test_dedupe_of_nothing(spark):
    assert substring_dedup.dedupe(empty(spark)).count() == 0
    short = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.dedupe(short).collect()} == {(1, 0), (2, 0), (3, 0)}
