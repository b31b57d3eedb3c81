"""Near-duplicate documents and embeddings against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import common, components, embedding_links, superminhash
from graphloom.llm.components import smallest_reachable
from graphloom.session import checkpointed
from tests.llm.fixtures import documents, empty, text


def smallest(ids: list, links: list[tuple]) -> dict:
    parent = {x: x for x in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in ids}


def shingles(value: str | None) -> set:
    mine = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value or "").translate({c: " " for c in range(9, 14)}).split(" ")
    mine = [x for x in mine if x]
    return {tuple(mine)} if 0 < len(mine) < 5 else {tuple(mine[k : k + 5]) for k in range(len(mine) - 4)}


def brute_groups(rows: list[tuple]) -> dict:
    sets = {k: shingles(t) for k, t in rows if k is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return {k: (len(sets[k]), c) for k, c in smallest(ids, links).items()}


def check(spark, rows: list[tuple]):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'b' AS bands", "2 AS d1")
    found = superminhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    wanted = brute_groups(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id) == wanted[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_documents_match_brute_force(spark):
    check(spark, [(r.doc_id, r.text) for r in documents(spark).collect()])
    assert superminhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("many", [4096, 0])
def test_families_of_near_copies_match_brute_force(spark, monkeypatch, many):
    """A base text with copies from hardly to heavily changed, so that links chain; with many = 0 every component is compared in blocks."""
    monkeypatch.setattr(superminhash, "MANY", many)
    monkeypatch.setattr(superminhash, "BLOCK", 16)
    monkeypatch.setattr(superminhash, "CELL", 8)
    monkeypatch.setattr(common, "HOT", 5)
    rng = random.Random(many)
    base = text(rng, 160).split()
    rows = []
    for k in range(150):
        copy = base[:]
        for _ in range(rng.choice((1, 2, 3, 4, 6, 9))):
            copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 9999)}"
        rows.append((k, " ".join(copy)))
    check(spark, rows)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        same = int(1000 * share)
        a, b = np.unique(pool[:1000]), np.unique(np.concatenate((pool[:same], pool[2000 : 3000 - same])))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x = superminhash.signatures([a, np.empty(0, np.uint64), b])
        assert abs((x[0] == x[2]).mean() - true) < 0.16 and (x[1] == x[1].max()).all()
    for n in (1, 2, 7, 50, 126, 400):
        one = superminhash.signatures([pool[:n]])
        ranks = one >> np.uint64(32)
        assert ranks.max() < superminhash.SLOTS and len(np.unique(one)) == superminhash.SLOTS
        assert (one == superminhash.signatures([pool[1000:1300], pool[:n]])[1]).all()


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5)]
    found = {r.id: r.component for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = smallest(sorted({x for p in links for x in p}), links)
    assert found == {k: wanted[k] for p in links if p[0] != p[1] for k in p}
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_few_ids_take_a_shuffle_a_round(spark, monkeypatch, few):
    shuffles = []

    def counted(df):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return checkpointed(df)

    monkeypatch.setattr(components, "checkpointed", counted)
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(few)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 180)] + [(90, k) for k in range(300, 400)]
    found = {r.id: r.component for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted = smallest(sorted({x for p in links for x in p}), links)
    assert found == {k: wanted[k] for p in links if p[0] != p[1] for k in p}
    assert not few or len(shuffles) > 5 and sum(shuffles) <= len(shuffles)


def test_without_copies_keeps_one_of_each_group(spark):
    docs = documents(spark)
    wanted = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    kept = [r.doc_id for r in superminhash.without_copies(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(k for k, (_, c) in wanted.items() if k == c) and kept.count(None) == 1


def test_without_copies_keeps_every_text_of_a_repeated_id(spark):
    rng = random.Random(6)
    one, two, three = (text(rng, 60) for _ in range(3))
    rows = [(1, one, "x"), (1, two, "y"), (1, three, "z"), (1, one, "w"), (2, one + " tail", "v"), (3, None, "n"), (3, "", "e"), (None, one, "u"), (None, one, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string").selectExpr("*", "1 AS number", "2 AS rank")
    for some in (docs, docs.repartition(5)):
        found = superminhash.without_copies(some)
        assert found.columns == docs.columns
        kept = sorted(((r.doc_id or 0), r.text or "") for r in found.collect())
        assert kept == sorted([(0, one), (0, one), (1, one), (1, two), (1, three), (3, "")])


@pytest.mark.parametrize("repeated", [False, True])
def test_without_copies_leaves_the_search_out_of_its_answer(spark, repeated):
    docs = documents(spark)
    docs = docs.union(docs) if repeated else docs.dropDuplicates(["doc_id"])
    wanted = brute_groups([(r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).collect()])
    found = superminhash.without_copies(checkpointed(docs))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    assert sorted(r.doc_id for r in found.where("doc_id IS NOT NULL").collect()) == sorted(k for k, (_, c) in wanted.items() if k == c)


def vectors(rng: np.random.Generator) -> list[tuple]:
    rows, dim = [], 16
    for k in range(60):
        center = rng.standard_normal(dim)
        for _ in range(rng.choice((1, 1, 2, 9))):
            rows.append(center + rng.choice((0.0, 0.05, 0.15, 0.3)) * rng.standard_normal(dim))
    out = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]
    out += [(9000, None), (9001, []), (9002, [0.0] * dim), (9003, [float("nan")] * dim), (9004, [1.0, None] + [0.0] * (dim - 2)), (9005, [float("inf")] + [0.0] * (dim - 1))]
    out += [(9006, [1.0, 0.0]), (9007, [3.0, 0.0]), (9008, [0.0, 1.0]), (9009, out[4][1]), (9010, [1e300] * dim), (9011, [1e-300] * dim), (None, out[5][1])]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_embeddings_match_brute_force(spark, seed):
    rows = vectors(np.random.default_rng(seed))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "2 AS id", "3 AS links")
    found = embedding_links.link(frame).collect()
    assert len(found) == len(rows)
    usable = {}
    for place, (k, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v) / np.abs(v).max()
            usable[place] = (k, u / np.linalg.norm(u))
    links = [(a, b) for a in usable for b in usable if b < a and len(usable[a][1]) == len(usable[b][1]) and usable[a][1] @ usable[b][1] >= 0.9]
    degree = {p: 0 for p in range(len(rows))}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    group = smallest(list(range(len(rows))), links)
    wanted = {}
    for p, (k, _) in enumerate(rows):
        if k is not None:
            wanted[k] = (degree[p], min(x for q, (x, _) in enumerate(rows) if group[q] == group[p] and x is not None))
    for r in found:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id) == wanted[r.vec_id], r
            assert r.kept == (r.vec_id == r.component_id)
    assert embedding_links.link(frame.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [24, 64, 300])
def test_estimates_are_unbiased(dim):
    """Over random rotations, of far pairs and near ones alike; the bound holds, and the share of unequal bits estimates the angle."""
    rng, n = np.random.default_rng(5), 1000
    units = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x, y = units(rng.standard_normal((n, dim))), units(rng.standard_normal((n, dim)))
    y = units(y - np.einsum("ij,ij->i", x, y)[:, None] * x)
    for cosine in (0.0, 0.3, 0.7, 0.9, 0.97, 0.999):
        z, errors, apart = cosine * x + math.sqrt(1 - cosine**2) * y, [], []
        for seed in range(0, 600, 100):
            signs, factor = embedding_links.codes(z, seed)
            value, deviation = embedding_links.estimates(x, signs, factor, seed)
            errors.append(value - cosine)
            assert (np.abs(value - cosine) <= embedding_links.DEVIATIONS * deviation * math.sqrt(1 - cosine**2) + 1e-9).all()
            mine = embedding_links.codes(x, seed)[0]
            apart.append((mine != signs)[:, : embedding_links.KEPT_BITS].mean(axis=1))
        errors, apart = np.concatenate(errors), np.concatenate(apart)
        assert abs(errors.mean()) < 4 * errors.std() / math.sqrt(len(errors)) + 1e-12
        assert abs(apart.mean() - math.acos(cosine) / math.pi) < 4 * apart.std() / math.sqrt(len(apart)) + 1e-12


def test_recall_on_planted_pairs(spark):
    """12,000 vectors, half of them partners of others at a cosine from 0.9 to 0.93, against all pairs."""
    rng, n = np.random.default_rng(2), 6000
    units = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x, y = units(rng.standard_normal((n, 64))), rng.standard_normal((n, 64))
    y = units(y - np.einsum("ij,ij->i", x, y)[:, None] * x)
    cosine = rng.uniform(0.9001, 0.93, n)[:, None]
    rows = np.concatenate((x, cosine * x + np.sqrt(1 - cosine**2) * y))
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(2 * n), "embedding": list(rows)}))
    found = {r.vec_id: r.n_links for r in embedding_links.link(frame).collect()}
    wanted = np.concatenate([((rows[k : k + 2000] @ rows.T) >= 0.9).sum(axis=1) - 1 for k in range(0, 2 * n, 2000)])
    assert wanted.sum() >= 2 * n and all(found[k] <= wanted[k] for k in found)
    assert sum(found.values()) >= 0.99 * wanted.sum()


def test_a_dense_cone_is_linked_whole(spark):
    """Vectors around 25 degrees from each other, none in another's ball, against all pairs."""
    rng, n = np.random.default_rng(3), 1200
    center = rng.standard_normal(64)
    rows = center / np.linalg.norm(center) + 0.04 * rng.standard_normal((n, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    found = embedding_links.link(spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(rows)}))).collect()
    wanted = (rows @ rows.T >= 0.9).sum(axis=1) - 1
    assert sum(r.n_links for r in found) >= 0.995 * wanted.sum() > 0 and all(r.n_links <= wanted[r.vec_id] for r in found)
