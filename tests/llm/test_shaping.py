"""Mixing, chat formatting and the pipeline."""

from __future__ import annotations

import math
import random
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import chat_rotation, decontaminate, mixing, quality, superminhash, toxicity
from graphloom.llm.queries import ORACLES
from tests.llm.fixtures import documents, empty, text


def plain_targets(sizes: list[int]) -> list[float]:
    """Deals by weight, caps, and deals the excess again, until nothing is above."""
    weights, out = [(5, 2, 1)[k % 3] for k in range(len(sizes))], [0.0] * len(sizes)
    left, free = 1.5 * sum(sizes), set(range(len(sizes)))
    while free:
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = {k for k in free if share[k] > 2 * sizes[k]}
        for k in over or free:
            out[k] = 2.0 * sizes[k] if over else share[k]
        left -= sum(out[k] for k in over)
        free -= over or free
    return out


def check_mix(rows, docs):
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sources = sorted({r.source for r in docs}, key=lambda s: (s is None, (s or "").encode()))
    totals = {s: sum(size(r.text) for r in docs if r.source == s) for s in sources}
    wanted = dict(zip(sources, plain_targets([totals[s] for s in sources]), strict=True))
    source = {r.doc_id: r.source for r in docs}
    taken = dict.fromkeys(sources, 0)
    for r in rows:
        s = source[r.doc_id]
        assert (r.source_size, r["size"] >= 0) == (totals[s], True) and math.isclose(r.target, wanted[s], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(taken[s] == math.floor(wanted[s]) for s in sources)


def test_mix_meets_targets_to_the_word(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 8)
    monkeypatch.setattr(mixing, "GROUP_BLOCKS", 2)
    docs = documents(spark, 90)
    mixed = mixing.mix(docs, shard_words=5000)
    rows = mixed.collect()
    assert len(rows) == docs.count()
    check_mix(rows, docs.collect())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7), shard_words=5000).collect()))
    shards = {d.shard for r in rows for d in r.draws}
    assert len(shards) > 4 and all(r.taken == sum(d.words for d in r.draws) and len({d.epoch for d in r.draws}) == len(r.draws) for r in rows)
    out = mixing.shard_rows(docs.dropDuplicates(["doc_id"]), mixed.dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")).collect()
    assert all(len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) == r.words for r in out)
    assert mixing.mix(empty(spark)).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("doc_id = 5000")).collect()] == [0]


def test_splitting_tree_deals_every_block_once():
    quotas = np.array([37, 0, 5, 1000, 1])
    parts = [mixing.shard_quotas(quotas, 16, s, 7) for s in range(16)]
    totals = [int(n.sum()) for _, n in parts]
    assert sum(totals) == quotas.sum() and max(totals) - min(totals) <= 1
    for k, q in enumerate(quotas):
        taken = sorted(x for first, n in parts for x in range(first[k], first[k] + n[k]))
        assert taken == list(range(q))
    for n in (1, 2, 9, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3)) == list(range(n))
    a, b = (mixing.permuted(np.arange(1000), 1000, seed) for seed in (3, 4))
    assert (a == b).mean() < 0.02 and len(set(np.diff(a).tolist())) > 300 and (mixing.permuted(np.arange(40, 60), 1000, 3) == a[40:60]).all()


def test_shards_draw_what_the_tree_deals_them(spark):
    """Block by block: each shard's blocks of each source are its quota, in the source's permuted order, and each (epoch, block) is dealt once."""
    sources, quotas, shards, seed = [(10, 2), (7, 0), (3, 1)], [23, 5, 3], 8, 42
    found = mixing._deal(spark, sources, quotas, shards, seed).collect()
    dealt = sorted((r.number, x.epoch, r.block, x.shard) for r in found for x in r.shards)
    wanted = []
    for shard in range(shards):
        first, number = mixing.shard_quotas(np.array(quotas), shards, shard, seed)
        for k, (n, _) in enumerate(sources):
            order = mixing.permuted(np.arange(quotas[k]), quotas[k], seed + k)[first[k] : first[k] + number[k]]
            wanted += [(k, int(x) // n, int(x) % n, shard) for x in order]
    assert dealt == sorted(wanted) and len({x[:3] for x in dealt}) == sum(quotas)


def test_taken_words_are_those_of_the_blocks_drawn(spark):
    """On documents all of one size, a source's draws are whole blocks: which ones follows from the tree, and taken from them."""
    rows = [(k, "word " * 10, f"s{k % 2}") for k in range(4000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    blocks = {}
    for r in mixed:
        assert r.taken == sum(d.words for d in r.draws)
        for d in r.draws:
            blocks.setdefault((r.doc_id % 2, d.epoch, d.block), set()).add(d.shard)
    assert all(len(s) == 1 for s in blocks.values()) and len({min(s) for s in blocks.values()}) == 16


def rotate_plainly(rows: list[tuple]) -> dict:
    """(conversation, perspective) -> (text, spans) for conversations of one segment."""
    out = {}
    seen = sorted(set(rows), key=lambda r: tuple((x is not None, x) for x in r[1:]))
    for c, who in {(r[0], r[2]) for r in rows if r[2] not in (None, "system")}:
        whole, spans = "", []
        for _, _, role, body in (r for r in seen if r[0] == c):
            name = re.sub(r"[<|>\s]+", "_", role or "unknown")
            head = "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user {name}|>\n"
            body = (body or "").replace("<|", "< |")
            if role == who:
                spans.append(f"{len(whole) + len(head)}-{len(whole) + len(head) + len(body)}")
            whole += head + body + "\n"
        out[c, who] = (whole, ",".join(spans))
    return out


def test_rotation_matches_a_plain_version(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|assistant|> \U0001f600"), (1, 2, "bob", "Hello"), (1, 3, "ann", None), (1, 3, "ann", "tie"), (1, 3, "bob", "tie"), (1, None, "cy <x>", "late"),
            (2, 0, "ann", ""), (3, 0, None, "who?"), (3, 1, "system", "x"), (None, 0, "ann", "lost"), (1, 2, "bob", "Hello")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segment", "2 AS part", "3 AS copies")
    found = chat_rotation.rotate(frame).collect()
    wanted = rotate_plainly([(c, t, r, x) for c, t, r, x in rows])
    pieces = {}
    for r in sorted(found, key=lambda r: r.segment):
        before, spans = pieces.get((r.conv_id, r.perspective), ("", ""))
        moved = [f"{int(a) + len(before)}-{int(b) + len(before)}" for a, b in (x.split("-") for x in r.mask_spans.split(",") if x)]
        pieces[r.conv_id, r.perspective] = (before + r.text, ",".join(filter(None, [spans, *moved])))
    assert pieces == wanted
    assert {r.n_repeats for r in found if r.conv_id == 1 and r.segment == 0} == {1}
    assert chat_rotation.rotate(frame.limit(0)).count() == 0


def test_crowded_segments_keep_their_order_as_in_sql(spark):
    rows = [(1, k // 3, ("ann", "bob", "system")[k % 3], f"m{k:04}") for k in range(700)] + [(1, 400, "ann", "later")] + [(None, None, "cy", f"n{k:04}") for k in range(1100)] + [(2, 5, "ann", "short")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = chat_rotation.rotate(frame).collect()
    connection = duckdb.connect()
    conversations = frame.toArrow()  # noqa: F841
    cursor = connection.execute(ORACLES["op8_chat_rotation"])
    names = [d[0] for d in cursor.description]
    assert sorted((str(r[c]) for c in names) and tuple(str(r[c]) for c in names) for r in found) == sorted(tuple(map(str, r)) for r in cursor.fetchall())
    parts = sorted((r for r in found if r.conv_id == 1 and r.perspective == "ann"), key=lambda r: (r.segment, r.part))
    assert len(parts) == 3 and re.findall(r"m\d+", "".join(r.text for r in parts)) == [f"m{k:04}" for k in sorted(range(700), key=lambda k: (k // 3, k % 3))]


def test_long_conversations_come_in_segments(spark):
    rows = [(1, t, f"p{t % 2}", f"word{t}") for t in range(100)] + [(2, 0, "a", f"crowd{k}") for k in range(60)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_rotation.rotate(frame, segment_turns=10).collect()
    assert max(r.n_turns for r in found) < 40
    for who in ("p0", "p1"):
        whole = "".join(r.text for r in sorted((r for r in found if r.perspective == who), key=lambda r: r.segment))
        assert re.findall(r"word\d+", whole) == [f"word{t}" for t in range(100)]
    assert sorted(re.findall(r"crowd\d+", "".join(r.text for r in found if r.conv_id == 2))) == sorted(f"crowd{k}" for k in range(60))


def test_stages_take_effect(spark, tmp_path):
    """run() against each decision made by itself on what the stage before it left."""
    docs = documents(spark, 40).select("doc_id", "text", "lang", "source", "n_chars")
    more = [(7000 + k, f"Well, word{k} went home. You are an idiot and a worthless moron, idiot.", None, "s1", None) for k in range(6)]
    more += [(7100 + k, " ".join(f"%%{k}{j}$$" for j in range(60)), None, "s2", None) for k in range(6)] + [(7200, text(random.Random(99), 20), None, "s1", None)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7000 + k, 1, 1) for k in range(6)] + [(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, more[-1][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("labels", "benchmark"))
    left = docs.collect()
    frame = lambda: spark.createDataFrame(left, docs.schema)
    scorer = toxicity.fit(frame(), labels)
    left = [r for r in left if scorer.score([r.text])[0] < 0.3]
    assert not any(r.doc_id and 7000 <= r.doc_id < 7100 for r in left) and len(left) == docs.count() - 6
    judge = quality.fit(frame())
    left = [r for r in left if judge.score((r.text or "").encode()) >= 0.5]
    assert not any(r.doc_id and 7100 <= r.doc_id < 7200 for r in left)
    kept = {r.doc_id for r in superminhash.near_duplicates(frame()).collect() if r.kept}
    left = list({str(r): r for r in left if r.doc_id is None or r.doc_id in kept}.values())
    dirty = {r.doc_id for r in decontaminate.find_contamination(frame(), bench).collect() if r.contaminated}
    assert dirty == {7200}
    left = [r for r in left if r.doc_id not in dirty]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in left)
    check_mix(found, left)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "mixing"]


@pytest.mark.parametrize("place", range(5))
def test_stages_take_empty_documents(spark, tmp_path, place):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    found = corpus_pipeline.STAGES[place][1](spark, docs, str(tmp_path))
    assert found.count() == 0 and (place == 4 or found.columns == docs.columns)
