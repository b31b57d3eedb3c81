"""Token counts, decontamination and licence scans against plain Python versions."""

from __future__ import annotations

import hashlib
import random
import re
import time

import public_tokenizers
import pytest

from graphloom.llm import decontaminate, license_scan, token_counts
from tests.llm.fixtures import WORDS, documents, empty, text

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(value: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), value or ""))


def encoder(chunk: int, overlap: int) -> token_counts.Encoder:
    return token_counts.Encoder(public_tokenizers.path("byte_bpe_50k.json"), chunk, overlap)


def library_count(value: str | None) -> int:
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(value or "", add_special_tokens=False).ids)


def test_tokens_match_the_library(spark):
    docs = documents(spark)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, encoder(2000, 64)).collect())
    wanted = []
    for r in docs.collect():
        n = library_count(r.text)
        wanted.append((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), n, n > 512))
    assert found == sorted(wanted)
    assert token_counts.count_tokens(empty(spark), encoder(2000, 64)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_chunks_splice_where_the_whole_text_would_break(seed):
    rng = random.Random(seed)
    pieces = ["it's", "we'll", "  ", "\n\n", "<|endoftext|>", "<|endof", "日本語", "1234567", "!!!???", " word", "x" * 90, " ", "é", "\U0001f600", "'", "'re", " "]
    value = "".join(rng.choice(pieces) for _ in range(900))
    for chunk, overlap in ((100, 40), (257, 33), (1000, 64)):
        assert encoder(chunk, overlap).long(value)[0] == library_count(value)
    assert encoder(50, 33).long("y" * 1000 + " z")[0] == library_count("y" * 1000 + " z")
    assert encoder(64, 32).count([value]) == [(library_count(value), encoder(64, 32).long(value)[1])]


@pytest.mark.parametrize("run", ["y" * 1_000_000, " " * 1_000_000, "ab1!" * 250_000, "\n" * 500_000 + "z" * 500_000])
def test_unbroken_runs_take_time_in_proportion(run):
    begin = time.process_time()
    found = token_counts.Encoder(public_tokenizers.path("byte_bpe_50k.json")).long(run)[0]
    assert time.process_time() - begin < 6 and found == library_count(run)


def brute_contamination(value: str | None, items: list[tuple[str | None, str | None]]):
    mine, hit, named = words(value), set(), set()
    for item, body in items:
        other = words(body)
        size = min(13, len(other))
        for k in range(len(other) - size + 1 if other else 0):
            for at in range(len(mine) - size + 1):
                if mine[at : at + size] == other[k : k + size]:
                    hit.update(range(at, at + size))
                    if item is not None:
                        named.add(str(item))
    digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
    return len(mine), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(mine)


@pytest.mark.parametrize("block", [2_000_000, 300, 90])
def test_contamination_matches_brute_force(spark, block):
    rng = random.Random(4)
    items = [(k, text(rng, n)) for k, n in enumerate((20, 13, 5, 30, 1, 14))] + [(90, None), (91, " .,"), (None, text(rng, 15)), (2, text(rng, 16))]
    rows = []
    for k in range(40):
        item = rng.choice(items)[1] or "none"
        cut = item.split()[rng.randint(0, 2) :]
        rows.append((k, f"{text(rng, rng.choice((0, 5, 300)))} {', '.join(cut).upper()}. {text(rng, 4)}"))
    rows += [(100, None), (101, ""), (102, "a" * 100_000), (None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS items", "2 AS n_hit")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.find_contamination(docs, bench, block_chars=block).collect()}
    assert found == {k: brute_contamination(t, items) for k, t in rows}
    clean = {r.doc_id for r in decontaminate.without_contaminated(docs, bench, block_chars=block).select("doc_id", "spans", "n_hit").collect()}
    assert clean == {k for k, v in found.items() if not v[4]}
    spans = decontaminate.contaminated_spans(docs, bench, block_chars=block).collect()
    whole = dict(rows)
    covered = {}
    for r in spans:
        covered[r.doc_id] = covered.get(r.doc_id, 0) + len(words(whole[r.doc_id][r.begin : r.end]))
    assert covered == {k: v[1] for k, v in found.items() if v[1]}
    assert decontaminate.find_contamination(empty(spark), bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_contamination_counts_words_where_it_scans_them(spark):
    docs = spark.createDataFrame([(1, "A b, c"), (2, None), (3, "é x")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "b c")], "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower()
    assert {r.doc_id: (r.n_words, r.n_hit) for r in found.collect()} == {1: (3, 2), 2: (0, 0), 3: (2, 0)}
    assert {r.doc_id: r.n_words for r in decontaminate.find_contamination(docs, bench.limit(0)).collect()} == {1: 3, 2: 0, 3: 2}


def test_licences_match_brute_force(spark):
    rng = random.Random(9)
    notices = [t for _, t in license_scan.TEMPLATES] + ["Under the MIT License, under the MIT licence; under the MIT license", "CC BY NC", "cc-by-nc cc by", "Apache License Version 2 version 2"]
    rows = [(k, f"{text(rng, rng.randint(0, 30))} {rng.choice(notices)} {text(rng, 5)} {rng.choice(notices).upper()}") for k in range(60)] + [(70, None), (71, ""), (72, "mit " * 50_000), (None, "cc by nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS labels", "'q' AS score")
    phrases = {tuple(p.split()): label for p, label in license_scan.PHRASES.items()}
    for r in license_scan.scan_licenses(docs).collect():
        mine = words(dict(rows)[r.doc_id])
        places = [(k, label) for p, label in phrases.items() for k in range(len(mine)) if tuple(mine[k : k + len(p)]) == p]
        assert (r.n_words, r.n_base, r.base_labels) == (len(mine), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    whole = license_scan.scan_licenses(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(license_scan.TEMPLATES)], "doc_id long, text string"))
    assert all(license_scan.TEMPLATES[r.doc_id][0] in r.labels.split(",") and r.score == 1.0 for r in whole.collect())
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def brute_chains(nodes, length):
    """The most words, less NEW_CHAIN a chain, over every order-keeping choice of nodes cut in chains."""
    best = 0
    for take in range(1 << len(nodes)):
        chosen = [x for k, x in enumerate(nodes) if take >> k & 1]
        for cuts in range(1 << max(0, len(chosen) - 1)):
            value, fine = 0, True
            for k, (last, first, end) in enumerate(chosen):
                if k == 0 or cuts >> (k - 1) & 1:
                    fine = fine and (k == 0 or first > chosen[k - 1][0])
                    value += min(last - first + 1, end + 1) - license_scan.NEW_CHAIN
                else:
                    more = license_scan.gain(chosen[k - 1], chosen[k], length)
                    fine, value = fine and more > 0, value + more
            best = max(best, value if fine else 0)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_chains_are_the_best(seed):
    rng = random.Random(seed)
    nodes = sorted({(last := rng.randint(2, 40), max(0, last - rng.randint(2, 8)), rng.randint(2, 15)) for _ in range(rng.randint(1, 6))})
    found = license_scan.best_chains(nodes, 16)
    assert sum(words - license_scan.NEW_CHAIN for _, _, words in found) == brute_chains(nodes, 16)
    assert all(a[1] < b[0] for a, b in zip(found, found[1:]))


def test_short_phrases_and_torn_notices(spark):
    docs = spark.createDataFrame([(1, "see isc terms"), (2, "Redistribution and use in source and binary forms, with or WITHOUT any modification, are permitted provided that these following conditions are met"), (3, "with or without fee")], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan_licenses(docs, phrases={"isc terms": "isc", "gpl": "gpl"}).collect()}
    assert (rows[1].n_base, rows[1].base_labels, rows[1].first_word) == (1, "isc", 1)
    assert rows[2].labels == "bsd" and len([s for s in rows[2].spans if s.label == "bsd" and s.coverage > 0.6]) == 1
    assert rows[3].labels == ""


def test_matching_statistics_match_brute_force():
    rng = random.Random(2)
    sequences = [[rng.randint(1, 3) for _ in range(rng.randint(1, 25))] for _ in range(6)]
    automaton = license_scan.SuffixAutomaton(sequences)
    value = [rng.randint(1, 4) for _ in range(200)]
    passages = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for k, (length, _) in enumerate(automaton.statistics(value)):
        assert length == max((n for n in range(1, k + 2) if tuple(value[k + 1 - n : k + 1]) in passages), default=0)
    assert WORDS
