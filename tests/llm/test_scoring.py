"""Toxicity, quality and main text: held-out accuracy on labelled data, and defined results for awkward rows."""

from __future__ import annotations

import itertools
import math
import os
import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from graphloom.llm import html_extract, quality, toxicity
from tests.llm.fixtures import documents, empty

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are absent")


def test_grammar_reads_clauses():
    grammar = toxicity.Grammar({"idiot": 4.0, "blockh*": 3.0})
    assert grammar.run("you are an idiot") == grammar.run("an idiot is what you are") == {"targeted": 6.0}
    assert grammar.run("what an idiot") == {"plain": 2.0}
    assert grammar.run("an idiot and then six or seven more words about you") == {"plain": 2.0}
    assert grammar.run("that is not an idiot") == grammar.run("you are not an idiot") == {"negated": 2.0}
    assert grammar.run("mary said what an idiot") == {"reported": 2.0}
    assert grammar.run("a blockhead in a blockhouse") == {"plain": 1.5, "piled": 3.0}
    assert grammar.run("i will kill you") == {"threat": 4.5}
    assert grammar.run("i will kill time") == grammar.run("i will not kill you") == grammar.run("she said kill you") == {}
    assert grammar.clauses("fine. an idiot, yes! idiotic sidiot") == [" an idiot, yes", " idiotic sidiot"]
    assert grammar.features(None) == grammar.features("") == [0.0] * 10


def paths(transducer: toxicity.Transducer, symbols: list[str]):
    """Every (symbols written, factors) that a transducer accepts symbols with."""
    found = [(transducer.start, (), ())]
    for x in symbols:
        found = [(after, (*out, written), (*factors, factor)) for state, out, factors in found for written, factor, after in transducer.arcs.get((state, x), ())]
    return [(out, factors) for state, out, factors in found if state in transducer.finals]


def test_composition_equals_every_path_of_the_cascade():
    rng, cascade = np.random.default_rng(8), [toxicity.negation(), toxicity.reported_speech(), toxicity.target(), toxicity.threat(), toxicity.insult()]
    for _ in range(300):
        marks = rng.choice(toxicity.MARKS, rng.integers(0, 9), p=[0.4, 0.12, 0.1, 0.08, 0.18, 0.12]).tolist()
        weights = [float(rng.integers(1, 5)) if m in toxicity.WEIGHTED else 0.0 for m in marks]
        readings = [(tuple(marks), (1.0,) * len(marks))]
        for transducer in cascade:
            readings = [(out, tuple(np.multiply(before, factors).tolist())) for symbols, before in readings for out, factors in paths(transducer, list(symbols))]
        best, values = None, set()
        for out, factors in readings:
            total = sum(f * w for f, w in zip(factors, weights, strict=True))
            if best is None or total > best + 1e-9:
                best, values = total, set()
            if abs(total - best) < 1e-9:
                sums = {}
                for symbol, f, w in zip(out, factors, weights, strict=True):
                    if f * w:
                        sums[symbol] = sums.get(symbol, 0.0) + f * w
                values.add(tuple(sorted(sums.items())))
        found = toxicity.composed().best(marks, weights)
        assert abs(sum(found.values()) - best) < 1e-9 and tuple(sorted(found.items())) in values


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {k % 40}") for k in range(400)] + [(3, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (1, 0)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, 7).collect()
    assert len(rows) == 7 and len({(r.doc_id, r.text) for r in rows}) == 7
    assert len(toxicity.training_rows(docs, labels).collect()) == 41


@needs_data
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.fit(docs, labels)
    held = toxicity.score(docs, scorer).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in held if r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.6
    assert sum(r.predicted for r in held if not r.toxic) / (len(held) - len(toxic)) < 0.05
    rows = documents(spark)
    found = toxicity.score(rows, scorer).collect()
    assert len(found) == rows.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert [r.held_out for r in found if r.doc_id is None] == [False]
    kept = toxicity.without_toxic(rows, scorer)
    assert kept.columns == rows.columns and kept.count() == sum(1 - r.predicted for r in found)
    assert toxicity.score(empty(spark), scorer).count() == 0
    assert toxicity.flagged_clauses(docs, scorer).where("weight > 0").count() > 0


def test_toxicity_without_labels_weighs_the_seed_grammar(spark):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    scorer = toxicity.fit(documents(spark), labels)
    found = scorer.score(["you idiot, you worthless idiot!", "a fine day", None])
    assert found[0] > 0.3 > found[1] == found[2]


def test_expectation_maximisation_finds_the_labellers():
    rng = np.random.default_rng(1)
    n, right = 20_000, np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.92, 0.88, 0.9, 0.85, 0.8])
    truth = rng.random(n) < 0.8
    votes = np.where(rng.random((n, len(right))) < right, truth[:, None], ~truth[:, None])
    votes = np.where(votes, 1, -1)
    votes[:, : quality.DETECTORS] = np.minimum(votes[:, : quality.DETECTORS], 0)
    votes[:, quality.DETECTORS :] *= rng.random((n, len(right) - quality.DETECTORS)) < 0.7
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, accuracy, share = quality.expectation_maximisation(patterns, counts.astype(float))
    near = np.abs(accuracy - right)  # the prior draws the detectors towards quality.PRIOR, not the others
    assert abs(share - 0.8) < 0.05 and near[: quality.DETECTORS].max() < 0.2 and near[quality.DETECTORS :].max() < 0.06
    guess = {tuple(p): x > 0.5 for p, x in zip(patterns.tolist(), posterior, strict=True)}
    assert np.mean([guess[tuple(v)] == t for v, t in zip(votes.tolist(), truth, strict=True)]) > 0.95


@needs_data
def test_quality_agrees_with_labels_it_never_saw(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    scorer = quality.fit(docs)
    found = quality.score(docs, scorer).join(labels, "doc_id").collect()
    assert np.mean([r.good == bool(r.quality) for r in found]) > 0.95
    assert np.mean([r.good for r in found if r.quality]) > 0.98
    freer = quality.score(docs, quality.fit(docs, prior_weight=0.1)).join(labels, "doc_id").collect()
    assert np.mean([r.good == bool(r.quality) for r in freer]) > 0.95  # the prior only tells which of the two labels is the bad one
    rows = documents(spark)
    assert quality.score(rows, scorer).count() == rows.count()
    kept = quality.without_poor(rows, scorer)
    assert kept.columns == rows.columns
    assert quality.score(empty(spark), quality.fit(empty(spark))).count() == 0


PAGES = [
    ("<html><body><nav><a href=/>Home</a> <a href=/b>About us</a></nav><article><h1>A title &amp; more</h1><p>First,  some\n text.<p>Second <b>bold</b> text.<br>Next line.</article><footer>&copy; Someone</footer></body></html>", "A title & more\n\nFirst, some text.\n\nSecond bold text. Next line."),
    ("<body><header>Site name</header><main><p>One sentence here, with words.</p><aside class=related><h3>More</h3><p>Read also this, please.</p></aside><p>And another one, at last.</p></main><div id=comments class=comments><p>I disagree, says a reader.</p></div></body>", "One sentence here, with words.\n\nAnd another one, at last."),
    ("<body><div class='cookie-banner'>We use cookies, do you agree?</div><div class=content><h1>News</h1><p>What happened today, in short.</p><script>var x = '<p>no</p>';</script><style>p{}</style></div><form><label>Mail</label><button>Go</button></form></body>", "News\n\nWhat happened today, in short."),
]


def test_main_text_of_pages():
    model = html_extract.default_model()
    for html, wanted in PAGES:
        assert model.text(html) == wanted
    for odd in (None, "", "<", "<p", "<!-- open", "<a title=\"x", "<script>alert(1)", "</p></div>", "&", "<p><p><p>", "<" * 3000, "<div>" * 3000):
        assert isinstance(model.text(odd), str)


def test_element_accuracy_on_other_pages():
    model, right, total = html_extract.default_model(), 0, 0
    for html in html_extract.labelled_pages(40, seed=123):
        page = html_extract.Page(html, html_extract.LABEL)
        labels = [0]
        for k in range(1, len(page.tags)):
            labels.append(labels[page.parents[k]] if page.labels[k] is None else page.labels[k])
        right += sum((b > 0) == bool(y) for b, y in zip(model.content(page), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


ODD = [
    ('<article><p data-content="tooltip text">One paragraph, long enough to be read.</p><p data-content="0">Another, which is content as well.</p></article>', "One paragraph, long enough to be read.\n\nAnother, which is content as well."),
    ("<article><p>First one, with an icon. <svg/></p><p>Second one, after the icon.</p></article>", "First one, with an icon.\n\nSecond one, after the icon."),
    ("<article><p>First one, with a drawing. <svg><text>axis</text></svg></p><p>Second one, after it.</p></article>", "First one, with a drawing.\n\nSecond one, after it."),
    ("<html><head><title>No</title><meta charset=utf-8><header>Site</header><article><p>An article, in a page of open tags.</p></article>", "An article, in a page of open tags."),
    ("<article><object><p>Text in an element, never closed.</p></article>", "Text in an element, never closed."),
    ("<article><p>Before it, a <iframe/> frame.</p><p>And then, more text.</p></article>", "Before it, a frame.\n\nAnd then, more text."),
]


def test_odd_markup_loses_nothing():
    model = html_extract.default_model()
    for html, wanted in ODD:
        assert model.text(html) == wanted


@pytest.mark.parametrize("html", ["<div>" * 20_000 + "</p>" * 20_000, "<div>" * 20_000 + "<li></li>" * 20_000, "<svg>" * 20_000 + "x", "<html>" * 20_000, "</div>" * 20_000, "<p><b>" * 20_000])
def test_deep_and_unmatched_markup_is_linear(html):
    model, begin = html_extract.default_model(), time.process_time()
    model.text(html)
    assert time.process_time() - begin < 3


class Reader(HTMLParser):
    """A plain reader of labelled pages: the text of block elements whose nearest label is 1."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks, self.piece, self.hidden = [("html", "0")], [], "", 0

    def cut(self):
        line = " ".join(self.piece.split())
        if line and self.stack[-1][1] == "1":
            self.blocks.append(line)
        self.piece = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("title", "script", "style"):
            self.hidden += 1
        elif tag in ("br", "input", "img"):
            self.piece += " "
        elif tag in html_extract.BLOCKS:
            self.cut()
            while self.stack[-1][0] == "p":
                self.stack.pop()
            self.stack.append((tag, dict(attrs).get(html_extract.LABEL) or self.stack[-1][1]))

    def handle_endtag(self, tag):
        if tag in ("title", "script", "style"):
            self.hidden -= 1
        elif tag in html_extract.BLOCKS:
            self.cut()
            while tag in [t for t, _ in self.stack] and self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.piece += "" if self.hidden else data


def test_texts_equal_what_a_plain_reader_of_the_labels_takes():
    model, same, pages = html_extract.default_model(), 0, html_extract.labelled_pages(150, seed=77)
    for html in pages:
        reader = Reader()
        reader.feed(html)
        reader.close()
        same += model.text(re.sub(r' data-content="[01]"', "", html)) == "\n\n".join(reader.blocks)
    assert same >= 0.9 * len(pages)


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(0)
    parents, scores = [-1, 0, 0, 1, 1, 4, 2], rng.standard_normal(7).tolist()
    model = html_extract.Model({}, rng.standard_normal((2, 2)).tolist())
    weight = {y: math.exp(sum(s for s, v in zip(scores, y, strict=True) if v) + sum(model.pair[y[p]][y[k]] for k, p in enumerate(parents) if k)) for y in itertools.product((0, 1), repeat=7)}
    for k, belief in enumerate(model.beliefs(parents, scores)[0]):
        share = sum(w for y, w in weight.items() if y[k]) / sum(weight.values())
        assert abs(1 / (1 + math.exp(-belief)) - share) < 1e-9


def test_pages_table(spark):
    rows = [(k, f"u{k}", h) for k, (h, _) in enumerate(PAGES)] + [(8, None, None), (9, "u", ""), (None, "u", PAGES[0][0]), (0, "u0", PAGES[0][0]), (10, "u", "<p>" + "long, text. " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    found = html_extract.extract(pages).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    assert {r.page_id: r.text for r in found if r.page_id in (8, 9)} == {8: "", 9: ""}
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html, wanted",
    [
        ("<p>One two.</p><!--><p>Three four.</p>", ["One two.", "Three four."]),
        ("<p>One.</p><!---><p>Two.</p><!-- a --!><p>Three.</p><!-- b --><p>Four.</p>", ["One.", "Two.", "Three.", "Four."]),
        ("<p>One <select><option>Pick me</select> two <button>Click</button> three.</p>", ["One two three."]),
        ("<object data=x><p>In its place.</p></object><noscript><p>Without scripts.</p></noscript>", ["In its place.", "Without scripts."]),
        ("<p>A <svg><svg><title>in</title></svg><text>label</text></svg> b <svg/> c</p>", ["A b c"]),
        ("<p>A <?php if (1 > 0) echo '>' ?> b</p>", ["A b"]),
        ("<p>A <?php b</p><p>c</p>", ["A", "c"]),
    ],
)
def test_markup_that_holds_no_text(html, wanted):
    assert [text for _, text, _ in html_extract.Page(html).runs] == wanted


@pytest.mark.parametrize("piece", ["<a", "<a ", "<!--", "<svg ", "<svg><svg>", "<?php ", "<a b='", "<select>", "</"])
def test_a_megabyte_of_markup_takes_little_time(piece):
    begin = time.process_time()
    html_extract.Page(piece * (1_000_000 // len(piece)))
    assert time.process_time() - begin < 5
