"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree of block elements; an edge potential ties each to its parent, a node potential
sums learned weights of its tag, class and id words, links and text. Sum-product messages, once up and
once down the tree, give each element's exact probability of being content; blocks of text whose
element is content are the main text. All weights come from labelled pages by exact-gradient ascent.

Defined results: null and empty html give an empty text. No html is refused: unclosed elements, quotes,
comments, scripts and styles end with the page, other silent elements that are never closed hide nothing,
closing tags without an opening one are ignored. Labels are read from pages by the trainer alone, never
from the pages extracted. Character references are decoded, white space within a block becomes one space,
and blocks are joined in page order by two newlines. Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import map_batches

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][-\w:]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_PART = re.compile(r"[a-z]+")
#: HTML's block elements, elements whose content is no text, elements without content, and what closes what.
BLOCKS = set(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav header footer aside form fieldset figure figcaption "
    "blockquote pre address details summary dialog hgroup search center button select option label".split()
)
SILENT = set("script style title textarea template iframe svg math select button datalist".split())
#: Of these, what is text to the end of the page if never closed; and what a slash in the tag closes.
RAW, SELF_CLOSED = set("script style textarea".split()), set("svg math".split())
#: And what may hold its like.
NESTED = set("svg math template".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Words of class, id and role that tell an element's part.
PARTS = {
    "content": "content article post entry story body main text prose copy page",
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs toc tabs pager pagination skip",
    "side": "sidebar side aside widget related recommended trending popular complementary rail",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense outbrain",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay warning toast newsletter subscribe signup paywall",
    "comment": "comment comments reply replies respond disqus discussion",
    "foot": "footer foot copyright legal contentinfo colophon credits",
    "head": "header masthead logo topbar brand",
    "share": "share sharing social follow likes tags",
    "form": "form search login searchbox",
    "hidden": "hidden sr visually invisible",
}
#: Elements that tell the part of what they hold.
_TELLING = set("article main nav aside header footer form dialog".split())
#: The attribute in which labelled pages say what is content.
LABEL = "data-content"
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in SILENT}
_TAGS = {tag: re.compile(rf"<(/?){tag}(?=[\s/>]|\Z)[^>]*", re.I) for tag in NESTED}
_CODE = re.compile(r"<\?(?:php|=)", re.I)
_PART_OF = {word: part for part, words in PARTS.items() for word in words.split()}


def _end_of(tag: str, html: str, at: int) -> int | None:
    """Where the element without text that began before `at` ends, its like within it left out; None if it doesn't."""
    if tag not in NESTED:
        end = _ENDS[tag].search(html, at)
        return end.start() if end else None
    depth = 1
    for m in _TAGS[tag].finditer(html, at):
        depth += -1 if m[1] else 0 if m[0].endswith("/") else 1
        if not depth:
            return m.start()
    return None


def without_code(html: str) -> str:
    """A page without <?php ... ?> and <?= ... ?>; what is never closed stays."""
    kept, at = [], 0
    while True:
        begin = _CODE.search(html, at)
        end = html.find("?>", begin.end()) if begin else -1
        if end < 0:
            return "".join(kept) + html[at:] if kept else html
        kept.append(html[at : begin.start()])
        at = end + 2


class Page:
    """Block elements in page order, and the runs of text directly in them; labels are what the attribute label_name holds, if one is named."""

    def __init__(self, html: str, label_name: str | None = None):
        self.tags, self.parents, self.parts, self.labels = ["html", "body"], [-1, 0], [frozenset()] * 2, [None] * 2  # tags of these two may be left out
        self.runs: list[tuple[int, str, int]] = []  # element, text, characters of it in links
        self._stack, self._pieces, self._linked, self._link = [0, 1], [], 0, None
        self._opened, self._label_name = Counter(), label_name
        self._parse(without_code(html) if "<?" in html else html)

    def _parse(self, html: str) -> None:
        at, unclosed = 0, set()
        while at < len(html):
            m = _TOKEN.search(html, at)
            self._text(html[at : m.start() if m else len(html)])
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._close(tag)
            elif tag in SILENT:
                if tag in unclosed or (tag in SELF_CLOSED and (m[3] or m[6] or "").endswith("/")):
                    continue
                end = _end_of(tag, html, at)
                if end is not None:
                    at = end
                elif tag in RAW:
                    at = len(html)
                else:
                    unclosed.add(tag)
            elif tag == "a":
                self._link = self._stack[-1]
            elif tag in ("br", "hr", "img", "input"):
                self._pieces.append(" ")
                if tag == "hr":
                    self._end_run()
            elif tag in BLOCKS and tag not in ("html", "body"):
                self._open(tag, m[3] or m[6] or "")
        self._end_run()

    def _text(self, raw: str) -> None:
        if raw:
            text = references.unescape(raw) if "&" in raw else raw
            self._pieces.append(text)
            if self._link is not None:
                self._linked += len(text.strip())

    def _end_run(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                self.runs.append((self._stack[-1], text, min(self._linked, len(text))))
        self._pieces, self._linked = [], 0

    def _pop(self, depth: int) -> None:
        self._end_run()
        if self._link in self._stack[depth:]:
            self._link = None
        self._opened.subtract(self.tags[k] for k in self._stack[depth:])
        del self._stack[depth:]

    def _open(self, tag: str, attributes: str) -> None:
        self._end_run()
        ends = CLOSES.get(tag, ())
        reach = 1 if any(self._opened[x] for x in ends) else max(1, len(self._stack) - 2)
        for depth in range(len(self._stack) - 1, reach, -1):
            open_tag = self.tags[self._stack[depth]]
            if open_tag == "p" or open_tag in ends:
                self._pop(depth)
                if open_tag != "p":
                    break
            elif open_tag in LISTS.get(tag, ()) or tag not in CLOSES:
                break
        parts, label = set(), None
        for name, *values in _ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
            value, name = next((v for v in values if v), ""), name.lower()
            if name in ("class", "id", "role"):
                parts |= {_PART_OF[w] for w in _PART.findall(value.lower()) if w in _PART_OF}
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                parts.add("hidden")
            if name == self._label_name:
                label = int(value)
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.parts.append(frozenset(parts))
        self.labels.append(label)
        self._opened[tag] += 1
        self._stack.append(len(self.tags) - 1)

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._link = None
        elif tag in BLOCKS and self._opened[tag]:
            for depth in range(len(self._stack) - 1, 1, -1):
                if self.tags[self._stack[depth]] == tag:
                    self._pop(depth)
                    return

    def features(self) -> list[list[str]]:
        """Names of what holds of each element."""
        n = len(self.tags)
        own, linked, marks = [0] * n, [0] * n, [0] * n
        for element, text, in_links in self.runs:
            own[element] += len(text)
            linked[element] += in_links
            marks[element] += text.count(".") + text.count(",")
        whole, all_linked = own[:], linked[:]
        for k in range(n - 1, 0, -1):
            whole[self.parents[k]] += whole[k]
            all_linked[self.parents[k]] += all_linked[k]
        out, within = [], [frozenset()] * n
        for k in range(n):
            parent = self.parents[k]
            if k:
                told = {self.tags[parent]} & _TELLING | self.parts[parent]
                within[k] = within[parent] | told if told else within[parent]
            names = [f"tag {self.tags[k]}", *(f"part {p}" for p in sorted(self.parts[k])), *(f"in {p}" for p in sorted(within[k]))]
            if own[k]:
                names.append("text " + ("short" if own[k] < 30 else "middle" if own[k] < 120 else "long"))
                if marks[k]:
                    names.append("sentence")
            if whole[k]:
                share = all_linked[k] / whole[k]
                names.append("links " + ("none" if share == 0 else "few" if share < 0.3 else "some" if share < 0.7 else "most"))
            out.append(names)
        return out


class Model:
    """Weights of features, and of (parent, child) labels."""

    def __init__(self, weights: dict[str, float], pair: list[list[float]]):
        self.weights, self.pair = weights, pair

    def beliefs(self, parents: list[int], scores: list[float]) -> tuple[list[float], list[float], list[float]]:
        """(log-odds of content, what comes up from each element, what it sends its parent): one sweep up, one down."""
        (p00, p01), (p10, p11) = self.pair
        up, sent = scores[:], [0.0] * len(scores)
        for k in range(len(scores) - 1, 0, -1):
            sent[k] = _log_ratio(p10, p11, p00, p01, up[k])
            up[parents[k]] += sent[k]
        belief = up[:]
        for k in range(1, len(scores)):
            belief[k] = up[k] + _log_ratio(p01, p11, p00, p10, belief[parents[k]] - sent[k])
        return belief, up, sent

    def content(self, page: Page) -> list[float]:
        """The log-odds of content of each element of a page."""
        scores = [sum(self.weights.get(name, 0.0) for name in names) for names in page.features()]
        return self.beliefs(page.parents, scores)[0]

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        page = Page(html)
        if not page.runs:
            return ""
        content = self.content(page)
        return "\n\n".join(text for element, text, _ in page.runs if content[element] > 0)


def _log_ratio(a: float, b: float, c: float, d: float, x: float) -> float:
    """log((e^a + e^(b+x)) / (e^c + e^(d+x)))"""
    x = max(-60.0, min(60.0, x))
    top, low = max(a, b + x), max(c, d + x)
    return top - low + math.log1p(math.exp(-abs(a - b - x))) - math.log1p(math.exp(-abs(c - d - x)))


def fit(pages: list[str], rounds: int = 120, rate: float = 0.5, decay: float = 2e-3) -> Model:
    """Maximises the likelihood of pages whose block elements carry LABEL="1" or "0"; one without takes its parent's, the root 0."""
    model, parsed = Model({}, [[1.0, -1.0], [-1.0, 1.0]]), []
    for html in pages:
        page = Page(html, LABEL)
        labels = [0]
        for k in range(1, len(page.tags)):
            labels.append(labels[page.parents[k]] if page.labels[k] is None else page.labels[k])
        parsed.append((page, page.features(), labels))
    speed: dict[object, float] = {}
    total = sum(len(labels) for _, _, labels in parsed)
    for _ in range(rounds):
        slope: dict[object, float] = {}
        for page, features, labels in parsed:
            scores = [sum(model.weights.get(name, 0.0) for name in names) for names in features]
            belief, up, sent = model.beliefs(page.parents, scores)
            for k, names in enumerate(features):
                error = labels[k] - 1 / (1 + math.exp(-max(-60.0, min(60.0, belief[k]))))
                for name in names:
                    slope[name] = slope.get(name, 0.0) + error
                if k:
                    parent = page.parents[k]
                    rest = belief[parent] - sent[k]
                    joint = [model.pair[a][b] + a * rest + b * up[k] for a in (0, 1) for b in (0, 1)]
                    most = max(joint)
                    joint = [math.exp(x - most) for x in joint]
                    whole = sum(joint)
                    for place, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                        slope[a, b] = slope.get((a, b), 0.0) + (labels[parent] == a and labels[k] == b) - joint[place] / whole
        for key, value in slope.items():
            old = model.pair[key[0]][key[1]] if isinstance(key, tuple) else model.weights.get(key, 0.0)
            speed[key] = 0.9 * speed.get(key, 0.0) + rate * (20 * value / total - decay * old)
            if isinstance(key, tuple):
                model.pair[key[0]][key[1]] = old + speed[key]
            else:
                model.weights[key] = old + speed[key]
    return model


def labelled_pages(n: int = 120, seed: int = 5) -> list[str]:
    """Pages of many layouts whose elements are labelled; the words are filler, only the layouts matter."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("la", "te", "ron", "mi", "sa", "vel")) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    prose = lambda a, b: rng.choice((", ", ", ", ". ", " ")).join(words(3, 9) for _ in range(max(1, rng.randint(a, b) // 6))) + rng.choice((".", ".", ""))
    links = lambda n: "".join(f'<li><a href="/x">{words(1, 2)}</a></li>' for _ in range(n))
    box = lambda tag, mark, inner: f'<{tag} data-content="0"{mark}>{inner}</{tag}>'
    name = lambda part: rng.choice(('class="{}"', 'id="{}"')).format(rng.choice(PARTS[part].split()))

    def noise(kind: str) -> str:
        lines = "".join(f"<p>{prose(4, 40)}</p>" for _ in range(rng.randint(1, 3)))
        either = rng.choice((lines, prose(3, 30), f"<ul>{links(4)}</ul>"))
        return {
            "nav": lambda: box(rng.choice(("nav", "div", "ul")), rng.choice(("", " " + name("menu"))) if rng.random() < 0.5 else f" {name('menu')}", f"<ul>{links(rng.randint(3, 9))}</ul>"),
            "header": lambda: box("header", rng.choice(("", f" {name('head')}")), rng.choice((f"<div>{words(1, 3)}</div>", f"<div>{words(1, 3)}</div>", words(1, 4))) + rng.choice(("", f"<nav><ul>{links(4)}</ul></nav>"))),
            "footer": lambda: box(rng.choice(("footer", "footer", "div")), f" {name('foot')}", rng.choice((f"&copy; {words(1, 3)} &middot; {prose(3, 9)}", f"<p>{prose(4, 20)}</p><ul>{links(3)}</ul>"))),
            "plain footer": lambda: box("footer", "", rng.choice((f"&copy; {words(1, 3)} &middot; {prose(3, 20)}", f"<p>{prose(4, 20)}</p>"))),
            "aside": lambda: box("aside", rng.choice(("", f" {name('side')}")), rng.choice((f"<h3>{words(1, 3)}</h3>{either}", either))),
            "side": lambda: box("div", f" {name('side')}", rng.choice((f"<h3>{words(1, 3)}</h3>{either}", either))),
            "advert": lambda: box(rng.choice(("div", "div", "section", "p")), f" {name('advert')}", rng.choice((prose(3, 40), words(2, 9)))),
            "notice": lambda: box(rng.choice(("div", "section", "dialog")), f" {name('notice')}", rng.choice((prose(6, 40), f"<p>{prose(6, 40)}</p><button>{words(1, 2)}</button>"))),
            "comments": lambda: box(rng.choice(("section", "div")), f" {name('comment')}", f"<h3>{words(1, 2)}</h3>" + "".join(box(rng.choice(("div", "article", "li")), rng.choice(("", f" {name('comment')}")), f"<p>{prose(4, 60)}</p>") for _ in range(rng.randint(1, 4)))),
            "form": lambda: box("form", rng.choice(("", f" {name('form')}")), f"<label>{words(1, 3)}</label><input><button>{words(1, 1)}</button>" + rng.choice(("", f"<p>{prose(3, 12)}</p>"))),
            "share": lambda: box("div", f" {name('share')}", f"<ul>{links(3)}</ul>"),
            "hidden": lambda: box("div", rng.choice((" hidden", ' style="display:none"', ' aria-hidden="true"')), f"<p>{prose(4, 30)}</p>"),
        }[kind]()

    kinds = "nav header footer aside side advert notice comments form share hidden".split() + ["plain footer"]
    out = []
    for _ in range(n):
        blocks = [rng.choice((f"<h1>{words(2, 9)}</h1>", f"<h1>{words(1, 2)}.</h1>", f"<h1>{prose(6, 12)}</h1>"))] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            long = rng.choice(((1, 2), (3, 12), (10, 120)))
            blocks.append(
                f"<p>{prose(*long)}</p>" if kind < 0.6 else f"<p><b>{prose(*long)}<br>" if kind < 0.7 else f"<p>{prose(20, 60)} <a href='/x'>{words(1, 3)}</a> {prose(10, 30)}</p>" if kind < 0.78
                else f"<ul>{''.join(f'<li>{prose(2, 20)}</li>' for _ in range(3))}</ul>" if kind < 0.83 else f"<h2>{words(1, 6)}</h2>" if kind < 0.9 else f"<blockquote>{prose(6, 40)}</blockquote>" if kind < 0.93
                else f"<pre>{words(5, 30)}</pre>" if kind < 0.95 else f"<figure><img><figcaption>{prose(3, 12)}</figcaption></figure>" if kind < 0.97 else f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>"
            )
        inside = rng.sample([k for k in kinds if k not in ("header", "footer", "plain footer", "nav")], rng.randint(0, 2)) if rng.random() < 0.4 else []
        for kind in inside:
            blocks.insert(rng.randint(1, len(blocks)), noise(kind))
        root = rng.choice(("article", "article", "main", "main", "div", "section"))
        mark = "" if root in ("article", "main") and rng.random() < 0.7 else f" {name('content')}"
        content = f'<{root} data-content="1"{mark}>{"".join(blocks)}</{root}>'
        if rng.random() < 0.3:
            content = f'<div data-content="0" class="{rng.choice(("wrapper", "container", "row", "layout"))}">{content}{noise(rng.choice(("side", "aside")))}</div>'
        above = [noise(k) for k in ["header", "nav", "advert", "notice", "form"] if rng.random() < 0.5]
        below = [noise(k) for k in ["aside", "comments", "advert", "share", "hidden", rng.choice(("footer", "plain footer"))] if rng.random() < 0.55]
        out.append(f"<html><head><title>x</title></head><body>{''.join(above)}{content}{''.join(below)}</body></html>")
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages(page_id, url, html)."""
    model = model or default_model()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [model.text(html) for html in batch.column("html").to_pylist()]
        return pa.record_batch(
            {
                "page_id": batch.column("page_id").cast(pa.int64()),
                "url": batch.column("url").cast(pa.string()),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            }
        )

    return map_batches(pages, ["page_id", "url", "html"], run, "page_id long, url string, text string, n_chars long")
