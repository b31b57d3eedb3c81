"""Toxicity by a weighted finite-state pattern grammar.

Five transducers, tables of weighted arcs, read the marks of a clause's words one after the other: negation
marks what it reaches, reported speech what is said by others, the target transducer insults and threats
near someone (ahead or behind, which it guesses and has to prove), the threat transducer keeps the aimed
ones, the insult transducer tells lone insults from aimed and from repeated ones. Their composition is run
over every clause that an Aho-Corasick automaton finds a weighted unit in; the heaviest path is the clause's
reading. What insults weigh is learned: words and word beginnings of labelled training texts, by log-odds
over groups of like texts, and a logistic regression over the readings of a text's clauses gives its score.

Defined results: a null or empty text has no clauses and the score of such texts. Repeated rows each
give a row; a null doc_id is scored and not held out. Labels with a null doc_id or toxic are ignored; a
doc_id labelled twice is toxic if any label says so. Without labels, the seed grammar alone is weighed.
Other columns are ignored. Words and texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import filter_batches, map_batches
from graphloom.session import checkpointed

#: The closed word lists of the grammar, in four languages.
TARGETS = "you your yours yourself they them their he him she her we us du dich dir euch ihr sie tu te toi vous ils elles tú usted ustedes ellos ellas".split()
NEGATIONS = "not no never nor isn't aren't wasn't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says told called quoted wrote claimed sagte sagt schrieb dit disait écrit dijo dice escribió".split()
THREATS = dict.fromkeys("kill destroy töten tuer matar".split(), 3.0) | dict.fromkeys("hurt beat burn schlagen frapper golpear".split(), 2.0)
SEED_INSULTS = "idiot moron stupid trash scum loser worthless pathetic disgusting clown".split()
#: Letters of a word beginning that may stand for a unit; labelled rows that are learned from.
SHORTEST, LONGEST, TRAIN_ROWS = 4, 8, 6_000
#: A unit needs so many groups of like toxic texts and this log-odds of its occurrences, of which a text counts MOST_TIMES.
LEAST_GROUPS, LEAST_ODDS, MOST_TIMES = 5, 2.0, 8
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_CLAUSE_END = re.compile(r"[.!?;:\n]")
STATES = ("plain", "targeted", "piled", "negated", "reported", "threat")
#: Words that a negation reaches, and words between an insult or threat and whom it is aimed at.
REACH, NEAR = 3, 5


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def units(word: str) -> set[str]:
    """A word and its beginnings, the latter marked *."""
    return {word, *(word[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(word)) + 1))}


def like(words: list[str]) -> int:
    """One number for most copies of a text: the least hash of three successive words."""
    return min((zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))), default=0)


Arc = tuple[object, str, str, float, object]  # state, symbol read, symbol written, factor of the word's weight, next state


class Transducer:
    """Writes a symbol for each it reads; a path weighs the sum of its arcs' factors times the words' weights."""

    def __init__(self, start: object, arcs: list[Arc], finals: set):
        self.start, self.finals = start, finals
        self.arcs: dict[tuple[object, str], list[tuple[str, float, object]]] = {}
        for state, read, written, factor, after in arcs:
            self.arcs.setdefault((state, read), []).append((written, factor, after))

    def best(self, marks: list[str], weights: list[float]) -> dict[str, float]:
        """What the heaviest accepted path over marks writes, with the weight of each symbol; of equal ones the first found."""
        front: dict[object, tuple[float, object]] = {self.start: (0.0, None)}
        for mark, weight in zip(marks, weights, strict=True):
            ahead: dict[object, tuple[float, object]] = {}
            for state, (total, path) in front.items():
                for written, factor, after in self.arcs.get((state, mark), ()):
                    if after not in ahead or total + factor * weight > ahead[after][0]:
                        ahead[after] = (total + factor * weight, (path, written, factor * weight) if factor * weight else path)
            front = ahead
        _, path = max((x for state, x in front.items() if state in self.finals), key=lambda x: x[0], default=(0.0, None))
        out: dict[str, float] = {}
        while path is not None:
            path, written, weight = path
            out[written] = out.get(written, 0.0) + weight
        return out


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what first reads and writes what second writes; its states are the pairs that can be reached."""
    reads: dict[object, list[tuple[str, str, float, object]]] = {}
    for (state, read), arcs in first.arcs.items():
        reads.setdefault(state, []).extend((read, *arc) for arc in arcs)
    start = (first.start, second.start)
    arcs, waiting, known = [], [start], {start}
    while waiting:
        here = waiting.pop()
        for read, between, factor, a in reads.get(here[0], ()):
            for written, more, b in second.arcs.get((here[1], between), ()):
                arcs.append((here, read, written, factor * more, (a, b)))
                if (a, b) not in known:
                    known.add((a, b))
                    waiting.append((a, b))
    return Transducer(start, arcs, {(a, b) for a, b in known if a in first.finals and b in second.finals})


MARKS = ("other", "target", "negation", "report", "insult", "threat")
WEIGHTED = ("insult", "threat")


def negation(reach: int = REACH) -> Transducer:
    """States: how many more words are negated."""
    arcs: list[Arc] = []
    for n in range(reach + 1):
        after = max(0, n - 1)
        arcs += [(n, m, m, 1.0, after) for m in ("other", "target", "report")] + [(n, "negation", "negation", 1.0, reach)]
        arcs += [(n, m, f"{m} negated" if n else m, 0.5 if n else 1.0, after) for m in WEIGHTED]
    return Transducer(0, arcs, set(range(reach + 1)))


def reported_speech() -> Transducer:
    """What follows a verb of saying in a clause is reported."""
    arcs: list[Arc] = []
    for said in (False, True):
        arcs += [(said, m, m, 1.0, said) for m in ("other", "target", "negation")] + [(said, "report", "report", 1.0, True)]
        arcs += [(said, m + kind, f"{m} reported" if said else m + kind, 0.5 if said else 1.0, said) for m in WEIGHTED for kind in ("", " negated")]
    return Transducer(False, arcs, {False, True})


def target(near: int = NEAR) -> Transducer:
    """States: for how many words a target behind still counts, or within how many words one must follow."""
    arcs: list[Arc] = []
    quiet = ["other", "negation", "report", *(f"{m} {kind}" for m in WEIGHTED for kind in ("negated", "reported"))]
    for n in range(near + 1):
        behind, after = ("behind", n), ("behind", max(0, n - 1))
        arcs += [(behind, m, m, 1.0, after) for m in quiet] + [(behind, "target", "target", 1.0, ("behind", near))]
        arcs += [(behind, m, f"{m} aimed", 1.5, after) for m in WEIGHTED if n] + [(behind, m, m, 1.0, after) for m in WEIGHTED if not n]
        arcs += [(behind, m, f"{m} aimed", 1.5, ("ahead", near)) for m in WEIGHTED if not n]
    for n in range(1, near + 1):
        ahead, after = ("ahead", n), ("ahead", n - 1)
        arcs.append((ahead, "target", "target", 1.0, ("behind", near)))
        if n > 1:
            arcs += [(ahead, m, m, 1.0, after) for m in quiet] + [(ahead, m, f"{m} aimed", 1.5, after) for m in WEIGHTED]
    return Transducer(("behind", 0), arcs, {("behind", n) for n in range(near + 1)})


def threat() -> Transducer:
    """Threats without a target, negated or reported are none."""
    same = ["other", "target", "negation", "report", *(f"insult{kind}" for kind in ("", " aimed", " negated", " reported"))]
    arcs: list[Arc] = [(0, m, m, 1.0, 0) for m in same] + [(0, "threat aimed", "threat", 1.0, 0)]
    return Transducer(0, arcs + [(0, f"threat{kind}", "other", 0.0, 0) for kind in ("", " negated", " reported")], {0})


def insult() -> Transducer:
    """Writes STATES. A clause's first insult counts half unless it is aimed; the state tells whether there was one."""
    arcs: list[Arc] = []
    for piled in (False, True):
        arcs += [(piled, m, "", 0.0, piled) for m in ("other", "target", "negation", "report")] + [(piled, "threat", "threat", 1.0, True)]
        arcs += [(piled, "insult", "piled" if piled else "plain", 1.0 if piled else 0.5, True), (piled, "insult aimed", "targeted", 1.0, True)]
        arcs += [(piled, f"insult {kind}", kind, 1.0, piled) for kind in ("negated", "reported")]
    return Transducer(False, arcs, {False, True})


@lru_cache(maxsize=1)
def composed() -> Transducer:
    """Negation, reported speech, target, threat and insult in one."""
    return compose(compose(compose(negation(), reported_speech()), target()), compose(threat(), insult()))


class Grammar:
    """The lexicon that marks words, and the composed transducers; weights: unit -> log-odds."""

    def __init__(self, weights: dict[str, float]):
        import ahocorasick

        self.weights, self.transducer = weights, composed()
        self.marks = dict.fromkeys(TARGETS, "target") | dict.fromkeys(NEGATIONS, "negation") | dict.fromkeys(REPORTS, "report") | dict.fromkeys(THREATS, "threat")
        self.finder = ahocorasick.Automaton()
        for stem in {u.rstrip("*") for u in weights} | set(THREATS):
            self.finder.add_word(stem, len(stem))
        self.finder.make_automaton()

    def insult(self, word: str) -> float:
        """What a word weighs as an insult: its own weight, or its longest known beginning's."""
        if word in self.weights:
            return self.weights[word]
        for k in range(min(LONGEST, len(word)), SHORTEST - 1, -1):
            if (stem := word[:k] + "*") in self.weights:
                return self.weights[stem]
        return 0.0

    def clauses(self, text: str) -> list[str]:
        """The clauses of a lower-cased text in which a unit begins a word."""
        out, done = [], -1
        for last, length in self.finder.iter(text):
            first = last - length + 1
            if first <= done or (first and (text[first - 1].isalnum() or text[first - 1] == "_")):
                continue
            begin = max(text.rfind(c, done + 1, first) for c in ".!?;:\n") + 1
            begin = max(begin, done + 1)
            end = m.start() if (m := _CLAUSE_END.search(text, last)) else len(text)
            out.append(text[begin:end])
            done = end
        return out

    def marked(self, clause: str) -> tuple[list[str], list[float]]:
        """The mark and weight of each word; the closed lists come first."""
        marks, weights = [], []
        for word in _WORD.findall(clause):
            mark, weight = self.marks.get(word), 0.0
            if mark == "threat":
                weight = max(THREATS[word], self.insult(word))
            elif mark is None:
                weight = self.insult(word)
                mark = "insult" if weight > 0 else "other"
            marks.append(mark)
            weights.append(weight)
        return marks, weights

    def run(self, clause: str) -> dict[str, float]:
        """The weight of each of STATES in a clause's heaviest reading."""
        return self.transducer.best(*self.marked(clause))

    def features(self, text: str | None) -> list[float]:
        """What a text's matched clauses weigh: per state, in all by length, the heaviest, and how many matched."""
        lower = (text or "").lower()
        found = [x for x in map(self.run, self.clauses(lower)) if x] if lower else []
        length = math.log1p(len(lower) / 100)
        sums = [math.log1p(sum(x.get(s, 0.0) for x in found)) for s in STATES]
        total = sum(sum(x.values()) for x in found)
        return [*sums, math.log1p(100 * total / (len(lower) + 100)), max((sum(x.values()) for x in found), default=0.0) / 5, math.log1p(len(found)), length * bool(found)]


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most `most` labelled texts that are not held out, the first by a hash of doc_id; a text that repeats under its doc_id is one."""
    number = F.crc32(F.col("doc_id").cast("string"))
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(number % 4 != 2)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    texts = checkpointed(texts.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")))
    chosen = texts.select("doc_id", "h").orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(most)
    return texts.join(F.broadcast(chosen), ["doc_id", "h"]).drop("h")


def learn_units(rows: DataFrame) -> dict[str, float]:
    """Units that toxic texts have and others lack, with log-odds; texts alike count once, so copies add nothing."""

    def seen(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[tuple[str, int, int], int] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = _WORD.findall((text or "").lower())
            group, mine = like(words), Counter()
            for word, n in Counter(words).items():
                for unit in units(word):
                    mine[unit] += n
            for unit, n in mine.items():
                out[unit, toxic, group] = max(out.get((unit, toxic, group), 0), min(n, MOST_TIMES))
        rows = [{"unit": u, "toxic": t, "like": g, "times": n} for (u, t, g), n in out.items()]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("unit", pa.string()), ("toxic", pa.int32()), ("like", pa.int64()), ("times", pa.int32())]))

    groups = map_batches(rows, ["text", "toxic"], seen, "unit string, toxic int, like long, times int").groupBy("unit", "toxic", "like").agg(F.max("times").alias("times"))
    times = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("times")).otherwise(0))
    counts = groups.groupBy("unit").agg(F.sum("toxic").alias("bad_groups"), times(1).alias("bad"), times(0).alias("good"))
    total = {r.toxic: r.n for r in groups.groupBy("toxic").agg(F.countDistinct("like").alias("n")).collect()}
    odds = F.log((F.col("bad") + 0.5) / (total.get(1, 0) + 1)) - F.log((F.col("good") + 0.5) / (total.get(0, 0) + 1))
    kept = counts.where(F.col("bad_groups") >= LEAST_GROUPS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    return {r.unit: min(r.odds, 8.0) for r in kept.collect()}


class Scorer:
    """A grammar and the logistic regression over its features."""

    def __init__(self, weights: dict[str, float], center: np.ndarray, scale: np.ndarray, slope: np.ndarray):
        self.weights, self.center, self.scale, self.slope = weights, center, scale, slope
        self._grammar: Grammar | None = None

    def __getstate__(self):
        return self.__dict__ | {"_grammar": None}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self._grammar is None:
            self._grammar = Grammar(self.weights)
        x = (np.array([self._grammar.features(t) for t in texts]).reshape(len(texts), -1) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.slope[1:] + self.slope[0], -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    slope, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [1.0] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ slope, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ slope)
        slope += step
        if np.abs(step).max() < 1e-6:
            break
    return slope


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Scorer:
    """Learns units on two thirds of the training rows and weighs clauses on the other; at most `most` rows in all.

    What comes to the driver is the units that LEAST_GROUPS groups of these rows share, which the rows bound, and a line of numbers for each row.
    """
    rows = checkpointed(training_rows(docs, labels, most))
    part = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3))
    weights = dict.fromkeys(SEED_INSULTS, 4.0) | learn_units(rows.where(part != 0))
    grammar: list[Grammar] = []

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not grammar:
            grammar.append(Grammar(weights))
        texts, toxic = batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
        return pa.record_batch([pa.array([grammar[0].features(t) for t in texts], pa.list_(pa.float64())), pa.array(toxic, pa.int32())], ["x", "toxic"])

    found = map_batches(rows.where(part == 0), ["text", "toxic"], measured, "x array<double>, toxic int").collect()
    n = len(STATES) + 4
    if len({r.toxic for r in found}) < 2:
        return Scorer(weights, np.zeros(n), np.ones(n), np.array([-3.0, 1.0, 1.0, 1.0, 0.5, 0.5, 1.0, 1.0, 1.0, 0.0, 0.0]))
    x, y = np.array([r.x for r in found]), np.array([r.toxic for r in found], float)
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    return Scorer(weights, center, scale, _fit((x - center) / scale, y))


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from threshold on) of each row of docs(doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        found = scorer.score(batch.column("text").to_pylist())
        return pa.record_batch(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array([is_held_out(x) for x in ids], pa.bool_()),
                "score": pa.array(found, pa.float64()),
                "predicted": pa.array((found >= threshold).astype(np.int32), pa.int32()),
            }
        )

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all columns, that score below the threshold."""
    return filter_batches(docs, lambda batch: scorer.score(batch.column("text").to_pylist()) < threshold)


def flagged_clauses(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, clause, state and weight of every matched clause, for review."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grammar = Grammar(scorer.weights)
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for clause in grammar.clauses((text or "").lower()):
                out += [{"doc_id": doc_id, "clause": clause, "state": s, "weight": w} for s, w in grammar.run(clause).items()]
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("clause", pa.string()), ("state", pa.string()), ("weight", pa.float64())]))

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, clause string, state string, weight double")
