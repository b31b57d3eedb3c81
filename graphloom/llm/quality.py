"""Quality by weak labels: expectation-maximisation over the votes of overlapping heuristic labellers
estimates how often each is right, without any true label; the posterior labels then train a linear
scorer over hashed word shapes.

A labeller votes good (1), bad (-1) or abstains (0). The votes of all documents are counted by
pattern, of which there are at most 3 to the number of labellers; EM runs over those counts.

Defined results: a null or empty text has no words, every labeller abstains but the empty one, and it is
scored as such. Repeated rows each count and give a row. An empty table gives no rows. Other columns
are ignored. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import encoded, filter_batches, hash_words, map_batches, pieces

#: Weights of the linear scorer; rows it is trained on.
WEIGHTS, TRAIN_ROWS = 4096, 8_000
#: How often a detection is right beforehand, and how much this weighs beside the detections.
PRIOR, PRIOR_WEIGHT = 0.97, 1.0
#: Frequent words of four languages.
FREQUENT = (
    "the of and to in that is for it as with was on be at by this have from are not or an but which you he they his her "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec "
    "el los las del y se no una su para con al lo como más o pero sus"
).split()
#: The first DETECTORS of these vote bad or keep silent; the others also vote good.
DETECTORS = 8
LABELLERS = ("symbols", "capitals", "bars", "marks", "runs", "odd", "odd_words", "common", "variety", "frequent", "sentences")
#: How a byte stands in a word's shape.
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 capital, 3 digit, 4 sentence mark, 5 bar, 6 ! or ?, 7 other symbol, 0 white space
_KIND[33:128] = 7
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 4
_KIND[ord("|")] = 5
_KIND[[ord(c) for c in "!?"]] = 6
_FREQUENT = np.sort(np.array([hash_words(w.encode())[0] for w in set(FREQUENT)]))


def _hashes(raw: bytes) -> np.ndarray:
    return np.concatenate([hash_words(x) for x in pieces(raw)]) if raw else np.empty(0, np.uint64)


def _odd_words(raw: bytes) -> int:
    """Words with a mark that prose seldom has."""
    kinds = _KIND[np.frombuffer(raw, np.uint8)]
    word = np.cumsum((kinds == 0) | (np.frombuffer(raw, np.uint8) < 33))
    return len(np.unique(word[kinds >= 5]))


def measures(raw: bytes) -> dict[str, float]:
    """What the labellers look at."""
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8) if raw else np.zeros(8, int)
    words = _hashes(raw.lower())
    n, shown = len(words), max(1, int(kinds[1:].sum()))
    counts = np.unique(words, return_counts=True)[1]
    alone = _hashes(raw.lower().translate(bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))))
    return {
        "words": n,
        "symbols": kinds[7] / shown,
        "capitals": kinds[2] / max(1, int(kinds[1] + kinds[2])),
        "bars": kinds[5] / max(1, n),
        "marks": kinds[6] / max(1, n),
        "runs": float(np.mean(words[1:] == words[:-1])) if n > 1 else 0.0,
        "odd": kinds[5:].sum() / shown,
        "odd_words": _odd_words(raw) / max(1, n),
        "common": counts.max() / n if n else 0.0,
        "variety": len(counts) / n ** 0.8 if n else 0.0,
        "frequent": float(np.mean(np.isin(alone, _FREQUENT))) if len(alone) else 0.0,
        "sentences": kinds[4] / max(1, n),
    }


def votes(m: dict[str, float]) -> list[int]:
    """The labellers' votes, in the order of LABELLERS."""
    few = m["words"] < 4
    bad = lambda x, limit: -1 if x >= limit else 0
    return [
        bad(m["symbols"], 0.08),
        bad(m["capitals"], 0.4) if not few else 0,
        bad(m["bars"], 0.2),
        bad(m["marks"], 0.4) if not few else 0,
        bad(m["runs"], 0.15) if not few else 0,
        bad(m["odd"], 0.05) if not few else 0,
        bad(m["odd_words"], 0.3) if not few else 0,
        bad(m["common"], 0.3) if m["words"] >= 20 else 0,
        0 if m["words"] < 30 else 1 if m["variety"] >= 1.0 else bad(-m["variety"], -0.4),
        0 if m["words"] < 30 else 1 if m["frequent"] >= 0.05 else bad(-m["frequent"], -0.01),
        -1 if not m["words"] else 0 if m["words"] < 30 else 1 if 0.02 <= m["sentences"] <= 0.6 else -1,
    ]


def features(raw: bytes, m: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text in the hashed space: its word shapes and pairs of them by share, and tenths of the measures."""
    shape = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    kept = shape[np.concatenate(([True], shape[1:] != shape[:-1]))].tobytes() if len(shape) else b""
    words = _hashes(kept)
    pairs = words[1:] * np.uint64(31) + words[:-1]
    places = (np.concatenate((words, pairs)) % np.uint64(WEIGHTS - 160)).astype(np.int64)
    found, counts = np.unique(places, return_counts=True)
    tenths = np.array([WEIGHTS - 160 + 12 * k + min(11, int(12 * min(1.0, m[name]))) for k, name in enumerate(LABELLERS)])
    return np.concatenate((found, tenths)), np.concatenate((np.sqrt(counts / max(1, len(places))), np.full(len(tenths), 0.5)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior_weight: float = PRIOR_WEIGHT) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, accuracy per labeller, share of good) from votes per pattern and how many documents cast it.

    Whether a labeller votes bad depends on the true label alone. A detector's silence is its good vote;
    the other labellers abstain where a text is too short to judge, which says nothing. It starts from
    every detection being right, and detections are taken to be right PRIOR of the time beforehand; this
    fixes which of the two labels is the bad one. Nothing is assumed of the other labellers, so what they
    vote in a corpus of another language or style tells little unless it goes with detections.
    """
    detector = np.arange(patterns.shape[1]) < DETECTORS
    judged = (patterns != 0) | detector
    bad_vote = patterns < 0
    posterior = np.where(bad_vote[:, detector].any(axis=1), 0.02, 0.98)
    weight = counts / max(1, counts.sum())
    share = 0.5
    for _ in range(rounds):
        before = posterior
        share = float(np.clip((weight * posterior).sum(), 1e-3, 1 - 1e-3))
        cast = (bad_vote * weight[:, None]).sum(axis=0) + 1e-6
        of_good = (bad_vote * (weight * posterior)[:, None]).sum(axis=0) + 1e-7
        of_good = np.where(detector, (of_good + prior_weight * (1 - PRIOR) * cast) / (1 + prior_weight), of_good)
        at_good, at_bad = ((judged * (weight * x)[:, None]).sum(axis=0) + 1e-6 for x in (posterior, 1 - posterior))
        good = np.clip(of_good / at_good, 1e-6, 1 - 1e-3)
        bad = np.clip((cast - of_good) / at_bad, 1e-6, 1 - 1e-3)
        told = np.where(bad_vote, np.log(good / bad), np.log((1 - good) / (1 - bad)))
        odds = np.log(share / (1 - share)) + (told * judged).sum(axis=1)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(posterior - before).max() < 1e-9:
            break
    total = at_good + at_bad
    return posterior, (at_good * (1 - good) + at_bad * bad) / total, share


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float, accuracies: dict[str, float]):
        self.weights, self.bias, self.accuracies = weights, bias, accuracies

    def score(self, raw: bytes) -> float:
        places, values = features(raw, measures(raw))
        return float(1 / (1 + np.exp(-np.clip(self.weights[places] @ values + self.bias, -30, 30))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch gradient steps with momentum."""
    weights, bias, speed, bias_speed = np.zeros(WEIGHTS), 0.0, np.zeros(WEIGHTS), 0.0
    owner = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])
    places, values = np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows])
    for _ in range(rounds):
        z = np.bincount(owner, weights[places] * values, len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        speed = 0.9 * speed - 2.0 * (np.bincount(places, error[owner] * values, WEIGHTS) / len(rows) + 1e-4 * weights)
        bias_speed = 0.9 * bias_speed - 2.0 * error.mean()
        weights, bias = weights + speed, bias + bias_speed
    return weights, float(bias)


def vote_table(docs: DataFrame) -> DataFrame:
    """The votes of each row of docs(text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array([votes(measures(raw)) for raw in encoded(batch.column("text"))], pa.list_(pa.int32()))], ["votes"])

    return map_batches(docs, ["text"], run, "votes array<int>")


def fit(docs: DataFrame, most: int = TRAIN_ROWS, prior_weight: float = PRIOR_WEIGHT) -> Scorer:
    """Votes are counted over all documents; the scorer is trained on at most `most` distinct texts, the first by a hash of them."""
    counted = vote_table(docs).groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** len(LABELLERS) rows
    if not counted:
        return Scorer(np.zeros(WEIGHTS), 0.0, {})
    counted.sort(key=lambda r: r.votes)
    patterns, counts = np.array([r.votes for r in counted]), np.array([r.n for r in counted], float)
    posterior, accuracy, _ = expectation_maximisation(patterns, counts, prior_weight=prior_weight)
    belief = {tuple(p): b for p, b in zip(patterns.tolist(), posterior, strict=True)}
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    chosen = docs.select(key.alias("key")).distinct().orderBy("key").limit(most)
    sample = docs.select("text", key.alias("key")).join(F.broadcast(chosen), "key").groupBy("key").agg(F.first("text").alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for raw in encoded(batch.column("text")):
            m = measures(raw)
            places, values = features(raw, m)
            found.append({"places": places.tolist(), "values": values.tolist(), "label": float(belief.get(tuple(votes(m)), 0.5))})
        return pa.RecordBatch.from_pylist(found, schema=pa.schema([("places", pa.list_(pa.int32())), ("values", pa.list_(pa.float32())), ("label", pa.float64())]))

    rows = map_batches(sample, ["text"], run, "places array<int>, values array<float>, label double").collect()
    weights, bias = train([(np.array(r.places), np.array(r["values"])) for r in rows], np.array([r.label for r in rows]))
    return Scorer(weights, bias, dict(zip(LABELLERS, accuracy.tolist(), strict=True)))


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (higher: better) and good (score >= threshold) of each row of docs(doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([scorer.score(raw) for raw in encoded(batch.column("text"))])
        return pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "score": pa.array(found, pa.float64()), "good": pa.array(found >= threshold, pa.bool_())})

    return map_batches(docs, ["doc_id", "text"], run, "doc_id long, score double, good boolean")


def without_poor(docs: DataFrame, scorer: Scorer, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, that score at least the threshold."""
    return filter_batches(docs, lambda batch: np.array([scorer.score(raw) >= threshold for raw in encoded(batch.column("text"))], bool))
