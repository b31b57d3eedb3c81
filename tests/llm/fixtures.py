"""Small tables with the awkward rows every operator has to define."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, row string, items string, n long, bands string, score string"


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def documents(spark, n: int = 60, seed: int = 1):
    """n documents with near and exact copies, nulls, empty and very long texts, repeated rows, and columns that clash with the operators' own."""
    rng = random.Random(seed)
    rows = [(k, text(rng, rng.choice((3, 12, 40, 200)))) for k in range(n)]
    for k in range(0, n, 5):
        words = rows[k][1].split()
        rows.append((1000 + k, " ".join(words)))
        words[len(words) // 2] = "changed"
        rows.append((2000 + k, " ".join(words)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "x" * 70_000), (5004, text(rng, 30_000)), (None, text(rng, 20)), (5005, "Uno Dos"), (5006, "uno dos"), (5007, "ü ß 日本語 \U0001f600 end")]
    rows.append(rows[3])
    source = lambda k: None if k is None or k % 7 == 0 else f"s{k % 3}"
    return spark.createDataFrame([(k, t, None, source(k), None, "a", "b", "c", 1, "d", "e") for k, t in rows], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
