"""Licence scans: a generalised suffix automaton of licence templates gives, at every word of a text,
the longest template passage that ends there; long passages are chained in template order into spans.

A text's words become numbers; only where three successive words (fewer, if a phrase is shorter) also
stand in a template can a passage of three words end, so the automaton runs over those stretches alone,
without loss. A chain keeps the order of its passages in text and template and leaves no gap over the
template's length; of all ways to cut a text's passages into chains the one that covers most words of the
template, less NEW_CHAIN words for each chain, is taken.

Defined results: a null or empty text has no words, no places and empty label strings, score 0.
Words over any length and repeated rows are ordinary. Other columns are ignored.
"""

from __future__ import annotations

import bisect
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import alnum_words, map_batches

#: Phrases whose places are counted, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices and opening passages of public licences, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    # further passages
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("mpl-2", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
]
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first:long,last:long,coverage:double>>"
)
#: A passage shorter than this many words is in no chain; words that a chain of its own has to be worth.
LEAST, NEW_CHAIN = 3, 2


class SuffixAutomaton:
    """Of several word sequences; each state knows the templates its passages occur in and all places they end at."""

    def __init__(self, sequences: list[list[int]]):
        self.go, self.link, self.size = [{}], [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for t, words in enumerate(sequences):
            last = 0
            for k, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].setdefault(t, set()).add(k)
        for v in sorted(range(1, len(self.go)), key=lambda v: -self.size[v]):
            up = self.ends[self.link[v]]
            for t, places in self.ends[v].items():
                up[t] = up.get(t, set()) | places

    def _add(self, size: int, go: dict, link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.size.append(size)
        self.ends.append({})
        return len(self.go) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        copy = self._add(self.size[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.go[p].get(word) == q:
            self.go[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.go[last]:
            q = self.go[last][word]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
        new, p = self._add(self.size[last] + 1, {}, 0), last
        while p >= 0 and word not in self.go[p]:
            self.go[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
        return new

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest passage that ends at each word."""
        out, state, length = [], 0, 0
        for word in words:
            while state and word not in self.go[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.go[state]:
                state, length = self.go[state][word], length + 1
            out.append((length, state))
        return out


class Scanner:
    """Scans word lists for phrases and template passages."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], least_cover: float, least_words: int):
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        split = [alnum_words(text) for text in (*phrases, *(text for _, text in templates))]
        self.n_phrases, self.lengths = len(phrases), [len(x) for x in split]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for x in split for w in x}))}
        self.n = len(self.vocabulary) + 1
        sequences = [[self.vocabulary[w] for w in x] for x in split]
        self.automaton = SuffixAutomaton(sequences)
        self.gram = max(1, min([3, *self.lengths[: self.n_phrases]]))
        self.grams = np.array(sorted({self._code(x[k : k + self.gram]) for x in sequences for k in range(len(x) - self.gram + 1)}), np.int64)
        self.least_cover, self.least_words = least_cover, least_words
        self.phrases_at = self._phrases_at(sequences[: self.n_phrases])

    def _code(self, words):
        """One number for successive words, or of arrays of them."""
        code = words[0]
        for word in words[1:]:
            code = code * self.n + word
        return code

    def _phrases_at(self, phrases: list[list[int]]) -> list[tuple[int, ...]]:
        """For each state the phrases that end every sufficiently long passage of it."""
        found: dict[int, list[int]] = {}
        for t, words in enumerate(phrases):
            state = 0
            for word in words:
                state = self.automaton.go[state][word]
            found.setdefault(state, []).append(t)
        out = []
        for state in range(len(self.automaton.go)):
            at, mine = state, []
            while at > 0:
                mine += found.get(at, [])
                at = self.automaton.link[at]
            out.append(tuple(mine))
        return out

    def candidates(self, words: np.ndarray) -> list[tuple[int, int]]:
        """[begin, end) of each stretch in which `gram` successive words always stand in a template."""
        g = self.gram
        if len(words) < g:
            return []
        parts = [words[k : len(words) - g + 1 + k] for k in range(g)]
        full = np.flatnonzero(np.logical_and.reduce([x > 0 for x in parts]))
        if not len(full):
            return []
        at = full[np.isin(self._code([x[full].astype(np.int64) for x in parts]), self.grams)]
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        return [(int(x[0]), int(x[-1]) + g) for x in np.split(at, cuts) if len(x)]

    def scan(self, words: np.ndarray, runs: list[tuple[int, int]]) -> dict:
        """Places of phrases, covered spans and labels of a text whose candidate stretches are runs."""
        places, passages = [], []
        for begin, end in runs:
            stats = self.automaton.statistics(words[begin:end].tolist())
            for k, (length, state) in enumerate(stats):
                for t in self.phrases_at[state]:
                    if length >= self.lengths[t]:
                        places.append((begin + k - self.lengths[t] + 1, t))
                grows = k + 1 < len(stats) and stats[k + 1][0] > length
                if length >= LEAST and not grows:
                    passages.append((begin + k - length + 1, begin + k, state))
        spans = self.chain(passages)
        base = {self.labels[t] for _, t in places}
        more = {s[0] for s in spans if s[3] >= self.least_cover and s[4] >= self.least_words}
        score = max([1.0 if base else 0.0, *(s[3] for s in spans)])
        return {"places": sorted(at for at, _ in places), "base": base, "labels": base | more, "score": score, "spans": spans}

    def chain(self, passages: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float, int]]:
        """(label, first word, last word, share covered, words covered) of the best chains of passages (first, last, state), template by template."""
        out = []
        per: dict[int, list[tuple[int, int, int]]] = {}
        for first, last, state in passages:
            for t, ends in self.automaton.ends[state].items():
                if t >= self.n_phrases:
                    per.setdefault(t, []).extend((last, first, end) for end in ends)
        for t, nodes in sorted(per.items()):
            for first, last, covered in best_chains(sorted(nodes), self.lengths[t]):
                out.append((self.labels[t], first, last, min(1.0, covered / self.lengths[t]), covered))
        return out


def gain(before: tuple[int, int, int], after: tuple[int, int, int], length: int) -> int:
    """Template words that a passage (last, first, end in the template) adds to a chain that ends in another, 0 if it can't follow."""
    last, first, end = after
    if first <= before[1] or first - before[0] > length:
        return 0
    return max(0, min(last - first + 1, last - before[0], end - before[2]))


def best_chains(nodes: list[tuple[int, int, int]], length: int) -> list[tuple[int, int, int]]:
    """(first word, last word, words covered) of disjoint chains of sorted nodes (last, first, end) with most words covered less NEW_CHAIN each.

    Only nodes within the template's length can be followed, so work grows with the text, not its square.
    """
    total, via, covered, best, lasts = [], [], [], [], []  # best: the best node among the first k + 1
    begin = 0
    for k, node in enumerate(nodes):
        last, first, end = node
        while begin < k and first - nodes[begin][0] > 2 * length:
            begin += 1
        own = min(last - first + 1, end + 1)
        before = bisect.bisect_left(lasts, first) - 1
        top = best[before] if before >= 0 else None
        value, source, words = own - NEW_CHAIN + (total[top] if top is not None else 0), (top, True), own
        for j in range(begin, k):
            more = gain(nodes[j], node, length)
            if more and total[j] + more > value:
                value, source, words = total[j] + more, (j, False), covered[j] + more
        total.append(value)
        via.append(source)
        covered.append(words)
        lasts.append(last)
        best.append(k if not best or value > total[best[-1]] else best[-1])
    out, at = [], best[-1] if best else None
    while at is not None:
        stop, words = nodes[at][0], covered[at]
        while not via[at][1]:
            at = via[at][0]
        out.append((nodes[at][1], stop, words))
        at = via[at][0]
    return out[::-1]


@lru_cache(maxsize=2)
def _scanner(phrases: tuple, templates: tuple, least_cover: float, least_words: int) -> Scanner:
    return Scanner(dict(phrases), list(templates), least_cover, least_words)


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, least_cover: float = 0.6, least_words: int = 5) -> DataFrame:
    """Per row of docs(doc_id, text): phrase places and labels, and the labels and spans of chained template passages.

    A template's label is given where one chain covers least_cover of its words and least_words of the text's.
    The templates travel with the job; they are the licence list, not data.
    """
    args = (tuple((phrases or PHRASES).items()), tuple(templates or TEMPLATES), least_cover, least_words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = _scanner(*args)
        number = scanner.vocabulary.get
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = alnum_words(text)
            ids = np.fromiter((number(w, 0) for w in words), np.int32, len(words))
            runs = scanner.candidates(ids)
            got = scanner.scan(ids, runs) if runs else None
            places = got["places"] if got else []
            rows.append(
                {
                    "doc_id": doc_id,
                    "n_words": len(words),
                    "n_base": len(places),
                    "first_word": places[0] if places else None,
                    "last_word": places[-1] if places else None,
                    "base_labels": ",".join(sorted(got["base"])) if got else "",
                    "labels": ",".join(sorted(got["labels"])) if got else "",
                    "score": got["score"] if got else 0.0,
                    "spans": [dict(zip(("label", "first", "last", "coverage"), s, strict=False)) for s in got["spans"]] if got else [],
                }
            )
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return map_batches(docs, ["doc_id", "text"], run, SCHEMA)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("coverage", pa.float64())])))]
)
