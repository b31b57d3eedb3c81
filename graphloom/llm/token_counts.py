"""Token counts of whole texts under a public byte-level BPE vocabulary.

Texts up to chunk_chars are encoded at once. Longer ones are encoded as overlapping chunks with
offsets. The word boundaries of the pre-tokenizer look at no earlier text and at most a few later
characters, so where two neighbouring chunks have a boundary in common, well before the first one's
end, both go on alike from there: the chunks are spliced at it. An overlap reaches back to the last such
boundary at least and is doubled where the chunks still don't align. A run without any boundary is one
word to the vocabulary and can't be cut; there the chunks double too, so that it is encoded twice at most.

Defined results: a null text counts as empty (0 bytes, 0 tokens). Repeated rows each give a row.
Other columns of the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import map_batches

#: Before a chunk's end, no boundary is trusted; over the longest special string and contraction.
MARGIN = 32
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int"


@lru_cache(maxsize=4)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder:
    """Counts tokens as the tokenizers library does with the vocabulary at json_path; texts over chunk_chars in chunks."""

    def __init__(self, json_path: str, chunk_chars: int = 32768, overlap: int = 256):
        self.json_path, self.chunk_chars, self.overlap = json_path, chunk_chars, overlap

    def short(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in _library(self.json_path).encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, text: str, begin: int, end: int) -> tuple[list[int], list[int]]:
        """(start in text of each pre-token of text[begin:end], tokens of the chunk before each and at its end)."""
        encoding = _library(self.json_path).encode(text[begin:end], add_special_tokens=False)
        starts, before, last = [], [], object()
        for k, (word, span) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
            if word != last:
                starts.append(begin + span[0])
                before.append(k)
                last = word
        return starts, [*before, len(encoding.ids)]

    def long(self, text: str) -> tuple[int, int]:
        """(tokens, chunks encoded) of a text of any length; memory for two chunks and their overlap."""
        size, end, step = len(text), min(len(text), self.chunk_chars), self.chunk_chars
        starts, before = self.words(text, 0, end)
        total, chunks, first = 0, 1, 0  # first: of starts, the true boundary up to which total counts
        while end < size:
            true = starts[first] if first < len(starts) else end
            known = {p: k for k, p in enumerate(starts) if k >= first and p <= end - MARGIN}
            last = max(known, default=true)  # later than this the chunks can't align
            overlap, until = max(self.overlap, end - last), min(size, end + step)
            step = 2 * step if overlap > self.overlap else self.chunk_chars
            while True:
                at = max(true, end - overlap)
                next_starts, next_before = self.words(text, at, until)
                chunks += 1
                shared = [j for j, p in enumerate(next_starts) if p in known]
                if at == true:
                    first = 0
                    break
                if shared:
                    k = known[next_starts[shared[-1]]]
                    total += before[k] - before[first]
                    first = shared[-1]
                    break
                overlap *= 2
            starts, before, end = next_starts, next_before, until
        return total + before[-1] - before[first], chunks

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, chunks) of each text."""
        small = [k for k, text in enumerate(texts) if len(text) <= self.chunk_chars]
        found = dict(zip(small, ((n, 1) for n in self.short([texts[k] for k in small])), strict=True))
        return [found[k] if k in found else self.long(text) for k, text in enumerate(texts)]


def count_tokens(docs: DataFrame, encoder: Encoder, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) and n_chunks of each row of docs(doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column("text").to_pylist()]
        counts = encoder.count(texts)
        tokens = [n for n, _ in counts]
        return pa.record_batch(
            {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()),
                "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
                "n_chunks": pa.array([n for _, n in counts], pa.int32()),
            }
        )

    return map_batches(docs, ["doc_id", "text"], run, SCHEMA)
