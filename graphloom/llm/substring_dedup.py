"""Passages that an earlier document holds as well: an FM-index per shard, backward search over wavelet trees, and the
intervals of documents that match over a threshold of words.

A window is a number of consecutive words. A word goes if a window that covers it also starts in a document of a smaller doc_id.
Texts are collapsed first, words joined by one space: what a text's smallest document keeps is found out, the others keep nothing
of their windows. The windows of a text are dealt by their anchor, the least hash of a run of anchor words in them; windows
that are equal have the same anchor, so they meet in one shard, and what has an anchor of its own is never looked at again.
Neighbouring windows of one anchor form a segment; equal segments are one with the smallest owner. A shard holds the segments of some anchors, indexes
them and streams them through the index: the matching statistics tell for each place the smallest owner of the window that starts there.
Anchors of over HOT_SEGMENTS different segments (a passage that many texts continue differently) are dealt
again by whole windows, of which those that two documents share form shards of their own.

Defined results: null and empty texts have no words. Rows without a doc_id lose nothing and cost others nothing. Rows that
share a doc_id are of one document: none of them costs another of them anything; repeated rows each give a row. Texts with fewer words than a window
lose nothing. White space between words doesn't count. Texts are read whole, the longest in blocks. Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import FEW, bound_batches, hash_words, join_hot, map_batches, mix, pieces, with_few
from graphloom.llm.fm_index import FMIndex
from graphloom.session import checkpointed

#: Words of a window; words of an anchor.
WINDOW, ANCHOR = 50, 10
#: Segments of a shard, about; windows of a segment at most; windows worked on at a time; different segments that one anchor may have in a shard.
SHARD_SEGMENTS, SEGMENT_WINDOWS, BLOCK_WINDOWS, HOT_SEGMENTS = 4096, 64, 1 << 17, 2048
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEGMENTS = "struct<key: bigint, id: bigint, size: int, start: int, last: bigint, n: bigint, hot: boolean>"


def normal(raw: bytes) -> bytes:
    """The words of a text joined by one space."""
    return b" ".join(filter(None, (b" ".join(piece.split()) for piece in pieces(raw))))


def word_starts(text: bytes) -> np.ndarray:
    """Where the words of a normal text start, and one place beyond the space that would follow the last."""
    return np.concatenate(([0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1, [len(text) + 1])) if text else np.zeros(1, np.int64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbouring values."""
    n = len(values) - width + 1
    rows = np.concatenate((values, np.full(-len(values) % width, np.uint64(2**64 - 1)))).reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forward[width - 1 : width - 1 + n])


def segments(text: bytes, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, id, first word, windows) of the runs of windows of a normal text that share an anchor."""
    at = word_starts(text)
    n_windows = len(at) - window
    if n_windows <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    hashes = np.concatenate([hash_words(piece) for piece in pieces(text)])
    keys, firsts, sizes = [], [], []
    for begin in range(0, n_windows, BLOCK_WINDOWS):
        words = hashes[begin : begin + BLOCK_WINDOWS + window - 1]
        runs = np.zeros(len(words) - anchor + 1, np.uint64)
        for k in range(anchor):
            runs = runs * _MULTIPLIER + words[k : k + len(runs)]
        least = _least(mix(runs), window - anchor + 1)
        new = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        size = np.diff(np.append(new, len(least)))
        cuts = -(-size // SEGMENT_WINDOWS)  # long runs, as of one repeated word, are cut
        within = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        keys.append(np.repeat(least[new], cuts))
        firsts.append(np.repeat(new, cuts) + within * SEGMENT_WINDOWS + begin)
        sizes.append(np.minimum(np.repeat(size, cuts) - within * SEGMENT_WINDOWS, SEGMENT_WINDOWS))
    first, size = np.concatenate(firsts), np.concatenate(sizes)
    ends = at[first + size + window - 1] - 1
    ids = [hashlib.blake2b(text[a:b], digest_size=8).digest() for a, b in zip(at[first].tolist(), ends.tolist(), strict=True)]
    return np.concatenate(keys).view(np.int64), np.frombuffer(b"".join(ids), np.int64), first.astype(np.int32), size.astype(np.int32)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat, kind))


def distinct_texts(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """text (a number), digest, owner (the smallest doc_id), copies and segments of every distinct text of a window or more, in the checkpoint folder."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [normal(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
        found = [segments(text, window, anchor) for text in texts]
        lists = [_lists([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), *lists], ["doc_id", "digest", "keys", "ids", "starts", "sizes"])

    schema = "doc_id long, digest binary, keys array<long>, ids array<long>, starts array<int>, sizes array<int>"
    mapped = map_batches(docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL"), ["doc_id", "text"], run, schema).where(F.size("keys") > 0)
    grouped = mapped.groupBy("digest", "keys", "ids", "starts", "sizes").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies"))
    return checkpointed(grouped.withColumn("text", F.monotonically_increasing_id()))


def _with_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text of docs with the other columns of wanted(owner, ...) for rows of that doc_id; only such rows are shuffled if their doc_ids are few."""
    rows = docs.select(F.col("doc_id").cast("long").alias("owner"), F.col("text").alias("body"))
    owners = wanted.select("owner").distinct()
    if owners.limit(FEW + 1).count() <= FEW:
        rows = rows.join(F.broadcast(owners), "owner", "left_semi")
    return rows.join(wanted, "owner")


def _fetched(docs: DataFrame, texts: DataFrame, distinct: DataFrame, window: int) -> DataFrame:
    """distinct(key, id, size, rep(owner, text, start), last, n, hot) with the words of each segment, read from the text that rep names."""
    said = F.struct("key", "id", "size", F.col("rep.start").alias("start"), "last", "n", "hot")
    asked = distinct.groupBy(F.col("rep.text").alias("text")).agg(F.collect_list(said).alias("asked"))  # no more than a text has segments
    asked = checkpointed(asked.join(texts.select("text", "digest", "owner"), "text").select("owner", "digest", "asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("key", "id", "size", "owner", "last", "n", "hot", "words")}
            for owner, body, digest, wanted in zip(*(batch.column(c).to_pylist() for c in ("owner", "body", "digest", "asked")), strict=True):
                text = normal((body or "").encode("utf-8", "surrogatepass"))
                if digest in seen or hashlib.sha256(text).digest() != digest:
                    continue
                seen.add(digest)
                at = word_starts(text)
                for w in wanted:
                    out["words"].append(text[at[w["start"]] : at[w["start"] + w["size"] + window - 1] - 1])
                    out["owner"].append(owner)
                    for name in ("key", "id", "size", "last", "n", "hot"):
                        out[name].append(w[name])
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    bound_batches(docs.sparkSession)
    return _with_rows(docs, asked).mapInArrow(run, "key long, id long, size int, owner long, last long, n long, hot boolean, words binary")


def indexed(items: DataFrame, window: int, count: int) -> DataFrame:
    """key, id, n and runs (struct of begin, end, owner: windows begin to end of the segment, whose smallest owner is owner) of items(key, id, size, owner, last, n, words), about count rows, shard by shard.

    Runs that no owner of a text with the segment comes after are left out.
    """

    def shard(table: pa.Table) -> pa.Table:
        rows = {}  # repeated rows are one
        for row in zip(*(table.column(c).to_pylist() for c in ("key", "id", "owner", "last", "n", "words")), strict=True):
            rows[row[:2]] = row
        known: dict[bytes, int] = {}
        numbers = [np.array([known.setdefault(w, len(known)) for w in row[5].split(b" ")]) for row in rows.values()]
        index = FMIndex(numbers, np.array([row[2] for row in rows.values()]), window)
        out: dict[str, list] = {"key": [], "id": [], "n": [], "runs": []}
        for (key, name, _, last, n, _), (lengths, owners) in zip(rows.values(), index.matches(numbers), strict=True):
            found = np.where(lengths == window, owners, np.iinfo(np.int64).max)
            edges = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1], [True])))
            runs = [{"begin": a, "end": b, "owner": int(found[a])} for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if found[a] < last]
            if runs:
                out["key"].append(key), out["id"].append(name), out["n"].append(n), out["runs"].append(runs)
        run_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("owner", pa.int64())]))
        return pa.table([pa.array(out["key"], pa.int64()), pa.array(out["id"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["runs"], run_type)], names=list(out))

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-count // SHARD_SEGMENTS)))))
    return dealt.groupBy("shard").applyInArrow(shard, "key long, id long, n long, runs array<struct<begin: int, end: int, owner: bigint>>")


def _hot_runs(hot: DataFrame, window: int) -> DataFrame:
    """What indexed gives, for segments whose anchors have too many of them: by whole windows, those that documents share in an index of their own."""
    part = lambda k: F.conv(F.substring("digest", k, 15), 16, 10).cast("long")
    words = lambda begin: F.array_join(F.slice(F.split(F.col("words").cast("string"), " "), begin + 1, window), " ")
    each = hot.select("key", "id", "owner", "last", "n", "words", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("begin"))
    each = each.withColumn("digest", F.md5(words(F.col("begin")))).select("key", "id", "owner", "last", "n", "begin", part(1).alias("window_key"), part(16).alias("window_id"))
    each = checkpointed(each)
    shared = each.groupBy("window_key", "window_id").agg(F.min(F.struct("owner", "key", "id", "begin")).alias("rep"), F.max("last").alias("last"), F.count("*").alias("n")).where("rep.owner < last")
    shared = checkpointed(shared.select("window_key", "window_id", "last", "n", "rep.*"))
    items = shared.join(hot.select("key", "id", "words"), ["key", "id"]).select(
        F.col("window_key").alias("key"), F.col("window_id").alias("id"), F.lit(1).alias("size"), "owner", "last", "n", words(F.col("begin")).cast("binary").alias("words")
    )
    found = indexed(items, window, shared.count()).select(F.col("key").alias("window_key"), F.col("id").alias("window_id"), F.col("n").alias("met"), F.col("runs")[0]["owner"].alias("least"))
    met = join_hot(each, checkpointed(found), ["window_key", "window_id"], "met").where("least < last")
    run = F.struct(F.col("begin").cast("int").alias("begin"), (F.col("begin") + 1).cast("int").alias("end"), F.col("least").alias("owner"))
    return met.groupBy("key", "id", "n").agg(F.collect_list(run).alias("runs"))  # no more than SEGMENT_WINDOWS


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """digest, owner, copies and spans (struct of begin, end: words) of the distinct texts of docs: what a smaller doc_id holds as well of the text's smallest document; spans may overlap."""
    texts = distinct_texts(docs, window, min(anchor, window))
    each = texts.select("text", "owner", F.inline(F.arrays_zip("keys", "ids", "starts", "sizes"))).toDF("text", "owner", "key", "id", "start", "size")
    shared = each.groupBy("key").agg(F.min("owner").alias("least"), F.max("owner").alias("most"), F.count("*").alias("met")).where("least < most")
    met = checkpointed(join_hot(each, checkpointed(shared.select("key", "met")), ["key"], "met"))
    distinct = checkpointed(met.groupBy("key", "id", "size").agg(F.min(F.struct("owner", "text", "start")).alias("rep"), F.max("owner").alias("last"), F.count("*").alias("n")))
    crowded = checkpointed(distinct.groupBy("key").agg(F.count("*").alias("different")).where(F.col("different") > hot_segments))
    marked = with_few(distinct, crowded.select("key", F.lit(True).alias("hot")), ["key"]).withColumn("hot", F.coalesce("hot", F.lit(False)))
    fetched = _fetched(docs, texts, marked, window)
    if crowded.limit(1).count():
        fetched = checkpointed(fetched)
        runs = indexed(fetched.where("NOT hot"), window, distinct.count()).unionByName(_hot_runs(fetched.where("hot").dropDuplicates(["key", "id"]), window))
    else:
        runs = indexed(fetched, window, distinct.count())
    here = join_hot(met, checkpointed(runs), ["key", "id"], "n").select("text", "owner", "start", F.inline("runs").alias("begin", "end", "least")).where("least < owner")
    spans = F.struct((F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end") + window - 1).alias("end"))
    cut = here.groupBy("text").agg(F.collect_list(spans).alias("spans"))  # no more than a text has windows
    return texts.select("text", "digest", "owner", "copies").join(cut, "text", "left").drop("text")


def _cut(text: bytes, spans: list[dict]) -> tuple[int, bytes]:
    """(words removed, what is kept) of a normal text without spans."""
    at = word_starts(text)
    gone = np.zeros(len(at), np.int64)
    np.add.at(gone, [s["begin"] for s in spans], 1)
    np.add.at(gone, [s["end"] for s in spans], -1)
    gone = np.cumsum(gone[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
    return int(gone.sum()), b" ".join(text[at[a] : at[b] - 1] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def dedupe(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text, null where all of it or nothing but white space is as before) of every row of docs(doc_id, text, ...)."""
    found = checkpointed(repeats(docs, window, anchor, hot_segments))
    partly = found.where(F.size("spans") > 0).select("owner", "digest", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("digest", "n_removed", "kept_sha256", "kept")}
            for body, digest, spans in zip(*(batch.column(c).to_pylist() for c in ("body", "digest", "spans")), strict=True):
                text = normal((body or "").encode("utf-8", "surrogatepass"))
                if digest in seen or hashlib.sha256(text).digest() != digest:
                    continue
                seen.add(digest)
                n, kept = _cut(text, spans)
                for name, value in zip(out, (digest, n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), (pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)], list(out))

    bound_batches(docs.sparkSession)
    kept = _with_rows(docs, partly).mapInArrow(cut, "digest binary, n_removed long, kept_sha256 string, kept string").dropDuplicates(["digest"])
    known = found.select("digest", "owner", "copies").join(kept, "digest", "left")

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [normal(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
        counts = pa.array([t.count(b" ") + 1 if t else 0 for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["doc_id", "n_words", "digest"])

    rows = map_batches(docs, ["doc_id", "text"], words, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, digest binary")
    copy, own = F.col("doc_id") > F.col("owner"), F.col("doc_id") == F.col("owner")
    n_removed = F.when(copy, F.col("n_words")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long")
    sha = F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(own & F.col("kept_sha256").isNotNull(), F.col("kept_sha256")).otherwise(F.lower(F.hex("digest")))
    return join_hot(rows, checkpointed(known), ["digest"], "copies", "left").select("doc_id", "n_words", n_removed.alias("n_removed"), sha.alias("kept_sha256"), F.when(own, F.col("kept")).alias("kept"))
