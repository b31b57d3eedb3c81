"""Near-duplicate documents by SuperMinHash: each shingle visits the slots of a signature in a random
order of its own, its rank in that order being the whole part of what it offers a slot, so a signature
is full after few ranks and later ones are not drawn. Signatures are cut into bands; documents that
share a band are candidates; links are confirmed on the full shingle sets; union-find groups them.

No pairs are listed within a bucket. Documents with one set are one class. In each bucket every class
is compared with the bucket's smallest; then only classes that a bucket still holds in different
components are compared, in blocks, by signature first and by full sets after; what a class is still to be
compared with is listed by blocks of the other component. Hot buckets, leaders, components and classes
are not joined on their key alone.

Defined results: null and empty texts have an empty set, link with nothing and are kept. A text of
fewer words than a shingle is one shingle. Repeated rows are exact copies of each other and each gives
a row; a null doc_id gives a row without component, not kept. Words of any length are hashed whole.
Other columns are ignored. doc_id is taken to be a key: texts that share one count as that document's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import FEW, LOWER, encoded, grouped_hashes, join_hot, join_spread, map_batches, mix, with_few
from graphloom.llm.components import smallest_reachable
from graphloom.operators.storage import ranked
from graphloom.session import checkpointed

WIDTH = 5
BANDS, ROWS = 21, 6
SLOTS = BANDS * ROWS
#: Left-over pairs of a bucket are confirmed on full sets if so many of the 126 signature bytes agree: 5 deviations below 0.85.
ALIKE = 86
#: A component with more candidate pairs than this is compared in blocks, without a row for each pair.
MANY = 4096
#: Rows of a block of a bucket, which have signatures; rows of a block of a component, which have texts.
BLOCK, CELL = 1024, 1024
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.array([0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_set(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text's word hashes, sorted."""
    n = len(hashes)
    if not n:
        return hashes
    if n < width:
        return mix(np.sum(hashes * _ODD[:n], dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = hashes[: n - width + 1] * _ODD[0]
    for k in range(1, width):
        total += hashes[k : n - width + 1 + k] * _ODD[k % len(_ODD)]
    return np.unique(mix(total))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sets of texts given as UTF-8."""
    out: list[np.ndarray] = []
    for _, group in grouped_hashes([text.translate(LOWER) for text in texts]):
        out += [shingle_set(x) for x in group]
    return out


def _slots(draw: np.ndarray, n: int) -> np.ndarray:
    return ((draw >> _32) * np.uint64(n) >> _32).astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SLOTS values for each set; the rank of the winning shingle is in the high half, its draw in the low. Empty sets keep the largest value."""
    best = np.full((len(sets), SLOTS), _FULL)
    flat = best.reshape(-1)
    shingles = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    draw = mix(shingles)
    first = _slots(draw, SLOTS)
    np.minimum.at(flat, owner * SLOTS + first, draw & _LOW)
    open_rows = (best.max(axis=1) > _LOW)[owner]
    shingles, owner, first = shingles[open_rows], owner[open_rows], first[open_rows]
    cuts = np.flatnonzero(np.diff(owner) > 0) + 1
    begin = 0
    while begin < len(owner):  # whole documents at a time, so that their orders fit in memory
        end = begin + (1 << 16)
        end = len(owner) if end >= len(owner) or end > (cuts[-1] if len(cuts) else 0) else int(cuts[np.searchsorted(cuts, end)])
        _later_ranks(best, flat, shingles[begin:end], owner[begin:end], first[begin:end])
        begin = end
    return best


def _later_ranks(best: np.ndarray, flat: np.ndarray, shingles: np.ndarray, owner: np.ndarray, first: np.ndarray) -> None:
    """Ranks from 1 on, by a Fisher-Yates shuffle per shingle, for documents with slots that a lower rank hasn't filled."""
    rows = np.arange(len(shingles))
    order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(shingles), 1))
    order[rows, first] = 0
    order[:, 0] = first
    for rank in range(1, SLOTS):
        draw = mix(shingles + np.uint64(rank * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        at = rank + _slots(draw, SLOTS - rank)
        slot = order[rows, at]
        order[rows, at] = order[:, rank]
        order[:, rank] = slot
        np.minimum.at(flat, owner * SLOTS + slot, np.uint64(rank) << _32 | draw & _LOW)
        docs = np.unique(owner)
        waiting = np.zeros(len(best), bool)
        waiting[docs] = best[docs].max(axis=1) >= np.uint64(rank + 1) << _32
        keep = waiting[owner]
        if not keep.any():
            return
        if keep.mean() < 0.8:
            shingles, owner, order = shingles[keep], owner[keep], order[keep]
            rows = np.arange(len(shingles))


def _described(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = shingle_sets(encoded(batch.column("text")))
    signature = signatures(sets)
    salt = np.arange(1, ROWS + 1, dtype=np.uint64) * _STEP
    bands = mix(np.sum(mix(signature.reshape(-1, BANDS, ROWS) + salt), axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    some = [len(x) > 0 for x in sets]
    return pa.record_batch(
        {
            "doc_id": batch.column("doc_id").cast(pa.int64()),
            "n": pa.array([len(x) for x in sets], pa.int64()),
            "d1": pa.array(np.array([np.sum(mix(x), dtype=np.uint64) for x in sets], np.uint64).view(np.int64)),
            "d2": pa.array(np.array([np.bitwise_xor.reduce(mix(x * _ODD[1])) if len(x) else 0 for x in sets], np.uint64).view(np.int64)),
            "bands": pa.array([list(x) if y else None for x, y in zip(bands, some, strict=True)], pa.list_(pa.int64())),
            "bytes": pa.array([x.tobytes() if y else None for x, y in zip((signature & np.uint64(255)).astype(np.uint8), some, strict=True)], pa.binary()),
        }
    )


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), d1 and d2 (a digest of the set), bands and bytes (low bytes of the signature)."""
    return map_batches(docs, ["doc_id", "text"], _described, "doc_id long, n long, d1 long, d2 long, bands array<long>, bytes binary")


def restricted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs(doc_id, text) as id, text, of the distinct ids(id) alone; these are broadcast if FEW or less, joined by shuffle if not."""
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    few = ids.limit(FEW + 1).count() <= FEW
    return texts.join(F.broadcast(ids) if few else ids.hint("merge"), "id", "left_semi")


def confirm(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) of ids, those whose full sets have 100 * intersection >= percent * union; texts(id, text)."""
    left = join_spread(pairs, texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a", "b")
    both = left.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of_a = shingle_sets(encoded(batch.column("text_a")))
        b_texts = encoded(batch.column("text_b"))
        distinct = {text: k for k, text in enumerate(dict.fromkeys(b_texts))}
        of_b = shingle_sets(list(distinct))
        linked = []
        for x, text in zip(of_a, b_texts, strict=True):
            y = of_b[distinct[text]]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
        return pa.record_batch({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(linked, pa.bool_()))

    return map_batches(both, ["a", "b", "text_a", "text_b"], run, "a long, b long").distinct()


def _left_over(group: pd.DataFrame) -> pd.DataFrame:
    """For each visitor of a block and each other component's cell, the members whose signatures and sizes allow a link; two visitors pair once."""
    mine, others = group[~group.visits], group[group.visits]
    out = []
    if len(mine):
        signature = np.array([np.frombuffer(x, np.uint8) for x in mine["bytes"]])
        ids, sizes, component, cells, roams = (mine[c].to_numpy() for c in ("id", "n", "component", "cell", "roams"))
        for row in others.itertuples():
            alike = (signature == np.frombuffer(row.bytes, np.uint8)).sum(axis=1)
            small, large = np.minimum(sizes, row.n), np.maximum(sizes, row.n)
            take = np.flatnonzero((alike >= ALIKE) & (component != row.component) & (small * 100 >= large * row.percent) & (~roams | (ids > row.id)))
            for c, cell in sorted(set(zip(component[take].tolist(), cells[take].tolist(), strict=True))):
                here = take[(component[take] == c) & (cells[take] == cell)]
                out.append((row.id, c, cell, ids[here]))
    return pd.DataFrame(out, columns=["x", "component", "cell", "others"])


def membership(classes: DataFrame, components: DataFrame) -> DataFrame:
    """id, component and cell of every class; a component's classes are in cells of about CELL, by a hash."""
    known = classes.select("id").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    large = checkpointed(components.groupBy("component").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")).where("cells > 1"))
    cell = F.pmod(F.xxhash64("id"), F.coalesce("cells", F.lit(1))).cast("int")
    return checkpointed(with_few(known, large, ["component"]).select("id", "component", cell.alias("cell")))


def unresolved(members: DataFrame, known: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """x, component, cell, others: members of another component that x may link with, of what buckets of members(band, key, id, n) still hold.

    known(id, component, cell) and signed(id, bytes) tell of ids. A bucket's rows are in blocks; those outside the component of its
    smallest id visit every block. No list is longer than a cell.
    """
    placed = checkpointed(members.join(known, "id"))
    buckets = placed.groupBy("band", "key").agg(
        F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "id").alias("main")
    )
    split = checkpointed(buckets.where("low <> high").drop("low", "high").withColumn("weight", F.col("rows")))
    rows = checkpointed(join_hot(placed, split, ["band", "key"], "weight").withColumn("roams", F.col("component") != F.col("main")).drop("main"))
    visitors = checkpointed(rows.where("roams").groupBy("band", "key").agg(F.count("*").alias("n_visitors")).join(split.select("band", "key", "weight"), ["band", "key"]))
    work = visitors.agg(F.sum(F.ceil(F.col("weight") / BLOCK) * F.ceil(F.col("n_visitors") / BLOCK)).alias("blocks"), F.sum(F.col("weight") * F.col("n_visitors")).alias("pairs")).first()
    if not work.blocks:
        return rows.select(F.col("id").alias("x"), "component", "cell", F.array("id").alias("others")).limit(0)
    rows = join_hot(rows, visitors, ["band", "key"], "weight").join(signed, "id")
    blocks, groups = F.ceil(F.col("rows") / BLOCK).cast("int"), F.ceil(F.col("n_visitors") / BLOCK).cast("int")
    home, away = F.pmod(F.xxhash64("id"), blocks).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), groups).cast("int")
    at_home = rows.select("*", F.lit(False).alias("visits"), home.alias("block"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("part"))
    visiting = rows.where("roams").select("*", F.lit(True).alias("visits"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), away.alias("part"))
    keys = ["band", "key", "block", "part"]
    both = at_home.unionByName(visiting).select(*keys, "visits", "roams", "id", "n", "component", "cell", "bytes", F.lit(percent).alias("percent"))
    found = _dealt(both, keys, 0.002 * work.blocks + 0.3 * (work.pairs / BLOCK**2)).groupBy(keys).applyInPandas(_left_over, "x long, component long, cell int, others array<long>")
    return found.groupBy("x", "component", "cell").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))


def _dealt(rows: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """rows by keys over as many tasks as take about five of the seconds each, or two a core if that is more: adaptive execution would merge them by size alone."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(int(max(2 * cores, min(100_000, seconds / 5))), *keys)


def _first_links(percent: int):
    """Of each x of a block of a component, one link with the members it lists, if any."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = dict(zip(group["id"], shingle_sets([(t or "").encode() for t in group["text"]]), strict=True))
        out = []
        for row in group[group.visits].itertuples():
            x = sets[row.id]
            for other in row.others:
                y = sets.get(other)
                if y is None:
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    out.append((row.id, other))
                    break
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def confirm_blocks(docs: DataFrame, rest: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """A link (a, b) for each x of rest(x, component, cell, others) that links with any of its others, cell by cell of known(id, component, cell)."""
    keys = ["component", "cell"]
    parts = checkpointed(rest.groupBy(keys).agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"), F.count("*").alias("weight")))
    members = known.join(parts.drop("weight"), keys).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("visits"), "id", F.array().cast("array<long>").alias("others")
    )
    part = F.pmod(F.xxhash64("x", F.lit(1)), F.col("parts")).cast("int")
    visits = join_hot(rest, parts, keys, "weight").select(*keys, part.alias("part"), F.lit(True).alias("visits"), F.col("x").alias("id"), "others")
    rows = members.unionByName(visits)
    texts = restricted(docs, rows.select("id").distinct())
    groups = parts.agg(F.sum("parts")).first()[0] or 0
    return _dealt(rows.join(texts, "id"), [*keys, "part"], 5 * groups).groupBy(*keys, "part").applyInPandas(_first_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs(doc_id, text).

    Documents link where 100 * intersection >= percent * union of their sets of five-word shingles.
    At 0.85 a linked pair shares none of the 21 bands of 6 rows with a probability of 5 in 100,000.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = checkpointed(describe(docs))
    classes = (
        described.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("d1", "d2")
        .agg(F.min(F.struct("doc_id", "n", "bands", "bytes")).alias("least"), F.count("*").alias("copies"))
        .select("d1", "d2", F.col("least.doc_id").alias("id"), "least.n", "least.bands", "least.bytes", "copies")
    )
    classes = checkpointed(classes)
    in_bands = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    leaders = checkpointed(in_bands.groupBy("band", "key").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("rows")).where("rows > 1"))
    buckets = checkpointed(join_hot(in_bands, leaders, ["band", "key"], "rows"))
    fits = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * percent
    pairs = checkpointed(buckets.where(fits & (F.col("id") != F.col("lead.id"))).select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct())
    links = checkpointed(confirm(docs.select(F.col("doc_id").alias("id"), "text"), pairs, percent))
    components = smallest_reachable(links)
    known = membership(classes, components)
    rest = checkpointed(unresolved(buckets.drop("lead"), known, classes.select("id", "bytes"), percent))
    if rest.limit(1).count():
        crowded = rest.groupBy("component").agg(F.sum(F.size("others")).alias("pairs")).where(F.col("pairs") > MANY)
        crowded = checkpointed(crowded.select("component", F.lit(True).alias("crowded")))
        rest = checkpointed(with_few(rest, crowded, ["component"]))
        few = checkpointed(rest.where("crowded IS NULL").select(F.col("x").alias("a"), F.explode("others").alias("b")).distinct())
        ids = few.select(F.col("a").alias("id")).union(few.select("b")).distinct()
        of_few = checkpointed(confirm(restricted(docs, ids), few, percent))
        of_crowded = checkpointed(confirm_blocks(docs, rest.where("crowded").drop("crowded"), known, percent))
        components = smallest_reachable(links.union(of_few).union(of_crowded))
    of_class = checkpointed(classes.join(components, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("class_component"), "copies"))
    some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    found = join_hot(described.where(some).select("doc_id", "n", "d1", "d2"), of_class, ["d1", "d2"], "copies").select("doc_id", "n", F.col("class_component").alias("component_id"))
    lone = described.where(~some).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(lone).select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def without_copies(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs, with all columns, less all but the first document of each group.

    Rows that share a doc_id and a text are one document, of which one row stays; rows that share a doc_id
    and differ in text are documents of their own, in order of a hash of their texts. Rows without a doc_id stay.
    """
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        extra = checkpointed(near_duplicates(docs, percent).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct())
        return docs.join(extra, "doc_id", "left_anti").select(docs.columns)
    keys = ["doc_id", "h1", "h2"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.where("doc_id IS NOT NULL").select(F.struct("*").alias("row"), "doc_id", F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"))
    rows = checkpointed(rows.groupBy(keys).agg(F.min_by("row", F.struct(F.xxhash64(F.to_json("row")), F.to_json("row"))).alias("row")))
    numbered = checkpointed(rows.join(ranked(rows.select(keys), *keys), keys).select(F.col("rank").alias("number"), "row"))
    kept = checkpointed(near_duplicates(numbered.select(F.col("number").alias("doc_id"), "row.text"), percent).where("kept").select(F.col("doc_id").alias("number")))
    return numbered.join(kept, "number", "left_semi").select("row.*").unionByName(docs.where("doc_id IS NULL"))
