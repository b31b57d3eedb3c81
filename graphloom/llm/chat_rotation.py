"""Chat formatting by multi-party perspective rotation, in DataFrame functions alone.

For every speaker of a conversation the dialogue is rendered once with that speaker as the assistant,
the others as users by name and system turns as they are; mask_spans are the [begin, end) characters
of the assistant's words, the ones to train on.

A conversation is rendered in segments of segment_turns turn numbers, and a segment in parts of up to
2 * segment_turns rows in their order, so that no row grows with a conversation: segments in order, and
their parts in order, give the dialogue in order.

Defined results: exact repeats of a turn are rendered once and counted in n_repeats. Ties of turn are
in order of role, then text; null turns come first, in segment -1. A null text is empty; a null role
is a user named unknown and has no perspective, nor have system turns, so a conversation of only these
gives no rows. Rows with a null conv_id are one conversation. "<|" in a text becomes "< |", so that no
text forges a turn. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.storage import ranked
from graphloom.session import checkpointed

SYSTEM = "system"
#: So many crowded segments, of two ids and a number each, are broadcast.
MANY = 100_000


def rotate(conversations: DataFrame, segment_turns: int = 256) -> DataFrame:
    """conv_id, perspective, segment, part, n_turns, n_repeats, text and mask_spans per speaker and segment of conversations(conv_id, turn, role, text)."""
    turns = conversations.groupBy(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    ).agg(F.count("*").alias("copies"))
    turns = checkpointed(turns.withColumn("segment", F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(-1)).cast("long")))
    most, salted = 2 * segment_turns, 64
    sizes = turns.groupBy(F.col("conv_id").alias("c"), F.col("segment").alias("s")).agg(F.count("*").alias("rows"))
    segments = (
        _with_parts(turns, sizes.where(F.col("rows") > most), most)
        .groupBy("conv_id", "segment", "part")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "copies"))).alias("turns"))
    )
    # a conversation of many segments meets its speakers in many tasks
    salts = sizes.groupBy("c").agg(F.ceil(F.sum(F.ceil(F.col("rows") / most)) / salted).cast("int").alias("salts"))
    speakers = turns.where((F.col("role") != SYSTEM) & F.col("role").isNotNull()).select("conv_id", F.col("role").alias("perspective")).distinct()
    speakers = speakers.join(salts, F.col("conv_id").eqNullSafe(F.col("c"))).select("c", "perspective", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    counts = salts.select(F.col("c").alias("k"), "salts")
    spread = segments.join(counts, segments.conv_id.eqNullSafe(counts.k)).withColumn("mine", F.pmod(F.xxhash64("segment", "part"), F.col("salts")).cast("int"))
    rows = spread.join(speakers, spread.conv_id.eqNullSafe(speakers.c) & (spread.mine == speakers.salt)).drop("c", "k", "mine", "salt", "salts")
    return rows.withColumn("pieces", F.transform("turns", _piece)).select(
        "conv_id",
        "perspective",
        "segment",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + x["copies"] - 1).alias("n_repeats"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.array_join(_spans("pieces"), ",").alias("mask_spans"),
    )


def _with_parts(turns: DataFrame, crowded: DataFrame, most: int) -> DataFrame:
    """turns with part: a row's place in its segment's order by the size of a part; places are worked out where a segment has more than one.

    A range sort deals the rows of crowded segments, one turn's too, over all tasks.
    """
    here = turns.conv_id.eqNullSafe(crowded.c) & (turns.segment == crowded.s)
    columns = ["conv_id", "segment", "turn", "role", "text", "copies"]
    if not crowded.limit(1).count():
        return turns.select(*columns, F.lit(0).cast("long").alias("part"))
    order = ["conv_id", "segment", "turn", "role", "text"]
    places = checkpointed(ranked(turns.join(crowded, here, "left_semi").select(columns), *order))
    first = places.groupBy(F.col("conv_id").alias("c"), F.col("segment").alias("s")).agg(F.min("rank").alias("first"))
    split = places.join(F.broadcast(first) if first.count() <= MANY else first, places.conv_id.eqNullSafe(first.c) & (places.segment == first.s))
    split = split.select(*columns, F.floor((F.col("rank") - F.col("first")) / most).cast("long").alias("part"))
    return turns.join(crowded, here, "left_anti").select(*columns, F.lit(0).cast("long").alias("part")).unionByName(split)


def _piece(turn: Column) -> Column:
    name = F.regexp_replace(F.coalesce(turn["role"], F.lit("unknown")), "[<|>\\s]+", "_")
    mine = F.coalesce(turn["role"] == F.col("perspective"), F.lit(False))
    head = F.when(mine, F.lit("<|assistant|>\n")).when(turn["role"] == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user "), name, F.lit("|>\n")))
    return F.struct(head.alias("head"), F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"), mine.alias("mine"))


def _spans(pieces: str) -> Column:
    """begin-end of the body of each piece that is the assistant's."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["head"])
        end = begin + F.length(piece["body"])
        span = F.array(F.concat_ws("-", begin.cast("string"), end.cast("string")))
        return F.struct((end + 1).alias("at"), F.when(piece["mine"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pieces, start, add, lambda state: state["spans"])
