"""Union-find as Spark joins: the smallest id reachable over undirected links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import FEW, join_hot
from graphloom.session import checkpointed


def smallest_reachable(links: DataFrame) -> DataFrame:
    """id, component for every id in links(a, b); component is the smallest id it reaches.

    Each round every id takes the smallest label among its neighbours, then its label's label, so
    chains shorten by doubling; hubs are merged by partial aggregation before the shuffle, and the labels
    of ids with many neighbours, and of labels that many ids bear, are broadcast if they are few. Ends when
    a round changes nothing. Self-links and repeated links do no harm; no links give no rows.

    Up to FEW ids, counted first, are broadcast with their labels each round, which then takes one shuffle instead of nine: over many
    partitions small rounds are mostly files of shuffles and checkpoints.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component"), F.count("*").alias("degree")).withColumnRenamed("a", "id"))
    if labels.limit(FEW + 1).count() <= FEW:
        return _few_reachable(both, labels.select("id", "component"))
    while True:
        near = join_hot(both, labels.withColumnRenamed("id", "b"), ["b"], "degree").groupBy("a").agg(F.min("component").alias("near"))
        taken = labels.join(near, labels.id == near.a).select("id", F.least("component", "near").alias("now"), F.col("component").alias("was"), "degree")
        taken = checkpointed(taken)
        borne = taken.groupBy("now").agg(F.count("*").alias("bearers"))
        up = borne.join(labels.select(F.col("id").alias("now"), F.col("component").alias("above")), "now")
        jumped = checkpointed(join_hot(taken, checkpointed(up), ["now"], "bearers").select("id", F.least("now", "above").alias("component"), "was", "degree"))
        if not jumped.where("component <> was").limit(1).count():
            return jumped.select("id", "component")
        labels = jumped.drop("was")


#: Partitions of at most FEW labels.
_PARTS = 8


def _few_reachable(both: DataFrame, labels: DataFrame) -> DataFrame:
    """smallest_reachable's rounds over links(a, b) in both directions, of FEW labels(id, component) at most."""
    while True:
        near = both.join(F.broadcast(labels.select(F.col("id").alias("b"), "component")), "b").select(F.col("a").alias("id"), "component", F.lit(None).cast("long").alias("was"))
        own = labels.select("id", "component", F.col("component").alias("was"))
        taken = near.unionByName(own).groupBy("id").agg(F.min("component").alias("now"), F.max("was").alias("was"))
        up = labels.select(F.col("id").alias("now"), F.col("component").alias("above"))
        jumped = checkpointed(taken.join(F.broadcast(up), "now").select("id", F.least("now", "above").alias("component"), "was").coalesce(_PARTS))
        labels = jumped.select("id", "component")
        if not jumped.where("component <> was").limit(1).count():
            return labels
