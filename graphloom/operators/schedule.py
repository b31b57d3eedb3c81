"""How a run would be ordered: priorities, waves and the work beside a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.closure import longest_paths, reachable_pairs
from graphloom.operators.storage import ranked
from graphloom.session import checkpointed


def priorities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, path, rank: the longest expected work from each node on, longest first, ties by id."""
    paths = longest_paths(nodes, edges, dependents=True).select("id", F.col("length").alias("path"), (-F.col("length")).alias("order"))
    return ranked(paths, "order", "id").select("id", "path", "rank")


def waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, wave: 0 for what depends on nothing, else one more than the latest dependency."""
    ones = nodes.select("id", F.lit(1).cast("long").alias("weight"))
    return longest_paths(ones, edges).select("id", (F.col("length") - 1).alias("wave"))


def work_beside(nodes: DataFrame, edges: DataFrame, asked: list[int], parallel: int) -> DataFrame:
    """id, work: for each asked task, its own work and the largest of parallel - 1 other tasks that don't depend on it.

    The asked tasks are a list given by hand. Of all nodes only the heaviest can count: as many as a task has
    dependents, and parallel - 1 more.
    """
    spark = nodes.sparkSession
    seeds = spark.createDataFrame([(k, k) for k in asked], "group long, id long")
    after = checkpointed(reachable_pairs(seeds, edges, dependents=True).select("group", "id"))
    most = (after.groupBy("group").count().agg(F.max("count")).first()[0] or 0) + parallel - 1
    heavy = checkpointed(nodes.select("id", "weight").orderBy(F.desc("weight"), "id").limit(most))
    own = nodes.join(seeds.select("id"), "id").select(F.col("id").alias("group"), F.col("weight").alias("own"))
    pairs = heavy.withColumn("group", F.explode(F.array(*(F.lit(k).cast("long") for k in asked)))).join(after, ["group", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("weight"), "id"))
    beside = pairs.withColumn("place", place).where(F.col("place") <= parallel - 1).groupBy("group").agg(F.sum("weight").alias("others"))
    return own.join(beside, "group", "left").select(F.col("group").alias("id"), (F.col("own") + F.coalesce("others", F.lit(0))).alias("work"))
