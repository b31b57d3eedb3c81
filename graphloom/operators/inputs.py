"""Inputs of tasks: layered settings, declared and inferred inputs, changed inputs, and what dependency globs select."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import reachable_pairs

SPREAD = "..."


def spread(base: Column, new: Column) -> Column:
    """new over base, arrays of strings: each "..." of new stands for base's items, nothing without a base; no new leaves base."""
    none = F.array().cast("array<string>")
    return F.when(new.isNull(), base).otherwise(F.flatten(F.transform(new, lambda x: F.when(x == SPREAD, F.coalesce(base, none)).otherwise(F.array(x)))))


def merged_layers(layers: DataFrame) -> DataFrame:
    """project, field, items of layers(project, field, layer, items): higher layers over lower ones. A field has as many rows as layers."""
    ordered = F.array_sort(F.collect_list(F.struct("layer", "items")))
    merged = F.aggregate(ordered, F.lit(None).cast("array<string>"), lambda base, x: spread(base, x["items"]))
    return layers.groupBy("project", "field").agg(merged.alias("items"))


def joined_inputs(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """task, kind, value, origin: declared(task, kind, value) inputs, and inferred ones of the kinds a task doesn't declare."""
    kinds = declared.select("task", "kind").distinct()
    extra = inferred.select("task", "kind", "value").distinct().join(kinds, ["task", "kind"], "left_anti").withColumn("origin", F.lit("inferred"))
    return declared.select("task", "kind", "value").distinct().withColumn("origin", F.lit("declared")).union(extra)


def changed_inputs(inputs: DataFrame, changes: DataFrame) -> DataFrame:
    """task, path, whole of inputs(task, path, whole) that changes(path) touch; the whole file counts before fields of it."""
    return inputs.join(changes.select("path").distinct(), "path", "left_semi").groupBy("task", "path").agg(F.bool_or("whole").alias("whole"))


def glob_verdicts(globs: DataFrame, outputs: DataFrame) -> DataFrame:
    """task, verdict of globs(task, dependency) by outputs(dependency, built, selected): whether its dependencies declare outputs, have been built, and any is selected."""
    rows = globs.join(outputs, "dependency", "left").groupBy("task").agg(
        F.count("built").alias("declared"), F.coalesce(F.bool_or("built"), F.lit(False)).alias("built"), F.coalesce(F.bool_or("selected"), F.lit(False)).alias("selected")
    )
    verdict = F.when(F.col("declared") == 0, "no-declared-outputs").when(F.col("selected"), "some").when(~F.col("built"), "not-built").otherwise("none")
    return rows.select("task", verdict.alias("verdict"))


def process_totals(roots: DataFrame, processes: DataFrame) -> DataFrame:
    """id, memory: each of roots(id) with all its descendants in processes(id, parent, memory)."""
    tree = processes.where("parent IS NOT NULL").select(F.col("id").alias("source"), F.col("parent").alias("target"))
    found = reachable_pairs(roots.select(F.col("id").alias("group"), "id"), tree, dependents=True)
    return found.join(processes.select("id", "memory"), "id").groupBy("group").agg(F.sum("memory").alias("memory")).withColumnRenamed("group", "id")
