"""Run history as Parquet tables, one partition per run: written anew per run, kept to the newest runs, read across schema versions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def write_run(tasks: DataFrame, path: str) -> None:
    """Writes tasks(run, ...); a run that is there already is replaced, other runs stay."""
    rows = tasks.withColumn("schema_version", F.lit(SCHEMA_VERSION))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs; columns that older versions lack are null. A newer version than this code's raises ValueError."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    newest = rows.agg(F.max("schema_version")).first()[0]
    if newest is not None and newest > SCHEMA_VERSION:
        raise ValueError(f"history of version {newest}, this code reads {SCHEMA_VERSION}")
    return rows


def stale_runs(history: DataFrame, keep: int) -> DataFrame:
    """run of all but the newest `keep`, by last start, then run."""
    starts = history.groupBy("run").agg(F.max("started").alias("started"))
    newest = starts.orderBy(F.desc("started"), F.desc("run")).limit(keep)
    return starts.join(F.broadcast(newest.select("run")), "run", "left_anti").select("run")


def graph_json(edges: DataFrame) -> DataFrame:
    """source, document: each node's dependencies as JSON, in order."""
    return edges.groupBy("source").agg(F.to_json(F.struct(F.array_sort(F.collect_set("target")).alias("dependencies"))).alias("document"))


def pretty(document: str) -> str:
    return json.dumps(json.loads(document), indent=2, sort_keys=True)


def latest_run(history: DataFrame) -> DataFrame:
    """run that started last."""
    return history.groupBy("run").agg(F.max("started").alias("started")).orderBy(F.desc("started"), F.desc("run")).limit(1).select("run")


def tasks_of(history: DataFrame, run: object | None = None) -> DataFrame:
    """The rows of one run, or of the latest."""
    return history.where(F.col("run") == run) if run is not None else history.join(F.broadcast(latest_run(history)), "run", "left_semi")


def key_of(history: DataFrame, inputs: DataFrame, task: str, run: object | None = None) -> DataFrame:
    """run, task, key, inputs of a task in a run, or in the latest run that has it; inputs(key, inputs) may lack a key."""
    rows = history.where((F.col("task") == task) & F.col("key").isNotNull())
    rows = tasks_of(rows, run).select("run", "task", "key").distinct()
    return rows.join(inputs, "key", "left").select("run", "task", "key", "inputs")


def log_of(history: DataFrame, logs: DataFrame, task: str, run: object | None = None) -> DataFrame:
    """run, task, data, truncated of a task's log in a run, or in the latest run that has the task."""
    rows = tasks_of(history.where(F.col("task") == task), run).select("run", "task").distinct()
    return rows.join(logs, ["run", "task"]).select("run", "task", "data", "truncated")


def read_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, task, context, observed of earlier analysis reports, a JSON object each, for union with a new one."""
    rows = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("report"))
    return parsed_reports(rows)


def parsed_reports(rows: DataFrame) -> DataFrame:
    """path, task, context (canonical), observed of rows(path, report: variant); what is no report is left out."""
    field = lambda name, kind: F.try_variant_get("report", f"$.{name}", kind)
    return rows.select("path", field("task", "string").alias("task"), F.to_json(field("context", "variant")).alias("context"), F.explode(field("observed", "array<string>")).alias("observed")).where("task IS NOT NULL")
