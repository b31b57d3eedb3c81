"""Classifications of tasks, lookups and findings as ordered cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def audit_findings(accesses: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """task, path, kind: stray writes (outside outputs(task, path)), undeclared reads (outside inputs(task, path)) and undeclared
    listings of accesses(task, path, operation); a stray write cancels the reads of its path."""
    kinds = accesses.groupBy("task", "path").agg(*(F.bool_or(F.col("operation") == x).alias(x) for x in ("write", "read", "list")))
    marked = kinds.join(inputs.select("task", "path").distinct().withColumn("input", F.lit(True)), ["task", "path"], "left").join(
        outputs.select("task", "path").distinct().withColumn("output", F.lit(True)), ["task", "path"], "left"
    )
    kind = F.when(F.col("write") & F.col("output").isNull(), "stray-write").when(F.col("read") & F.col("input").isNull() & ~F.col("write"), "undeclared-read")
    kind = kind.when(F.col("list") & F.col("input").isNull() & ~F.col("write"), "undeclared-listing")
    return marked.withColumn("kind", kind).where("kind IS NOT NULL").select("task", "path", "kind")


def lookup_verdicts(lookups: DataFrame) -> DataFrame:
    """task, verdict of lookups(task, pos, found, recorded, failed): the first place that hits, else missed, unrecorded or failed."""
    verdict = F.when(F.bool_or("failed"), "failed").when(F.min(F.when(F.col("found"), F.col("pos"))) == 0, "declared").when(F.bool_or("found"), "hit")
    return lookups.groupBy("task").agg(verdict.when(F.bool_or("recorded"), "missed").otherwise("unrecorded").alias("verdict"))


def key_match(wanted: Column, key: Column) -> Column:
    """0 for equal arrays, 1 where key begins with wanted, else null."""
    return F.when(key == wanted, 0).when(F.slice(key, 1, F.size(wanted)) == wanted, 1)


def run_outcome(log: DataFrame) -> DataFrame:
    """run, code: 130 if cancelled, 1 if any failed, else 0."""
    code = F.when(F.bool_or(F.col("status") == "cancelled"), 130).when(F.bool_or(F.col("status") == "failure"), 1).otherwise(0)
    return log.groupBy("run").agg(code.alias("code"))


def prefetch_stops(resolutions: DataFrame, after: int = 8, share: float = 0.5) -> DataFrame:
    """run, pos: where each run of resolutions(run, pos, matched) stops prefetching: the first place from `after` on with under `share` matched."""
    order = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = resolutions.select("run", "pos", F.count("*").over(order).alias("n"), F.sum(F.col("matched").cast("long")).over(order).alias("m"))
    return counted.where((F.col("n") >= after) & (F.col("m") < F.col("n") * share)).groupBy("run").agg(F.min("pos").alias("pos"))


def newest_sets(sets: DataFrame, n: int = 8) -> DataFrame:
    """The n newest distinct digests of each task of sets(task, digest, time)."""
    latest = sets.groupBy("task", "digest").agg(F.max("time").alias("time"))
    place = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("time"), "digest"))
    return latest.withColumn("place", place).where(F.col("place") <= n)


def longest_on_path(path: DataFrame, n: int = 3, least: int = 50) -> DataFrame:
    """The n longest steps of path(position, id, weight) of at least `least`, in the path's order."""
    return path.where(F.col("weight") >= least).orderBy(F.desc("weight"), "position").limit(n).orderBy("position")


def doctor_counts(findings: DataFrame) -> DataFrame:
    """errors, warnings and targets of findings(target, level)."""
    return findings.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"), F.countDistinct("target").alias("targets"))
