"""What tasks read and wrote: accesses(seq, task, path, operation) against declared inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READS = ("read", "metadata", "list")


def with_written_before(accesses: DataFrame) -> DataFrame:
    """accesses with own: whether the task wrote the path at an earlier event, by its first write of each path."""
    first = accesses.where("operation = 'write'").groupBy("task", "path").agg(F.min("seq").alias("_first"))
    return accesses.join(first, ["task", "path"], "left").withColumn("own", F.coalesce(F.col("_first") < F.col("seq"), F.lit(False))).drop("_first")


def outside_reads(accesses: DataFrame) -> DataFrame:
    """task, path, n: reads of paths that the task hadn't written by then."""
    return with_written_before(accesses).where((F.col("operation") == "read") & ~F.col("own")).groupBy("task", "path").agg(F.count("*").alias("n"))


def generated(accesses: DataFrame) -> DataFrame:
    """Events that read what their task wrote earlier."""
    return with_written_before(accesses).where(F.col("operation").isin(*READS) & F.col("own")).select("seq", "task", "path")


def package_paths(accesses: DataFrame, package) -> DataFrame:
    """package, paths: distinct paths read of each package, a column expression over path."""
    return accesses.where(F.col("operation").isin(*READS)).groupBy(package.alias("package")).agg(F.countDistinct("path").alias("paths"))


def categories(accesses: DataFrame, declared: DataFrame, produced: DataFrame) -> DataFrame:
    """category of each event: what a task generated itself, a dependency's output (produced(path)), a declared(task, path) input,
    discovery (listing, metadata), a failed lookup, or uncovered."""
    flags = (
        with_written_before(accesses)
        .join(declared.select("task", "path").distinct().withColumn("declared", F.lit(True)), ["task", "path"], "left")
        .join(produced.select("path").distinct().withColumn("produced", F.lit(True)), "path", "left")
    )
    category = (
        F.when(F.col("operation") == "write", "output")
        .when(F.col("own"), "generated")
        .when(F.col("produced"), "dependency-output")
        .when(F.col("declared"), "input")
        .when(F.col("operation").isin("list", "metadata"), "discovery")
        .when(F.col("operation") == "missing", "resolution")
        .otherwise("uncovered")
    )
    return flags.select("seq", "task", category.alias("category"))


def unobserved(declared: DataFrame, mandatory: DataFrame, accesses: DataFrame) -> DataFrame:
    """declared(task, path) inputs that are neither mandatory(path) nor read."""
    read = accesses.where(F.col("operation").isin(*READS)).select("task", "path").distinct()
    return declared.select("task", "path").distinct().join(mandatory.select("path"), "path", "left_anti").join(read, ["task", "path"], "left_anti")


def merged_observations(reports: DataFrame, context: str) -> DataFrame:
    """task, path observed in successful reports(task, path, context, status) of one context."""
    return reports.where((F.col("context") == context) & (F.col("status") == "success")).select("task", "path").distinct()


def pattern_sets(unmatched: DataFrame) -> DataFrame:
    """patterns, targets: targets grouped by the set of patterns of unmatched(target, task, pattern, selects) that select nothing in any of their tasks."""
    idle = unmatched.groupBy("target", "pattern").agg(F.bool_and(~F.col("selects")).alias("idle")).where("idle")
    sets = idle.groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("patterns"))
    return sets.groupBy("patterns").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"))
