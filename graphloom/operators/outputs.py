"""Which files outputs and filesets select, and what the outputs of targets are by default."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.functions.globs import extended_regex, literal_folder
from graphloom.functions.names import workspace_path
from graphloom.functions.paths import ancestors
from graphloom.operators.tasks import with_self


@F.pandas_udf(StringType())
def _regex(globs: pd.Series) -> pd.Series:
    return globs.map(extended_regex)


@F.pandas_udf(StringType())
def _folder(globs: pd.Series) -> pd.Series:
    return globs.map(literal_folder)


def _compiled(patterns: DataFrame) -> DataFrame:
    """patterns with regex and anchor, the literal folder ('.' for none) all matches are in; each distinct pattern is translated once."""
    known = patterns.select("pattern").distinct().select("pattern", _regex("pattern").alias("regex"), _folder("pattern").alias("anchor"))
    return patterns.join(known, "pattern")


def _matches(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """path joined to every row of compiled patterns that matches it or a folder above it; meets by the patterns' literal folders."""
    places = paths.select("path").distinct().withColumn("anchor", F.explode(F.concat(F.array(F.lit(".")), with_self("path"))))
    return places.join(patterns, "anchor").where(F.exists(with_self("path"), lambda x: F.rlike(x, F.col("regex"))))


def output_matches(paths: DataFrame, outputs: DataFrame) -> DataFrame:
    """task, path: which of paths(path) outputs(task, pattern) of a task hold, '!' taking away; a pattern that matches a folder holds all in it."""
    rows = outputs.select("task", F.col("pattern").startswith("!").alias("negated"), F.regexp_replace("pattern", "^!", "").alias("pattern"))
    found = _matches(paths, _compiled(rows))
    return found.groupBy("task", "path").agg(F.bool_or("negated").alias("out")).where("NOT out").select("task", "path")


def default_outputs(targets: DataFrame) -> DataFrame:
    """task, output of targets(task, target, root, name, output_path, outputs): declared ones filled in, else outputPath, else the usual folders of build and prepare."""
    root, listed = F.col("root"), F.array().cast("array<string>")
    usual = F.array(F.concat(F.lit("dist/"), root), *(F.concat(root, F.lit(x)) for x in ("/dist", "/build", "/public")))
    guessed = F.when(F.coalesce(F.col("output_path"), F.lit("")) != "", F.array("output_path")).when(F.col("target").isin("build", "prepare"), usual).otherwise(listed)
    rows = targets.select("task", "root", "name", F.explode(F.array_distinct(F.coalesce("outputs", guessed))).alias("text"))
    bare = workspace_path(F.regexp_replace("text", "^!", ""), "root", "name")
    return rows.select("task", F.concat(F.when(F.col("text").startswith("!"), "!").otherwise(""), bare).alias("output")).where("output IS NOT NULL").distinct()


def group_files(paths: DataFrame, groups: DataFrame, roots: DataFrame) -> DataFrame:
    """group, path: what groups(group, pattern) select of paths(path), ignored files too. A '!' pattern takes away from the whole group, and a
    pattern read from a project's folder doesn't reach into projects (roots(root)) nested below it; a path without a pattern is taken as written."""
    rows = groups.select("group", F.col("pattern").startswith("!").alias("negated"), F.regexp_replace("pattern", "^!", "").alias("pattern"))
    found = _matches(paths, _compiled(rows))
    inside = roots.where("root <> '.'").select("root").distinct()
    owner = lambda of: F.max(F.when(F.col("root").isNotNull(), F.length("root"))).alias(of)
    owned = found.select("path").distinct().withColumn("root", F.explode(ancestors("path"))).join(inside.withColumn("r", F.col("root")), "root").groupBy("path").agg(owner("path_owner"))
    anchored = found.select("anchor").distinct().withColumn("root", F.explode(with_self("anchor"))).join(inside.withColumn("r", F.col("root")), "root").groupBy("anchor").agg(owner("anchor_owner"))
    rows = found.join(owned, "path", "left").join(anchored, "anchor", "left")
    nested = F.col("anchor_owner").isNotNull() & (F.col("path_owner") > F.col("anchor_owner")) & (F.col("anchor") != F.col("path"))
    kept = rows.where(F.col("negated") | ~F.coalesce(nested, F.lit(False)))
    return kept.groupBy("group", "path").agg(F.bool_or("negated").alias("out"), F.bool_or(~F.col("negated")).alias("some")).where("some AND NOT out").select("group", "path")


def inspected(task_inputs: DataFrame, task: str, check: list[str] | None = None) -> DataFrame:
    """kind, value of a task's inputs(task, kind, value: file, environment, runtime, dependent output or external); with check, value and held of those values instead."""
    mine = task_inputs.where(F.col("task") == task).select("kind", "value").distinct()
    if check is None:
        return mine
    asked = task_inputs.sparkSession.createDataFrame([(v,) for v in check], "value string")
    return asked.join(mine.select("value").distinct().withColumn("held", F.lit(True)), "value", "left").select("value", F.coalesce("held", F.lit(False)).alias("held"))


def filtered(projects: DataFrame, targets: DataFrame, kind: str | None = None, with_targets: list[str] = ()) -> DataFrame:
    """projects(name, type) of one type, and with one at least of some targets(project, target)."""
    rows = projects if kind is None else projects.where(F.col("type") == kind)
    if with_targets:
        rows = rows.join(targets.where(F.col("target").isin(*with_targets)).select(F.col("project").alias("name")).distinct(), "name", "left_semi")
    return rows


def escaped(path: str | Column) -> Column:
    """A path as a glob that matches it alone."""
    return F.regexp_replace(path, r"([*?\[\]{}()!@+|\\,])", r"\\$1")
