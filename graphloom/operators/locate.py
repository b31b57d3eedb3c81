"""Owners of paths, globs over files, and what a change of tables means for projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.globs import matches
from graphloom.functions.paths import ancestors, depth


def owners(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """owner of each of paths(path): the longest of roots(root) that holds it, '.' without one."""
    above = paths.select("path").distinct().select("path", F.explode(F.concat(ancestors("path"), F.array("path"))).alias("root"))
    held = above.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("owner"))
    return paths.join(held, "path", "left").withColumn("owner", F.coalesce("owner", F.lit(".")))


def selected(paths: DataFrame, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """pattern, path of the files that each included glob and no excluded one matches; globs become filters of one scan each."""
    kept = paths
    for glob in exclude:
        kept = kept.where(~matches("path", glob))
    hits = F.array_compact(F.array(*(F.when(matches("path", glob), F.lit(glob)) for glob in include)))
    return kept.select("path", F.explode(hits).alias("pattern"))


def first_match(paths: DataFrame, globs: list[str]) -> DataFrame:
    """The first path, in order, of each glob that has one."""
    return selected(paths, globs).groupBy("pattern").agg(F.min("path").alias("path"))


def topmost_directories(writes: DataFrame, sources: DataFrame) -> DataFrame:
    """directory, files: the topmost directory above each of writes(path) that holds none of sources(path), with how many it holds."""
    occupied = sources.select(F.explode(ancestors("path")).alias("directory")).distinct()
    above = writes.select("path", F.explode(ancestors("path")).alias("directory"))
    free = above.join(occupied, "directory", "left_anti").groupBy("path").agg(F.min_by("directory", depth("directory")).alias("directory"))
    return free.groupBy("directory").agg(F.count("*").alias("files"))


def install_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """importer, key, change: what installations(importer, key, fingerprint) gained, lost or hold another of."""
    both = before.withColumnRenamed("fingerprint", "old").join(after.withColumnRenamed("fingerprint", "new"), ["importer", "key"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("importer", "key", change.alias("change"))


def package_moves(changes: DataFrame, direct: DataFrame) -> DataFrame:
    """Per key of changes(importer, key, change): how many importers gained, lost or changed it, its kind, and whether direct(key) names it."""
    count = lambda kind: F.count_if(F.col("change") == kind)
    rows = changes.groupBy("key").agg(count("added").alias("added"), count("removed").alias("removed"), count("changed").alias("changed"))
    kind = F.when((F.col("added") > 0) & (F.col("removed") > 0), "moved").when(F.col("added") > 0, "added").when(F.col("removed") > 0, "removed").otherwise("changed")
    named = direct.select("key").distinct().withColumn("direct", F.lit(True))
    return rows.withColumn("kind", kind).join(named, "key", "left").withColumn("direct", F.coalesce("direct", F.lit(False)))


def substituted(changes: DataFrame, claimed: DataFrame, artifacts: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """changes(path) less those claimed(path), plus the artifacts(path, before, after) that differ; if a row of failed tells of a projection that failed, changes as they are."""
    if failed is not None and failed.limit(1).count():
        return changes.select("path").distinct()
    moved = artifacts.where(~F.col("before").eqNullSafe(F.col("after"))).select("path")
    return changes.select("path").join(claimed.select("path"), "path", "left_anti").union(moved).distinct()


def package_report(changes: DataFrame, direct: DataFrame) -> DataFrame:
    """name, direct, before, after, kind, rank of changes(key, change), by the package that each key 'name@version(peers)' is of.

    rank puts the most telling first, then by name: 0 moved to other versions, 1 added or removed, 2 of the same versions (other peers
    or a patch), 3 only what it depends on changed. before and after are its versions that went and came; direct(name) are named by an importer.
    """
    bare = F.regexp_replace("key", r"\(.*$", "")
    versions = lambda change: F.array_sort(F.collect_set(F.when(F.col("change") == change, F.regexp_extract(bare, r"^@?[^@]*@(.*)$", 1))))
    rows = changes.groupBy(F.regexp_extract(bare, "^(@?[^@]*)", 1).alias("name")).agg(versions("removed").alias("before"), versions("added").alias("after"))
    came, went = F.size("after") > 0, F.size("before") > 0
    kind = F.when(~came & ~went, "dependencies").when(~went, "added").when(~came, "removed").when(F.col("before") == F.col("after"), "peers").otherwise("moved")
    rank = F.element_at(F.create_map(*(F.lit(x) for x in ("moved", 0, "added", 1, "removed", 1, "peers", 2, "dependencies", 3))), F.col("kind"))
    named = direct.select("name").distinct().withColumn("direct", F.lit(True))
    return rows.withColumn("kind", kind).join(named, "name", "left").select("name", F.coalesce("direct", F.lit(False)).alias("direct"), "before", "after", "kind", rank.cast("long").alias("rank"))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    return left.subtract(right).withColumn("side", F.lit("left")).union(right.subtract(left).withColumn("side", F.lit("right")))


def reasons(located: list[tuple[str, DataFrame]]) -> DataFrame:
    """project, reasons: the reasons of several locators' (project, detail), in the locators' order, then by detail."""
    parts = [rows.select("project", F.lit(k).alias("place"), F.lit(name).alias("reason"), F.col("detail").cast("string").alias("detail")) for k, (name, rows) in enumerate(located)]
    union = parts[0]
    for part in parts[1:]:
        union = union.union(part)
    listed = F.transform(F.array_sort(F.collect_set(F.struct("place", "detail", "reason"))), lambda r: F.concat_ws(":", r["reason"], r["detail"]))
    return union.groupBy("project").agg(F.array_join(listed, ";").alias("reasons"))


def resolved_links(deps: DataFrame, packages: DataFrame) -> DataFrame:
    """source, target: deps(project, section, name, range) of each project, the first section that names one counting, joined to the
    package of the name (of several the last by path) if its version is within the range."""
    from graphloom.functions.semver import with_satisfies

    rank = F.array_position(F.array(*map(F.lit, ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"))), F.col("section"))
    first = Window.partitionBy("project", "name").orderBy(rank, "range")
    chosen = deps.withColumn("place", F.row_number().over(first)).where("place = 1")
    last = packages.groupBy("name").agg(F.max_by(F.struct("project", "version"), F.struct("path", "project")).alias("p"))
    pairs = chosen.join(last, "name").select(F.col("project").alias("source"), F.col("p.project").alias("target"), F.col("p.version").alias("version"), "range")
    return with_satisfies(pairs, "version", "range").where("satisfied AND source <> target").select("source", "target", "version", "range")
