"""Task plans from rules, configuration differences, merge bases, and projects affected by a change set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import explained, reachable
from graphloom.operators.locate import owners
from graphloom.session import FEW
from graphloom.session import counted as checkpointed


def nearest_with_target(starts: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """start, target, project: for each of starts(start, target), the nearest dependencies that have the target, looking
    through those of targets(project, target) that lack it."""
    has = targets.select("project", "target").distinct()
    steps = checkpointed(edges.select(F.col("source").alias("at"), F.col("target").alias("project")).distinct())
    frontier = checkpointed(starts.select("start", "target", F.col("start").alias("at")).distinct())
    found = seen = None
    while n := frontier.limit(FEW + 1).count():
        ahead = checkpointed((F.broadcast(frontier) if n <= FEW else frontier).join(steps, "at").select("start", "target", "project").distinct())
        here = checkpointed(ahead.join(has, ["project", "target"], "left_semi").select("start", "target", "project"))
        through = ahead.join(has, ["project", "target"], "left_anti").select("start", "target", F.col("project").alias("at"))
        through = through if seen is None else through.join(seen, ["start", "target", "at"], "left_anti")
        frontier = checkpointed(through)
        found = here if found is None else checkpointed(found.union(here))
        seen = frontier if seen is None else checkpointed(seen.union(frontier))
    return found.distinct() if found is not None else starts.select("start", "target", F.col("start").alias("project")).limit(0)


def plan_tasks(requests: DataFrame, targets: DataFrame, rules: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks(project, target), task_edges(project, target, on_project, on_target)) that requests(project, target) expand to.

    rules(target, on_target, upstream): a target depends on another of its own project if that has it, or, upstream,
    on it in the nearest dependencies that have it. Self-references are dropped.
    """
    has = checkpointed(targets.select("project", "target").distinct())
    asked = has.join(F.broadcast(rules) if rules.count() < 10_000 else rules, "target")
    own = asked.where("NOT upstream").select("project", "target", F.col("project").alias("on_project"), "on_target")
    own = own.join(has.select(F.col("project").alias("on_project"), F.col("target").alias("on_target")), ["on_project", "on_target"], "left_semi")
    up = asked.where("upstream")
    near = nearest_with_target(up.select(F.col("project").alias("start"), F.col("on_target").alias("target")), edges, has)
    near = near.select(F.col("start").alias("project"), F.col("target").alias("on_target"), F.col("project").alias("on_project"))
    beyond = up.join(near, ["project", "on_target"]).select("project", "target", "on_project", "on_target")
    links = own.select("project", "target", "on_project", "on_target").union(beyond)
    links = checkpointed(links.where("project <> on_project OR target <> on_target").distinct())
    tasks = frontier = checkpointed(requests.select("project", "target").distinct().join(has, ["project", "target"], "left_semi"))
    while n := frontier.limit(FEW + 1).count():
        ahead = (F.broadcast(frontier) if n <= FEW else frontier).join(links, ["project", "target"]).select(F.col("on_project").alias("project"), F.col("on_target").alias("target")).distinct()
        frontier = checkpointed(ahead.join(tasks, ["project", "target"], "left_anti"))
        tasks = checkpointed(tasks.union(frontier))
    return tasks, links.join(tasks, ["project", "target"], "left_semi")


def config_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """project, field, kind: what differs between two states(project, field, document), by canonical JSON."""
    from graphloom.functions.documents import canonical

    old = before.select("project", "field", canonical("document").alias("old"))
    new = after.select("project", "field", canonical("document").alias("new"))
    both = old.join(new, ["project", "field"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Deleted").otherwise("Modified")
    return both.select("project", "field", kind.alias("kind"))


def merge_bases(commits: DataFrame, left, right) -> DataFrame:
    """id: the common ancestors of two of commits(source, target = parent) that no other common ancestor descends from."""
    spark, kind = commits.sparkSession, commits.schema["source"].dataType.simpleString()
    of = lambda x: reachable(spark.createDataFrame([(x,)], f"id {kind}"), commits, dependents=False).select("id")
    common = checkpointed(of(left).join(of(right), "id", "left_semi"))
    below = commits.join(common.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    return common.join(below, "id", "left_anti")


def merge_base(commits: DataFrame, left, right, upstream=None) -> DataFrame:
    """id: the base of two commits, the first of several by id; where the branch's upstream has another base with right that descends from it, that one."""
    spark, kind = commits.sparkSession, commits.schema["source"].dataType.simpleString()
    local = checkpointed(merge_bases(commits, left, right).agg(F.min("id").alias("id")))
    if upstream is None:
        return local
    remote = checkpointed(merge_bases(commits, upstream, right).agg(F.min("id").alias("id")))
    found, base = remote.first()[0], local.first()[0]
    older = reachable(spark.createDataFrame([(found,)], f"id {kind}"), commits, dependents=False) if found is not None else local.limit(0)
    later = found is not None and found != base and (base is None or bool(older.where(F.col("id") == base).limit(1).count()))
    return remote if later else local


def landed(commits: DataFrame, base: int, head: int, branch: int) -> DataFrame:
    """n: commits of base..head that the branch has."""
    spark = commits.sparkSession
    of = lambda x: reachable(spark.createDataFrame([(x,)], "id long"), commits, dependents=False).select("id")
    return of(head).join(of(base), "id", "left_anti").join(of(branch), "id", "left_semi").agg(F.count("*").alias("n"))


def touched_by_path(changes: DataFrame, roots: DataFrame) -> DataFrame:
    """project, detail: the owner of each changed path."""
    return owners(changes.select("path"), roots).where("owner <> '.'").select(F.col("owner").alias("project"), F.col("path").alias("detail")).distinct()


def affected(touched: DataFrame, edges: DataFrame, everything: DataFrame | None = None) -> DataFrame:
    """Explained closure of touched(id); where everything(id) is given, a change couldn't be read and all are touched."""
    return explained(touched if everything is None else everything, edges)
