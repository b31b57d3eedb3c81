"""The questions a user asks of a workspace, as named functions over DataFrames; each puts operators together and returns a DataFrame.

A workspace is files(path, text); history is tasks(run, task, ...) as sources.history_store reads it. Nothing here runs a task.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.documents import canonical
from graphloom.operators import affected as planning
from graphloom.operators import closure, findings, history, locate, locators, outputs, selection, storage, tasks
from graphloom.session import checkpointed
from graphloom.sources import history_store, lockfile, workspace
from graphloom.streaming import watch

#: Executors that the doctor accepts.
EXECUTORS = ["nx:run-commands", "nx:run-script", "nx:noop"]
#: Project files, which are compared by what they come to.
PROJECT_FILES = r"(^|/)project(\.local)?\.json$"


def projects(files: DataFrame, patterns: list[str] | None = None, exclude: list[str] = (), kind: str | None = None, with_targets: list[str] = (), native: bool = False) -> DataFrame:
    """Projects by selectors, less excluded ones among them, of one type, with one of some targets."""
    found = workspace.load(files)
    tagged = found.withColumn("tag", F.explode_outer("tags"))
    chosen = tagged if patterns is None else selection.select_projects(tagged, list(patterns), native)
    if exclude:
        chosen = chosen.join(selection.select_projects(chosen, list(exclude), native).select("name"), "name", "left_anti")
    rows = found.join(chosen.select("name").distinct(), "name", "left_semi").withColumn("type", F.col("project_type"))
    return outputs.filtered(rows, workspace.targets(files, found), kind, list(with_targets)).drop("type")


def dependency_edges(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """source, target, kind of the project graph: declared dependencies that resolve to workspace packages, and what implicit ones select, less what they exclude."""
    found = workspace.load(files) if found is None else found
    of = found.select("name", "root")
    declared = workspace.package_deps(files).withColumnRenamed("name", "dependency").join(of, "root").select(F.col("name").alias("project"), "section", F.col("dependency").alias("name"), F.regexp_replace("range", "^workspace:", "").alias("range"))
    declared = declared.withColumn("range", F.when(F.col("range").isin("", "^", "~"), "*").otherwise(F.col("range")))
    packages = workspace.packages(files).withColumnRenamed("name", "package").join(of, "root").select(F.col("package").alias("name"), F.col("name").alias("project"), "path", F.coalesce("version", F.lit("0.0.0")).alias("version"))
    static = locate.resolved_links(declared, packages).select("source", "target")
    implicit = found.select(F.col("name").alias("source"), F.posexplode("implicit_dependencies").alias("turn", "pattern"))
    return selection.edges_with_implicit(static, implicit, found.select("name", "root", "tags"))


def graph(files: DataFrame, focus: str | None = None, exclude: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the project graph, of what a project is related to and less excluded ones; edges to nodes that are out stay."""
    nodes, edges = workspace.load(files), dependency_edges(files)
    if focus is not None:
        seed = files.sparkSession.createDataFrame([(focus,)], "id string")
        related = closure.reachable(seed, edges).select("id").union(closure.reachable(seed, edges, False).select("id")).distinct()
        nodes = nodes.join(related.withColumnRenamed("id", "name"), "name", "left_semi")
    if exclude:
        nodes = nodes.where(~F.col("name").isin(*exclude))
    return nodes, edges.join(nodes.select(F.col("name").alias("source")), "source", "left_semi")


def project(files: DataFrame, name: str) -> DataFrame:
    return workspace.load(files).where(F.col("name") == name)


def target(files: DataFrame, name: str, target_name: str) -> DataFrame:
    """project, target, definition of one target."""
    return workspace.targets(files, project(files, name)).where(F.col("target") == target_name)


def _document(files: DataFrame, path: str) -> DataFrame:
    """document: the text of one file without comments, {} if it is missing; one row."""
    empty = files.sparkSession.createDataFrame([("{}",)], "document string")
    return files.where(F.col("path") == path).select(workspace.uncommented("text").alias("document")).unionByName(empty).limit(1)


def lockfile_mode(files: DataFrame) -> str | list[str]:
    """What the workspace's settings make of a changed lockfile: "auto", selectors of projects, or "all"."""
    text = files.where(F.col("path") == "nx.json").select(F.try_variant_get(F.try_parse_json(workspace.uncommented("text")), "$.pluginsConfig['@nx/js'].projectsAffectedByDependencyUpdates", "variant").alias("v")).select(F.to_json("v").alias("t")).first()
    found = json.loads(text.t) if text is not None and text.t is not None else "all"
    return found if isinstance(found, list) or found == "auto" else "all"


def installations(files: DataFrame) -> DataFrame:
    """importer, key, fingerprint of what the lockfile's importers install, directly or not."""
    entries = checkpointed(lockfile.scan(files.where(F.col("path") == "pnpm-lock.yaml")))
    resolution = entries.where("kind = 'resolution'").select(F.col("owner").alias("package"), "reference")
    rows = lockfile.installed(entries).withColumn("package", F.substring_index("key", "(", 1))
    return rows.join(resolution, "package", "left").select("importer", "key", F.coalesce("reference", F.lit("")).alias("fingerprint"))


def _by_lockfile(files: DataFrame, base_files: DataFrame, found: DataFrame, changed: list[str]) -> DataFrame:
    roots, mode = found.select(F.col("name").alias("project"), "root"), lockfile_mode(files)
    if isinstance(mode, list):
        chosen = selection.select_projects(found.withColumn("tag", F.explode_outer("tags")), mode)
        return chosen.select(F.col("name").alias("project"), F.lit("listed").alias("detail")).distinct()
    if mode == "all" or changed != ["pnpm-lock.yaml"]:
        return locators.by_lockfile(None, None, roots, "all")
    moves = locate.install_changes(installations(base_files), installations(files))
    return locators.by_lockfile(moves, roots.select(F.col("root").alias("importer"), "project"), roots)


def _manifests_before(files: DataFrame, base_files: DataFrame) -> DataFrame:
    """The files of now with the project files of before."""
    project = F.col("path").rlike(PROJECT_FILES)
    return files.where(~project).unionByName(base_files.where(project).select("path", "text"))


def touched(files: DataFrame, changes: DataFrame) -> DataFrame:
    """project, reasons: what changes(path, before, after) touch, by every rule that they call for: by path, resolved configuration, workspace settings, inputs from the workspace's root, removed
    projects, the lockfile, the root manifest and the root tsconfig.

    One pass over the changes' paths tells which rules those are. Configuration is compared as it resolves: what project files changed under the settings of now, and what
    settings changed over the project files of now.
    """
    project = F.col("path").rlike(PROJECT_FILES)
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    at = lambda path: F.coalesce(F.bool_or(F.col("path") == path), F.lit(False)).alias(path)
    calls = changes.agg(
        F.coalesce(F.bool_or(project & both), F.lit(False)).alias("manifests"), F.coalesce(F.bool_or(F.col("path").rlike(r"(^|/)(package|project)\.json$") & F.col("after").isNull()), F.lit(False)).alias("deleted"),
        *map(at, ("nx.json", "package.json", "tsconfig.base.json")), F.array_sort(F.collect_set(F.when(F.col("path").isin(*locators.LOCKFILES), F.col("path")))).alias("locks"),
    ).first()
    base_files, found = checkpointed(workspace.at_revision(files, changes)), workspace.load(files)
    roots = found.select(F.col("name").alias("project"), "root")
    names = roots.select("project")
    rules = {"file": locators.by_path(changes, roots, changes.where(project & both).select("path")), "implicit": locators.by_workspace_inputs(workspace.target_inputs(files, found), changes)}
    if calls["manifests"] or calls["nx.json"]:
        now = checkpointed(workspace.resolved_fields(files, found))
    if calls["manifests"]:
        older = _manifests_before(files, base_files)
        rules["project-configuration"] = locators.by_manifests(workspace.resolved_fields(older, workspace.projects(older)), now)
    if calls["nx.json"]:
        settings = files.where("path <> 'nx.json'").unionByName(base_files.where("path = 'nx.json'").select("path", "text"))
        rules["nx-json"] = locators.by_settings(_document(base_files, "nx.json"), _document(files, "nx.json"), names, workspace.resolved_fields(settings, found), now)
    if calls["deleted"]:
        base = checkpointed(workspace.projects(base_files))
        deleted = changes.where("after IS NULL").select("path")
        rules["removed"] = locators.by_removed(base.select(F.col("name").alias("project"), "root"), names, dependency_edges(base_files, base), dependency_edges(files, found), deleted)
    if calls["locks"]:
        rules["lockfile"] = _by_lockfile(files, base_files, found, calls["locks"])
    if calls["package.json"]:
        installed = workspace.package_deps(files).withColumnRenamed("name", "package").join(found.select("root", F.col("name").alias("project")), "root").select("project", "package").distinct()
        rules["root-package"] = locators.by_root_package(locators.root_package_changes(_document(base_files, "package.json"), _document(files, "package.json")), installed, names)
    if calls["tsconfig.base.json"]:
        text = lambda rows: _document(rows, "tsconfig.base.json").withColumnRenamed("document", "text")
        rules["tsconfig"] = locators.by_tsconfig(text(base_files), text(files), roots)
    return locators.touched(rules)


def explain_affected(files: DataFrame, changes: DataFrame, chains_of: list[str] = ()) -> DataFrame:
    """id, depth, parent, first, also, reasons, chain: affected projects, each with whom it is affected through, the touched one where that begins and why that one is; chain
    is the whole way to projects asked for, null for others."""
    found = checkpointed(touched(files, changes))
    rows = checkpointed(closure.explained(found.select(F.col("project").alias("id")), dependency_edges(files)).drop("rank"))
    rows = rows.join(found.select(F.col("project").alias("first"), "reasons"), "first")
    if not chains_of:
        return rows.withColumn("chain", F.lit(None).cast("array<string>"))
    return rows.join(closure.chains(rows, rows.where(F.col("id").isin(*chains_of)).select("id")), "id", "left")


def plan_tasks(files: DataFrame, requests: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, task_edges) that requests(project, target) expand to by rules(target, on_target, upstream): a dry run."""
    return planning.plan_tasks(requests, workspace.targets(files, workspace.load(files)), rules, dependency_edges(files))


def task_touched(files: DataFrame, changes: DataFrame) -> DataFrame:
    """project, target, reason, detail: why changes(path, before, after) touch targets of their own: a file among their inputs ("!" patterns take files away), what they resolve to, and
    what touches every task of their project: workspace settings, installations, the root manifest, the root tsconfig and removed projects."""
    found = workspace.load(files)
    own = checkpointed(workspace.target_inputs(files, found))
    root = F.col("root").eqNullSafe(".")
    placed = own.join(found.select(F.col("name").alias("project"), "root"), "project").withColumn("away", F.col("pattern").startswith("!")).withColumn("glob", F.regexp_replace("pattern", r"^!?\{[^}]*\}/", ""))
    within = F.col("pattern").contains("{projectRoot}")
    placed = placed.withColumn("glob", F.when(within & ~root, F.concat_ws("/", "root", "glob")).otherwise(F.col("glob")))
    met = selection.glob_join(selection.read_globs(placed), changes.select(F.col("path").alias("value"))).withColumnRenamed("value", "path")
    hits = placed.join(met, "glob").groupBy("project", "target", "path").agg(F.bool_or("away").alias("away")).where("NOT away")
    compared = changes.where(F.col("path").rlike(PROJECT_FILES) & F.col("before").isNotNull() & F.col("after").isNotNull()).select("path")
    direct = hits.join(compared, "path", "left_anti").select("project", "target", F.lit("input").alias("reason"), F.col("path").alias("detail"))
    before = workspace.at_revision(files, changes)
    old = workspace.targets(before, workspace.projects(before)).select("project", "target", canonical("definition").alias("value"))
    new = workspace.targets(files, found).select("project", "target", canonical("definition").alias("value"))
    changed = new.join(old.withColumnRenamed("value", "old"), ["project", "target"], "left").where(~F.col("old").eqNullSafe(F.col("value")))
    changed = changed.select("project", "target", F.lit("configuration").alias("reason"), F.when(F.col("old").isNull(), "added").otherwise("definition").alias("detail"))
    wide = touched(files, changes).select("project", F.explode(F.split("reasons", ";")).alias("r")).select("project", F.substring_index("r", ":", 1).alias("reason"), F.expr("substring(r, instr(r, ':') + 1)").alias("detail"))
    settings = (F.col("reason") == "nx-json") & F.col("detail").startswith("changed ")
    wide = wide.where(settings | F.col("reason").isin("lockfile", "root-package", "tsconfig", "removed"))
    return direct.unionByName(changed).unionByName(wide.join(new.select("project", "target"), "project").select("project", "target", "reason", "detail")).distinct()


def affected_tasks(files: DataFrame, changes: DataFrame, requests: DataFrame, rules: DataFrame, granularity: str = "tasks") -> DataFrame:
    """project, target, pass, via, reasons of planned tasks that changes touch, or that depend on one such; with the granularity "projects" every task of a touched project counts as touched."""
    plan, edges = map(checkpointed, plan_tasks(files, requests, rules))
    name = lambda a, b: F.concat_ws(":", a, b)
    if granularity == "projects":
        hit = plan.join(touched(files, changes), "project")
    else:
        listed = F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "reason", "detail"))), ";")
        hit = plan.join(task_touched(files, changes).groupBy("project", "target").agg(listed.alias("reasons")), ["project", "target"])
    hit = checkpointed(hit.select(name("project", "target").alias("task"), "reasons"))
    found = tasks.propagated(hit.select("task"), edges.select(name("project", "target").alias("task"), name("on_project", "on_target").alias("producer")))
    return plan.withColumn("task", name("project", "target")).join(found, "task").join(hit, "task", "left").select("project", "target", "pass", "via", "reasons")


def runs(log: DataFrame, n: int = 20) -> DataFrame:
    """The newest runs with their summary."""
    return history.newest_runs(log, n).join(history.run_summary(log), "run")


def run(log: DataFrame, of: object | None = None) -> DataFrame:
    """The executions of a run, or of the latest."""
    return history_store.tasks_of(log, of)


def task_history(log: DataFrame, task: str, n: int = 20) -> DataFrame:
    """The newest executions of a task with the key before."""
    rows = log.where(F.col("task") == task)
    return rows.join(history.previous_keys(rows).select("execution", "previous_key"), "execution", "left").orderBy(F.desc("started"), F.desc("execution")).limit(n)


def flaky(log: DataFrame, task: str | None = None, n: int = 20) -> DataFrame:
    """Keys that both succeeded and failed, the last seen first."""
    found = history.flaky(log if task is None else log.where(F.col("task") == task))
    return found.orderBy(F.desc("last_started"), "task", "key").limit(n)


def log(executions: DataFrame, logs: DataFrame, task: str, of: object | None = None) -> DataFrame:
    return history_store.log_of(executions, logs, task, of)


def key(executions: DataFrame, key_inputs: DataFrame, task: str, of: object | None = None) -> DataFrame:
    return history_store.key_of(executions, key_inputs, task, of)


def key_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What differs between two keys' inputs(key, section, name, value), in groups."""
    return tasks.key_groups(before, after)


def doctor(files: DataFrame, known_fields: dict[str, list[str]] | None = None, globs: DataFrame | None = None, executors: list[str] = tuple(EXECUTORS)) -> DataFrame:
    """The doctor's findings of a workspace."""
    found = workspace.targets(files, workspace.load(files))
    settings = files.where(F.col("path") == "nx.json").select(workspace.uncommented("text").alias("document"))
    rows = found.select("project", "target", F.get_json_object("definition", "$.executor").alias("executor"), "definition")
    return findings.doctor(settings, rows, list(executors), known_fields or {}, globs)


def analyze_inputs(uncovered: DataFrame, observed: DataFrame, declared: DataFrame, mandatory: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(review groups, exact candidates, suggested filesets) of a task's accesses."""
    return findings.review_groups(uncovered), findings.candidate_filesets(observed, declared, mandatory), findings.suggested_filesets(observed, declared, listed)


def warm_candidates(writes: DataFrame, sources: DataFrame) -> DataFrame:
    """directory, files, place: folders that tasks write and that hold no source, most files first."""
    found = locate.topmost_directories(writes, sources).withColumn("order", -F.col("files"))
    return storage.ranked(found, "order", "directory").select("directory", "files", F.col("rank").alias("place"))


def plan_eviction(entries: DataFrame, entry_blobs: DataFrame, blobs: DataFrame, limit: int, unused_before: int) -> DataFrame:
    return storage.evictions(entries, entry_blobs, blobs, limit, unused_before)


def watch_stream(events: DataFrame, gap: int = 150, cap: int = 1000) -> DataFrame:
    """Batches of a stream of events(watcher, path, ts)."""
    return watch.capped_stream(events, gap, cap)

