"""What a change means task by task: propagation, reachability decisions, producers, coverage and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import ancestors
from graphloom.operators.closure import above, discovered, reachable, reachable_pairs
from graphloom.session import counted as checkpointed
from graphloom.session import met


def propagated(touched: DataFrame, producers: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """task, pass, via: touched(task), and tasks that read what an affected one of producers(task, producer) makes.

    Sorted scans explain a task by its first producer affected by its turn: a producer earlier in order counts
    in the same scan, a later one in the next. pass is the scan that reaches a task (0 for touched ones, whose
    via is null), the least over its producers; skipped(task) are neither affected nor lead on.
    """
    reads = producers.select("task", "producer").where("task <> producer").distinct()
    if skipped is not None:
        reads = reads.join(skipped.select("task"), "task", "left_anti")
    start = touched.select("task").distinct()
    reads = checkpointed(reads.join(start, "task", "left_anti"))
    seen = frontier = checkpointed(start.select("task", F.lit(0).alias("pass"), F.lit(True).alias("touched")))
    while frontier.limit(1).count():
        turn = F.when(F.col("touched") | (F.col("task") > F.col("producer")), F.col("pass")).otherwise(F.col("pass") + 1)
        ahead = reads.join(frontier.withColumnRenamed("task", "producer"), "producer").groupBy("task").agg(F.min(turn).alias("now"))
        better = ahead.join(seen.select("task", F.col("pass").alias("was")), "task", "left").where("was IS NULL OR now < was")
        frontier = checkpointed(better.select("task", F.col("now").alias("pass"), F.lit(False).alias("touched")))
        seen = checkpointed(seen.join(frontier.select("task"), "task", "left_anti").union(frontier))
    made = seen.select(F.col("task").alias("producer"), F.col("pass").alias("made"), F.col("touched").alias("first"))
    ready = reads.join(made, "producer").join(seen.select("task", "pass"), "task").where("first OR made < pass OR (made = pass AND producer < task)")
    via = ready.groupBy("task").agg(F.min("producer").alias("via"))
    return seen.join(via, "task", "left").select("task", "pass", "via")


def decided(causes: DataFrame, reasons: DataFrame, anchors: DataFrame, cases: DataFrame) -> DataFrame:
    """task, decision, detail: whether narrowed tasks of causes(task, via) run whole, in cases, or not at all.

    Whole where an affected producer (via) or a reason that no import carries (reasons(task, reason, carried)) is the
    cause, or an anchor of anchors(task, file, reached) imports a change; else the cases(task, case, reached) that do, if any.
    """
    kept = reasons.where("NOT carried").groupBy("task").agg(F.min("reason").alias("kept"))
    anchor = anchors.where("reached").groupBy("task").agg(F.min("file").alias("anchor"))
    counted = cases.groupBy("task").agg(F.count_if("reached").alias("some"), F.count("*").alias("of"))
    rows = causes.join(kept, "task", "left").join(anchor, "task", "left").join(counted, "task", "left")
    decision = F.when(F.col("via").isNotNull() | F.col("kept").isNotNull() | F.col("anchor").isNotNull(), "whole").when(F.col("some") > 0, "cases").otherwise("left-out")
    shown = F.concat(F.col("some").cast("string"), F.lit(" of "), F.col("of").cast("string"))
    detail = F.coalesce(F.concat(F.lit("task:"), "via"), F.concat(F.lit("reason:"), "kept"), F.concat(F.lit("anchor:"), "anchor"), F.when(F.col("some") > 0, shown))
    return rows.select("task", decision.alias("decision"), detail.alias("detail"))


def demoted(decisions: DataFrame, affected: DataFrame, producers: DataFrame) -> DataFrame:
    """decisions(task, decision) after every narrowed task that reads, over other affected tasks, what a kept one makes runs whole; why names the first such producer.

    affected(task, touched); kept ones start from touched tasks that aren't left out.
    """
    reads = producers.join(affected.select("task"), "task", "left_semi").select(F.col("task").alias("source"), F.col("producer").alias("target"))
    out = decisions.where("decision = 'left-out'").select("task")
    start = affected.where("touched").select("task").join(out, "task", "left_anti").select(F.col("task").alias("id"))
    kept = checkpointed(reachable(start, reads).select("id"))
    why = reads.join(kept.withColumnRenamed("id", "target"), "target", "left_semi").groupBy(F.col("source").alias("task")).agg(F.min("target").alias("why"))
    rows = decisions.join(why, "task", "left")
    narrow = F.col("decision").isin("left-out", "cases") & F.col("why").isNotNull()
    return rows.select("task", F.when(narrow, "whole").otherwise(F.col("decision")).alias("decision"), F.when(narrow, F.col("why")).alias("why"))


def import_chains(anchors: DataFrame, changed: DataFrame, imports: DataFrame) -> DataFrame:
    """id, chain: for each of anchors(id) that leads over imports(file, imported) to one of changed(id), the files on a shortest way, from the change to the anchor."""
    found = checkpointed(discovered(changed, imports.select(F.col("file").alias("source"), F.col("imported").alias("target"))))
    wanted = anchors.select("id").distinct().join(found.select("id"), "id", "left_semi")
    rows = above(found.select("id", "parent"), wanted)
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("place"), "id"))), lambda x: x["id"])
    return rows.groupBy("start").agg(listed.alias("chain")).withColumnRenamed("start", "id")


def output_dependencies(tasks: DataFrame, edges: DataFrame, transitive: bool) -> DataFrame:
    """task, dependency: the tasks whose outputs tasks(task) may read, over edges(task, dependency): its own, or all that those lead to."""
    own = edges.join(tasks.select("task").distinct(), "task", "left_semi").select("task", "dependency").distinct()
    if not transitive:
        return own
    found = reachable_pairs(own.select(F.col("task").alias("group"), F.col("dependency").alias("id")), edges.select(F.col("task").alias("source"), F.col("dependency").alias("target")))
    return found.select(F.col("group").alias("task"), F.col("id").alias("dependency"))


def link_targets(paths: DataFrame, links: DataFrame) -> DataFrame:
    """path, target: what each of paths(path) reads over links(path, target), a link's target, its target's, and so on; circles are safe."""
    starts = paths.select("path").distinct().join(links.select("path").distinct(), "path", "left_semi")
    found = reachable_pairs(starts.select(F.col("path").alias("group"), F.col("path").alias("id")), links.select(F.col("path").alias("source"), "target"))
    return found.where(F.col("group") != F.col("id")).select(F.col("group").alias("path"), F.col("id").alias("target"))


def with_self(path: str | Column) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.concat(ancestors(path), F.array(path))


def producers(inputs: DataFrame, outputs: DataFrame, upstream: DataFrame) -> DataFrame:
    """task, producer: tasks of upstream(task, dependency) whose outputs(task, path) overlap inputs(task, path): one path is the other or holds it."""
    wanted = inputs.select("task", "path").distinct()
    made = outputs.select(F.col("task").alias("producer"), F.col("path").alias("out")).distinct()
    below = wanted.withColumn("at", F.explode(with_self("path"))).join(made, F.col("at") == F.col("out")).select("task", "producer")
    holding = made.withColumn("at", F.explode(with_self("out"))).join(wanted, F.col("at") == F.col("path")).select("task", "producer")
    both = below.union(holding).where("task <> producer").distinct()
    return both.join(upstream.select("task", F.col("dependency").alias("producer")).distinct(), ["task", "producer"], "left_semi")


def reconfigured(before: DataFrame, after: DataFrame) -> DataFrame:
    """task, change of after(task, definition, inputs, dependencies, reads_outputs) held against before: its definition or a new task, what its inputs select, or whose outputs it reads.

    definition is canonical JSON, inputs and dependencies are sets.
    """
    old = before.select("task", F.col("definition").alias("d"), F.array_sort("inputs").alias("i"), F.array_sort("dependencies").alias("e"), F.lit(True).alias("known"))
    rows = after.join(old, "task", "left")
    fresh = F.col("known").isNull() | ~F.col("definition").eqNullSafe(F.col("d"))
    selects = ~F.array_sort("inputs").eqNullSafe(F.col("i")) | (F.col("reads_outputs") & ~F.array_sort("dependencies").eqNullSafe(F.col("e")))
    return rows.select("task", F.when(fresh, "definition").when(selects, "inputs").alias("change")).where("change IS NOT NULL")


def uncovered(recorded: DataFrame, keyed: DataFrame, selected: DataFrame) -> DataFrame:
    """task, path, kind of recorded(task, path, kind: read, found, looked for or listed, exists, folder) that a declared key doesn't hold.

    keyed(task, path) are files it holds; selected(task, path) what its patterns would select. A read of a file that is gone counts as
    held if selected; a found folder if it holds a keyed file; a listing if its folder is selected.
    """
    held = keyed.select("task", "path").distinct()
    above_keyed = held.select("task", F.explode(ancestors("path")).alias("path")).distinct()
    mark = lambda rows, name: rows.select("task", "path").distinct().withColumn(name, F.lit(True))
    rows = recorded
    for marks, name in ((held, "keyed"), (above_keyed, "holds"), (selected, "selected")):
        rows = rows.join(mark(marks, name), ["task", "path"], "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    fine = (
        F.when(F.col("kind") == "read", flag("keyed") | (~F.col("exists") & flag("selected")))
        .when(F.col("kind") == "found", flag("keyed") | (F.col("folder") & flag("holds")))
        .when(F.col("kind") == "looked for", flag("keyed") | flag("selected"))
        .otherwise(flag("selected"))
    )
    return rows.where(~fine).select("task", "path", "kind")


#: Kinds of a recorded path set, as what a change of theirs is called.
SET_KINDS = ("read", "listed", "found", "looked for")


def changed_paths(then: DataFrame, now: DataFrame) -> DataFrame:
    """task, path, kind of recorded paths then(task, path, kind, value) that are otherwise now(task, path, kind, value); a path looked for and not found keeps no value."""
    rows = then.join(now.withColumnRenamed("value", "is"), ["task", "path", "kind"], "left")
    was = F.when(F.col("kind") == "looked for", F.coalesce("value", F.lit("absent"))).otherwise(F.col("value"))
    return rows.where(~was.eqNullSafe(F.col("is"))).select("task", "path", "kind")


def same_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """task, same: whether path sets (task, path, kind) of both sides hold the same, by digests of their sorted members."""
    digest = lambda rows, name: rows.groupBy("task").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set(F.concat_ws("\t", "kind", "path")))), 256).alias(name))
    return digest(left, "l").join(digest(right, "r"), "task", "full_outer").select("task", F.col("l").eqNullSafe(F.col("r")).alias("same"))


def key_groups(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, group, name, change: what differs between two keys' inputs(key, section, name, value), named as an explanation groups them.

    Sections: file, inferred file, value, lockfile, settings, project, workspace file, manifest, dependency, definition, args, tooling.
    Values are by their names' prefixes: env:, runtime:, externalDependencies; others are inputs.
    """
    both = before.withColumnRenamed("value", "was").join(after.withColumnRenamed("value", "is"), ["key", "section", "name"], "full_outer").where(~F.col("was").eqNullSafe(F.col("is")))
    section, name = F.col("section"), F.col("name")
    of_value = F.when(name.startswith("env:"), "env").when(name.startswith("runtime:"), "runtime").when(name == "externalDependencies", "lockfile").otherwise("inputs")
    group = (
        F.when(section == "file", "files").when(section == "value", of_value).when(section == "lockfile", "lockfile").when(section == "dependency", "dependencies")
        .when(section.isin("inferred file", "settings", "project", "workspace file", "manifest"), "configuration").otherwise(section)
    )
    label = (
        F.when(section == "settings", F.concat(F.lit("nx.json "), name)).when(section == "project", F.concat(F.lit("project "), name))
        .when(section == "workspace file", "pnpm-workspace.yaml, keys that choose no versions").when(section == "manifest", F.concat(name, F.lit(", what others read of it"))).otherwise(name)
    )
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("changed")
    return both.select("key", group.alias("group"), label.alias("name"), change.alias("change"))


def import_answers(anchors: DataFrame, changed: DataFrame, imports: DataFrame, unresolved: DataFrame) -> DataFrame:
    """id, chain, gap, specifier of anchors(id): what an anchor imports, over imports(file, imported).

    chain is a shortest way from one of changed(id) to it. Where none is, an import that nothing placed may hide one: specifier is
    the nearest of unresolved(file, specifier) that the anchor leads to, the first of its file, and gap the way from that file to
    the anchor. Anchors without either are left out. The two searches carry a parent a file each, however deep imports go.
    """
    reached = checkpointed(import_chains(anchors, changed, imports))
    first = unresolved.groupBy(F.col("file").alias("_file")).agg(F.min("specifier").alias("specifier"))
    open_ = import_chains(anchors.select("id").join(reached.select("id"), "id", "left_anti"), first.select(F.col("_file").alias("id")), imports)
    gaps = open_.select("id", F.col("chain").alias("gap"), F.col("chain")[0].alias("_file")).join(met(first), "_file")
    return reached.select("id", "chain", F.lit(None).cast(reached.schema["chain"].dataType).alias("gap"), F.lit(None).cast("string").alias("specifier")).unionByName(
        gaps.select("id", F.lit(None).cast(reached.schema["chain"].dataType).alias("chain"), "gap", "specifier")
    )


def decided_by_imports(causes: DataFrame, reasons: DataFrame, anchors: DataFrame, cases: DataFrame, answers: DataFrame) -> DataFrame:
    """task, decision, detail of causes(task, via, by_cases): as `decided`, by import_answers of anchors(task, file) and cases(task, file).

    A task runs whole, too, if its cases, or its anchors where it declares none (by_cases), name no file, and a gap counts as
    reached: what it hides can't be known. Detail names the first cause: task, reason, nothing named, anchor, gap, or cases of all.
    """
    known = answers.select(F.col("id").alias("file"), F.when(F.col("chain").isNotNull(), F.concat(F.lit("anchor:"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("gap:"), F.col("id").cast("string"), F.lit(":"), "specifier")).alias("shown"))
    seen = lambda rows: rows.select("task", "file").distinct().join(known.hint("merge"), "file", "left")
    kept = reasons.where("NOT carried").groupBy("task").agg(F.min("reason").alias("kept")).hint("merge")
    anchored = seen(anchors).groupBy("task").agg(F.count("*").alias("anchors"), F.min_by("shown", F.when(F.col("shown").isNotNull(), F.col("file"))).alias("anchor"))
    counted = seen(cases).groupBy("task").agg(F.count("shown").alias("some"), F.count("*").alias("of"))
    rows = causes.join(kept, "task", "left").join(anchored.hint("merge"), "task", "left").join(counted.hint("merge"), "task", "left")
    unnamed = F.when(F.col("by_cases") & F.col("of").isNull(), "nothing:cases").when(~F.col("by_cases") & F.col("anchors").isNull(), "nothing:anchors")
    why = F.coalesce(F.concat(F.lit("task:"), "via"), F.concat(F.lit("reason:"), "kept"), unnamed, F.col("anchor"))
    some = F.col("by_cases") & (F.col("some") > 0)
    decision = F.when(why.isNotNull(), "whole").when(some, "cases").otherwise("left-out")
    return rows.select("task", decision.alias("decision"), F.coalesce(why, F.when(some, F.concat(F.col("some").cast("string"), F.lit(" of "), F.col("of").cast("string")))).alias("detail"))
