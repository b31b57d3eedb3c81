"""Which projects a change touches and why: one function a rule, each giving project, detail; touched() puts them together.

A rule that can't tell, or that everything depends on, touches all projects with one detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.documents import UNKEYED_SETTINGS, canonical, entries, tsconfig_parts
from graphloom.functions.paths import ancestors
from graphloom.operators.locate import owners, reasons

TYPES = "@types/"


def by_path(changes: DataFrame, roots: DataFrame, compared: DataFrame | None = None, read: DataFrame | None = None) -> DataFrame:
    """The owner in roots(project, root) of each changed path; of manifests compared(path) only those that an input reads(path)."""
    paths = changes.select("path").distinct()
    if compared is not None:
        skip = compared.select("path") if read is None else compared.select("path").join(read.select("path"), "path", "left_anti")
        paths = paths.join(skip, "path", "left_anti")
    owned = owners(paths, roots.select("root"))
    return owned.join(roots, owned.owner == roots.root).select("project", F.col("path").alias("detail")).distinct()


def by_manifests(before: DataFrame, after: DataFrame) -> DataFrame:
    """Projects whose resolved configuration (project, field, document) differs, with the fields that do; of projects that are there now."""
    old, new = (rows.select("project", "field", canonical("document").alias(name)) for rows, name in ((before, "old"), (after, "new")))
    both = old.join(new, ["project", "field"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("project", F.col("field").alias("detail")).join(after.select("project").distinct(), "project", "left_semi")


def _every(projects: DataFrame, detail: DataFrame) -> DataFrame:
    """All projects with the one detail of a table of at most one row."""
    return projects.select("project").distinct().join(F.broadcast(detail.select("detail").limit(1)))


def by_settings(before: DataFrame, after: DataFrame, projects: DataFrame, resolved_before: DataFrame | None, resolved_after: DataFrame | None) -> DataFrame:
    """Of workspace settings before(document) and after(document), a row each: all projects if what every key holds differs, with the names; else, if
    targetDefaults or namedInputs do, the projects whose resolved(project, field, document) targets and inputs differ (none given: none do)."""
    names = lambda rows: rows.select(F.explode(F.map_entries(F.map_filter(entries("document"), lambda k, v: ~k.isin(*UNKEYED_SETTINGS) | k.isin("targetDefaults", "namedInputs", "cli")))).alias("e"))
    value = F.when(F.col("e.key") == "cli", F.to_json(F.try_variant_get("e.value", "$.packageManager", "variant"))).otherwise(F.to_json("e.value"))
    fields = lambda rows, name: names(rows).select(F.col("e.key").alias("key"), canonical(value).alias(name))
    both = fields(before, "old").join(fields(after, "new"), "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    resolving = F.col("key").isin("targetDefaults", "namedInputs")
    keyed = both.where(~resolving).agg(F.array_join(F.array_sort(F.collect_list("key")), ", ").alias("keys")).where("keys <> ''").select(F.concat(F.lit("changed "), "keys").alias("detail"))
    if resolved_before is None or resolved_after is None:
        return _every(projects, keyed)
    only = both.agg(F.bool_and(resolving).alias("only")).where("only").select("only")
    narrow = by_manifests(resolved_before, resolved_after).join(F.broadcast(only)).select("project", "detail")
    return _every(projects, keyed).unionByName(narrow)


def by_removed(base_projects: DataFrame, projects: DataFrame, base_edges: DataFrame, edges: DataFrame, deleted: DataFrame, compared: bool = True) -> DataFrame:
    """Projects of now that depended on one that base_projects(project, root) lost with a deleted(path) manifest of its, less what still holds a like edge; all if revisions weren't compared."""
    manifests = deleted.where(F.col("path").rlike(r"(^|/)(package|project)\.json$")).select("path", F.coalesce(F.nullif(F.regexp_replace("path", "(^|/)[^/]*$", ""), F.lit("")), F.lit(".")).alias("root"))
    if not compared:
        first = manifests.agg(F.min("path").alias("path")).where("path IS NOT NULL")
        return _every(projects, first.select(F.concat("path", F.lit(": not compared")).alias("detail")))
    gone = base_projects.join(manifests.select("root").distinct(), "root").join(projects.select("project"), "project", "left_anti").select(F.col("project").alias("target"))
    lost = base_edges.select("source", "target").join(gone, "target", "left_semi").join(edges.select("source", "target"), ["source", "target"], "left_anti")
    return lost.join(projects.select(F.col("project").alias("source")), "source", "left_semi").select(F.col("source").alias("project"), F.col("target").alias("detail")).distinct()


def by_lockfile(changes: DataFrame, importers: DataFrame, projects: DataFrame, mode: str | list[str] = "auto", changed: bool = True) -> DataFrame:
    """A changed lockfile touches: "auto" the projects of importers(importer, project) whose installs differ in changes(importer, key), a list the projects it names, otherwise all."""
    if not changed:
        return projects.select("project", F.lit("").alias("detail")).limit(0)
    if mode == "auto":
        return changes.select("importer", "key").join(importers, "importer").select("project", F.col("key").alias("detail")).distinct()
    if isinstance(mode, list):
        return projects.where(F.col("project").isin(*mode)).select("project", F.lit("listed").alias("detail")).distinct()
    return projects.select("project", F.lit("all").alias("detail")).distinct()


def by_workspace_inputs(inputs: DataFrame, changes: DataFrame) -> DataFrame:
    """Projects of inputs(project, pattern) that name files from the workspace's root, of which one changed: the first in order is the detail. A pattern without wildcards names a file or all below it."""
    from graphloom.operators.selection import glob_join, read_globs

    root = "{workspaceRoot}/"
    named = inputs.where(F.col("pattern").startswith(root))
    trimmed = F.regexp_replace(F.regexp_replace(F.expr(f"substring(pattern, {len(root) + 1})"), "/+", "/"), "(.)/$", "$1")
    globs = named.select("project", trimmed.alias("glob")).distinct()
    paths = changes.select("path").distinct()
    inside = paths.select("path", F.explode(ancestors("path")).alias("glob")).join(globs.select("glob").distinct(), "glob")
    found = glob_join(read_globs(globs), paths.select(F.col("path").alias("value"))).select("glob", F.col("value").alias("path")).unionByName(inside.select("glob", "path"))
    first = found.groupBy("glob").agg(F.min("path").alias("path"))
    return globs.join(first, "glob").select("project", F.col("path").alias("detail")).distinct()


def override_package(selector: str | Column) -> Column:
    """The package that an override's selector names: past a 'parent>' prefix, the last name or @scope/name, without its range."""
    inner = F.regexp_replace(selector, r"^.*[^ |@]>", "")
    return F.nullif(F.regexp_extract(inner, r"(?:^|/)((?:@[^/@>\s]+/)?[^/@>\s]+)(?:@[^/]*)?$", 1), F.lit(""))


def root_package_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """section, name, kind of declarations and overrides that differ between two root manifests (document), a row each."""
    sections = {"dependencies": "$.dependencies", "devDependencies": "$.devDependencies", "overrides": "$.overrides", "resolutions": "$.resolutions", "pnpm.overrides": "$.pnpm.overrides"}

    def listed(rows: DataFrame, name: str) -> DataFrame:
        each = [rows.select(F.lit(s).alias("section"), F.explode(F.from_json(F.get_json_object("document", path), "map<string,string>")).alias("name", name)) for s, path in sections.items()]
        out = each[0]
        for more in each[1:]:
            out = out.unionByName(more)
        return out

    both = listed(before, "old").join(listed(after, "new"), ["section", "name"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("section", "name", F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Deleted").otherwise("Modified").alias("kind"))


def by_root_package(changes: DataFrame, installed: DataFrame, projects: DataFrame, global_packages: list[str] = ("nx",)) -> DataFrame:
    """changes(section, name, kind) of the root manifest: the projects that install what changed, by installed(project, package); a removal, a global package, and
    an override of nothing installed touch all; a package's types touch the package; a workspace project declared there is touched itself."""
    declared = F.col("section").isin("dependencies", "devDependencies")
    rows = changes.withColumn("package", F.when(declared, F.col("name")).otherwise(override_package("name"))).withColumn("path", F.concat_ws(".", "section", "name"))
    known = installed.select("package").distinct()
    rows = rows.join(known.withColumn("known", F.lit(True)), "package", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    total = (
        F.when(declared & (F.col("kind") == "Deleted"), F.concat("path", F.lit(" is gone")))
        .when(F.col("known") & F.col("package").isin(*global_packages), F.concat("path", F.lit(" is used everywhere")))
        .when(~declared & ~F.col("known"), F.concat("path", F.lit(" overrides a package that no project installs itself")))
    )
    everything = rows.select("path", total.alias("detail")).where("detail IS NOT NULL").agg(F.min_by("detail", "path").alias("detail")).where("detail IS NOT NULL")
    named = rows.where("known").select("package", F.col("path").alias("detail"))
    typed = rows.where("known").where(F.col("package").startswith(TYPES)).select(F.expr(f"substring(package, {len(TYPES) + 1})").alias("package"), F.col("path").alias("detail"))
    by_install = installed.join(named.union(typed.join(known, "package", "left_semi")), "package").select("project", "detail")
    own = rows.where(declared & ~F.col("known")).select(F.col("package").alias("project"), F.col("path").alias("detail")).join(projects.select("project"), "project", "left_semi")
    narrow = by_install.union(own).distinct()
    none = everything.select(F.lit(1).alias("one"))
    return _every(projects, everything).unionByName(narrow.join(F.broadcast(none), how="left_anti"))


def by_tsconfig(before: DataFrame, after: DataFrame, roots: DataFrame) -> DataFrame:
    """Of root tsconfigs before(text) and after(text), a row each: all projects unless only paths and references differ; else owners of added and removed references, and
    projects that changed path mappings point into; a removed mapping touches all."""
    parts = before.select(tsconfig_parts("text").alias("b")).join(F.broadcast(after.select(tsconfig_parts("text").alias("a"))))
    total = parts.where(~F.col("a.rest").eqNullSafe(F.col("b.rest"))).select(F.lit("tsconfig").alias("detail"))
    listed = lambda side, name: parts.select(F.explode(f"{side}.paths").alias("mapping", "targets")).select("mapping", F.posexplode("targets").alias("place", name))
    moved = listed("b", "old").join(listed("a", "new"), ["mapping", "place"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    shorter = parts.select(F.explode("b.paths").alias("mapping", "targets"), "a.paths").where(F.size(F.col("targets")) > F.coalesce(F.size(F.col("paths")[F.col("mapping")]), F.lit(0)))
    kept_mapping = shorter.where(F.col("paths")[F.col("mapping")].isNotNull())
    everything = total.union(kept_mapping.select(F.concat(F.lit("removed from "), "mapping")).toDF("detail")).agg(F.max("detail").alias("detail")).where("detail IS NOT NULL")
    sides = parts.select(F.explode(F.concat(F.array_except("a.references", "b.references"), F.array_except("b.references", "a.references"))).alias("path")).where(~F.col("path").rlike(r"^\.\.(/|$)"))
    owned = owners(sides.distinct(), roots.select("root"))
    of_references = owned.join(roots, owned.owner == roots.root).select("project", F.concat(F.lit("reference:"), "path").alias("detail"))
    values = moved.select("mapping", F.explode(F.array_compact(F.array("old", "new"))).alias("path")).select("mapping", F.regexp_replace("path", r"^\./", "").alias("path"))
    trimmed = roots.select("project", F.regexp_replace("root", "/$", "").alias("under")).where("under <> ''")
    from graphloom.operators.tasks import with_self

    of_paths = values.withColumn("under", F.explode(with_self("path"))).join(trimmed, "under").select("project", F.concat_ws(":", F.lit("path"), "mapping", "path").alias("detail"))
    projects, none = roots.select("project"), everything.select(F.lit(1).alias("one"))
    return _every(projects, everything).unionByName(of_references.union(of_paths).distinct().join(F.broadcast(none), how="left_anti"))


#: The rules' names, in the order their reasons are listed.
ORDER = ("file", "project-configuration", "nx-json", "implicit", "removed", "lockfile", "root-package", "tsconfig")
#: Files that record installations; only the first can be read.
LOCKFILES = ("pnpm-lock.yaml", "package-lock.json", "yarn.lock", "bun.lock", "bun.lockb", "npm-shrinkwrap.json")


def touched(found: dict[str, DataFrame]) -> DataFrame:
    """project, reasons of the rules' (project, detail), in ORDER."""
    return reasons([(name, found[name]) for name in ORDER if name in found])


def task_reasons(inputs: DataFrame, changes: DataFrame, reconfigured: DataFrame, packages: DataFrame, moved: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """task, reason, detail: changes(path) of inputs(task, path, field), where a whole file counts before fields of it and changes(path, field) tell which fields differ;
    changes below a link's target (links(path, target)) for those who read the link; reconfigured(task, change); packages(task, package) that moved(package)."""
    direct = inputs.join(changes.select("path", F.col("field").alias("differs")).distinct(), "path").where("field IS NULL OR differs IS NULL OR field = differs OR startswith(differs, field || '.')")
    files = direct.groupBy("task", "path").agg(F.bool_or(F.col("field").isNull()).alias("whole"))
    out = files.select("task", F.when(F.col("whole"), "input").otherwise("json-input").alias("reason"), F.col("path").alias("detail"))
    if links is not None:
        from graphloom.operators.tasks import with_self

        hit = changes.select("path").distinct().withColumn("target", F.explode(with_self("path"))).join(links.select(F.col("path").alias("link"), "target"), "target").select("link", "path")
        through = inputs.select("task", F.col("path").alias("link")).distinct().join(hit, "link").select("task", F.lit("link").alias("reason"), F.col("path").alias("detail"))
        out = out.union(through)
    config = reconfigured.select("task", F.lit("configuration").alias("reason"), F.col("change").alias("detail"))
    installs = packages.join(moved.select("package").distinct(), "package").select("task", F.lit("package").alias("reason"), F.col("package").alias("detail"))
    return out.union(config).union(installs).distinct()


def granularity(explicit: str | None, environment: str | None, legacy: object, projections: bool) -> tuple[str, str]:
    """(projects or tasks, why): what is asked for; else the environment's true or false; else the workspace's legacy setting if it counts as true; else tasks, unless projections select projects."""
    if explicit is not None:
        return explicit, "asked for"
    truthy = legacy not in (None, False, 0, "") and legacy == legacy
    found = {"true": ("projects", "environment"), "false": ("tasks", "environment")}.get(environment) or (("projects", "settings") if truthy else ("tasks", "default"))
    return ("projects", "projections") if projections and found[0] == "tasks" else found
