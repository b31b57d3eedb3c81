"""A workspace as tables: files(path, text) become manifests, projects, targets, packages and their dependencies.

Every function takes and gives DataFrames, so that a reader of another revision is the same functions over
other files (at_revision). Texts that can't be parsed are left out of what is parsed, and listed by unreadable().
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.documents import canonical, uncommented, without_fields
from graphloom.functions.globs import matches, to_regex
from graphloom.functions.layers import resolved_text, staged_text
from graphloom.functions.names import base_name, directory
from graphloom.functions.paths import ancestors
from graphloom.operators import selection
from graphloom.session import checkpointed

SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
#: Files of ignore rules, and directories that are never sources.
IGNORE_FILES, NEVER = (".gitignore", ".nxignore"), (".git", "node_modules")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and text of every file of a directory tree on storage that all executors see."""
    base = root.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    return rows.select(F.regexp_replace("path", f"^.*\\Q{base}\\E", "").alias("path"), F.decode("content", "UTF-8").alias("text"))


def at_revision(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files as they were before changes(path, before, after): changed ones with their earlier text, added ones gone, deleted ones back."""
    kept = files.select("path", "text").join(changes.select("path").distinct(), "path", "left_anti")
    return kept.unionByName(changes.where("before IS NOT NULL").select("path", F.col("before").alias("text")))


def ignore_rules(files: DataFrame) -> DataFrame:
    """base, place, negated, folder, pattern (a regular expression below base): the rules of the ignore files, in order."""
    lines = files.where(base_name("path").isin(*IGNORE_FILES)).select(
        directory("path").alias("base"), (F.array_position(F.array(*map(F.lit, IGNORE_FILES)), base_name("path"))).alias("file"), F.posexplode(F.split("text", "\r?\n")).alias("line", "rule")
    )
    rule = F.regexp_replace("rule", r"(?<!\\)\s+$", "")
    rules = lines.withColumn("rule", rule).where("rule <> '' AND NOT rule LIKE '#%'")
    bare = F.regexp_replace("rule", "^!", "")
    inner = F.regexp_replace(bare, "/$", "")
    placed = F.when(inner.contains("/"), F.regexp_replace(inner, "^/", "")).otherwise(F.concat(F.lit("**/"), inner))

    @F.pandas_udf("string")
    def regex(globs: pd.Series) -> pd.Series:
        return globs.map(to_regex)

    return rules.select("base", (F.col("file") * 1_000_000 + F.col("line")).alias("place"), F.col("rule").startswith("!").alias("negated"), bare.endswith("/").alias("folder"), regex(placed).alias("pattern"))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path of those of paths(path) that the rules ignore, themselves or a directory above: of a directory's rules the deepest and last that matches decides."""
    whole = paths.select("path").distinct()
    above = whole.select(F.explode(ancestors("path")).alias("entry")).distinct().withColumn("is_folder", F.lit(True))
    entries = above.union(whole.select(F.col("path").alias("entry"), F.lit(False)))
    based = entries.withColumn("base", F.explode(F.concat(F.array(F.lit(".")), ancestors("entry"))))
    below = F.when(F.col("base") == ".", F.col("entry")).otherwise(F.expr("substring(entry, length(base) + 2)"))
    hits = based.join(rules, "base").where(F.rlike(below, F.col("pattern")) & (F.col("is_folder") | ~F.col("folder")))
    depth = F.when(F.col("base") == ".", 0).otherwise(F.size(F.split("base", "/")))
    last = hits.groupBy("entry").agg(F.max_by("negated", F.struct(depth.alias("depth"), "place")).alias("negated"))
    out = last.where("NOT negated").select("entry")
    return whole.withColumn("entry", F.explode(F.concat(ancestors("path"), F.array("path")))).join(out, "entry").select("path").distinct()


def without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files that are sources: in no directory of NEVER, not ignored."""
    sources = files.where(~F.exists(F.split("path", "/"), lambda x: x.isin(*NEVER)))
    return sources.join(ignored(sources, rules), "path", "left_anti")


def json_files(files: DataFrame, name: str) -> DataFrame:
    """root, path, document (canonical JSON) of the files of one name that hold a JSON object, comments allowed."""
    parsed = files.where(base_name("path") == name).select(directory("path").alias("root"), "path", canonical_or_null(uncommented("text")).alias("document"))
    return parsed.where(F.col("document").startswith("{"))


def canonical_or_null(text: str | Column) -> Column:
    return F.to_json(F.try_parse_json(text))


def unreadable(files: DataFrame, names: tuple[str, ...] = ("package.json", "project.json", "nx.json")) -> DataFrame:
    """path of manifests that are no JSON object."""
    document = canonical_or_null(uncommented("text"))
    return files.where(base_name("path").isin(*names)).where(~F.coalesce(document.startswith("{"), F.lit(False))).select("path")


def workspace_globs(files: DataFrame) -> list[str]:
    """The globs of the root manifest's workspaces and of pnpm-workspace.yaml's packages; without any, every directory."""
    asked = files.where(F.col("path").isin("package.json", "pnpm-workspace.yaml")).select("path", F.when(F.col("path") == "package.json", uncommented("text")).otherwise(F.col("text")).alias("t"))
    texts = {r.path: r.t for r in asked.collect()}  # two files at most
    root, listed = texts.get("package.json"), texts.get("pnpm-workspace.yaml")
    out: list[str] = []
    if root is not None:
        import json

        found = json.loads(root or "{}").get("workspaces", [])
        out += found.get("packages", []) if isinstance(found, dict) else found
    if listed is not None:
        import yaml

        out += (yaml.safe_load(listed) or {}).get("packages") or []
    return out or ["**"]


def project_directories(files: DataFrame, globs: list[str]) -> DataFrame:
    """root of directories with a project.json, or with a package.json that the workspace's globs select ('!' takes away)."""
    folders = files.where(base_name("path").isin("package.json", "project.json")).select(directory("path").alias("root"), (base_name("path") == "project.json").alias("own"))
    trim = lambda g: g.lstrip("!").removeprefix("./").rstrip("/")
    any_of = lambda wanted: F.greatest(F.lit(False), F.lit(False), *(matches("root", trim(g)) for g in wanted))
    chosen = any_of([g for g in globs if not g.startswith("!")]) & ~any_of([g for g in globs if g.startswith("!")])
    return folders.where(F.col("own") | (F.col("root") == ".") | chosen).select("root").distinct()


def packages(files: DataFrame) -> DataFrame:
    """root, path, name, version, has_entry_point of every package manifest."""
    manifest = F.parse_json("document")
    text = lambda field: F.try_variant_get(manifest, f"$.{field}", "string")
    held = lambda field: ~F.coalesce(F.is_variant_null(F.try_variant_get(manifest, f"$.{field}", "variant")), F.lit(True))
    entry = held("exports") | held("main") | held("module") | held("bin")
    return json_files(files, "package.json").select("root", "path", text("name").alias("name"), text("version").alias("version"), F.coalesce(entry, F.lit(False)).alias("has_entry_point"))


def package_deps(files: DataFrame) -> DataFrame:
    """root, section, name, range of what package manifests declare."""
    rows = json_files(files, "package.json")
    found = [rows.select("root", F.lit(s).alias("section"), F.explode(F.from_json(F.get_json_object("document", f"$.{s}"), "map<string,string>")).alias("name", "range")) for s in SECTIONS]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def projects(files: DataFrame, globs: list[str] | None = None) -> DataFrame:
    """name, root, project_type, tags, implicit_dependencies, document: project.local.json over project.json over package.json, named by the first that names it, else by its directory.

    Tags and implicit dependencies of the layers add up; other fields of document are the highest layer's. Targets are what targets() resolves.
    """
    roots = project_directories(files, workspace_globs(files) if globs is None else globs)
    own = json_files(files, "project.json").select("root", F.col("document").alias("own"))
    package = json_files(files, "package.json").select("root", F.col("document").alias("package"))
    local = json_files(files, "project.local.json").select("root", F.col("document").alias("local"))
    rows = roots.join(own, "root", "left").join(package, "root", "left").join(local, "root", "left").where("own IS NOT NULL OR (package IS NOT NULL AND root <> '.')")
    field = lambda c, path, kind: F.try_variant_get(F.parse_json(c), path, kind)
    name = F.coalesce(field("own", "$.name", "string"), field("package", "$.nx.name", "string"), field("package", "$.name", "string"), base_name("root"))
    none = F.array().cast("array<string>")
    parts = lambda key: F.concat(*(F.coalesce(field(c, path, "array<string>"), none) for c, path in (("package", f"$.nx.{key}"), ("own", f"$.{key}"), ("local", f"$.{key}"))))
    kind = F.coalesce(field("local", "$.projectType", "string"), field("own", "$.projectType", "string"), field("package", "$.nx.projectType", "string"))
    layers = F.array(*(F.from_json(x, "map<string,variant>") for x in (F.get_json_object("package", "$.nx"), F.col("own"), F.col("local"))))
    document = F.aggregate(F.array_compact(layers), F.create_map().cast("map<string,variant>"), lambda below, new: F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(new, k)), new))
    return rows.select(name.alias("name"), "root", kind.alias("project_type"), F.array_distinct(parts("tags")).alias("tags"), F.array_distinct(parts("implicitDependencies")).alias("implicit_dependencies"), canonical(F.to_json(document)).alias("document"))


def duplicates(found: DataFrame) -> DataFrame:
    """kind, value, n: names and roots that more than one project has."""
    of = lambda c: found.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(c).alias("kind"), "value", "n")
    return of("name").unionByName(of("root"))


def load(files: DataFrame) -> DataFrame:
    """The projects of a workspace; ValueError, which shows the first ten, if some share a name or a root."""
    found = checkpointed(projects(files))
    twice = duplicates(found).orderBy("kind", "value").limit(10).collect()
    if twice:
        raise ValueError("; ".join(f"{r.n} projects with the {r.kind} {r.value}" for r in twice))
    return found


def project_at(files: DataFrame, root: str) -> DataFrame:
    """The one project that the manifests of a directory make, such as of a project deleted since."""
    here = files.where(directory("path") == root)
    return projects(here, globs=["**"]).where(F.col("root") == root)


def _objects(files: DataFrame, name: str) -> DataFrame:
    """root, document of the files of one name that hold a JSON object, as written but for comments: the order of keys is kept."""
    parsed = F.schema_of_variant(F.try_parse_json(uncommented("text"))).startswith("OBJECT")
    return files.where(base_name("path") == name).where(parsed).select(directory("path").alias("root"), uncommented("text").alias("document"))


def _fields(document: str | Column, path: str) -> Column:
    """The fields of an object within a document as a map of JSON texts in order; values that are strings lose their quotes."""
    return F.from_json(F.get_json_object(document, path), "map<string,string>")


def target_layers(files: DataFrame, found: DataFrame) -> DataFrame:
    """project, target, layer, definition (JSON that keeps its order): the layers that make targets, lowest first: a package's scripts (0) and
    its own targets (1), project.json (2) and project.local.json (3).

    A script is left out if project.json runs its target otherwise, or if the package's own target says how it runs.
    """
    of = found.select(F.col("name").alias("project"), "root")
    each = lambda name, path, layer: of.join(_objects(files, name), "root").select("project", F.explode(_fields("document", path)).alias("target", "definition"), F.lit(layer).alias("layer"))
    package, own, local = each("package.json", "$.nx.targets", 1), each("project.json", "$.targets", 2), each("project.local.json", "$.targets", 3)
    read = lambda path: F.get_json_object("definition", path)
    executor = F.coalesce(read("$.executor"), F.lit(""))
    runs_it = (executor == "nx:run-script") & F.coalesce(read("$.options.script") == F.col("target"), F.lit(False))
    otherwise = own.where((F.coalesce(read("$.command"), F.lit("")) != "") | ((executor != "") & ~runs_it)).union(package.where((F.coalesce(read("$.command"), F.lit("")) != "") | (executor != "")))
    manifests = of.join(_objects(files, "package.json"), "root")
    included = F.from_json(F.get_json_object("document", "$.nx.includedScripts"), "array<string>")
    scripts = manifests.select("project", F.explode(F.coalesce(included, F.map_keys(_fields("document", "$.scripts")))).alias("target"))
    script = F.to_json(F.struct(F.lit("nx:run-script").alias("executor"), F.struct(F.col("target").alias("script")).alias("options")))
    scripts = scripts.distinct().join(otherwise.select("project", "target"), ["project", "target"], "left_anti").select("project", "target", script.alias("definition"), F.lit(0).alias("layer"))
    return scripts.unionByName(package).unionByName(own).unionByName(local).select("project", "target", "layer", "definition")


def target_defaults(files: DataFrame) -> DataFrame:
    """key, place, definition, executor, projects of the entries of nx.json's targetDefaults; the last two are what a filter asks for. Entries that ask for a plugin are left out."""
    settings = files.where(F.col("path") == "nx.json").select(uncommented("text").alias("document"))
    keys = settings.select(F.explode(_fields("document", "$.targetDefaults")).alias("key", "value"))
    listed = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    rows = keys.select("key", F.posexplode(listed).alias("place", "definition"))
    asked = lambda name: F.nullif(F.get_json_object("definition", f"$.filter.{name}"), F.lit(""))
    one = asked("projects")
    projects = F.when(one.startswith("["), F.from_json(one, "array<string>")).when(one.isNotNull(), F.array(one))
    return rows.where(asked("plugin").isNull()).select("key", "place", "definition", asked("executor").alias("executor"), projects.alias("projects"))


def targets(files: DataFrame, found: DataFrame) -> DataFrame:
    """project, target, definition: targets as their layers make them over the target defaults that apply.

    Defaults are held against the target's executor, its name, then globs, the longest first; the first key with an entry whose filter
    takes the target in gives all such entries. The defaults are one file's, so they are broadcast.
    """
    found = checkpointed(found.select("name", "root", "tags"))
    grouped = target_layers(files, found).groupBy("project", "target").agg(F.array_sort(F.collect_list(F.struct("layer", "definition")))["definition"].alias("layers"))
    staged = checkpointed(grouped.withColumn("executor", F.get_json_object(staged_text(F.col("layers")), "$.executor")))
    entries = target_defaults(files).withColumnsRenamed({"executor": "asked"})
    entries = checkpointed(entries.withColumn("entry", F.concat_ws("#", "key", "place")).coalesce(1))
    filtered = entries.where("projects IS NOT NULL").select(F.col("entry").alias("owner"), F.posexplode("projects").alias("turn", "pattern"))
    taken = selection.matching(filtered, found.select("name", "root", "tags")).select(F.col("owner").alias("entry"), F.col("name").alias("project"), F.lit(True).alias("takes"))

    @F.pandas_udf("string")
    def regex(keys: pd.Series) -> pd.Series:
        return keys.map(lambda key: to_regex(key, dot=False) if selection.is_glob(key) else None)

    entries = entries.withColumn("regex", regex("key"))
    rank = F.when(F.col("executor") == F.col("key"), 0).when(F.col("target") == F.col("key"), 1).when(F.rlike(F.col("target"), F.col("regex")), 2)
    met = staged.select("project", "target", "executor").join(F.broadcast(entries), (F.col("executor") == F.col("key")) | (F.col("target") == F.col("key")) | F.coalesce(F.rlike(F.col("target"), F.col("regex")), F.lit(False)))
    met = met.where("asked IS NULL OR asked = executor").withColumn("rank", rank).join(taken, ["entry", "project"], "left").where("projects IS NULL OR takes")
    best = F.min(F.struct("rank", F.when(F.col("rank") == 2, -F.length("key")).otherwise(0).alias("length"), "key")).over(Window.partitionBy("project", "target"))
    chosen = met.withColumn("best", best["key"]).where("key = best").groupBy("project", "target").agg(F.array_sort(F.collect_list(F.struct("place", "definition")))["definition"].alias("defaults"))
    rows = staged.join(chosen, ["project", "target"], "left")
    return rows.select("project", "target", resolved_text(F.col("layers"), F.col("defaults")).alias("definition"))


def named_inputs(files: DataFrame, found: DataFrame) -> DataFrame:
    """project, name, inputs (JSON): named inputs of the workspace and of projects, the project's own over the workspace's."""
    settings = files.where(F.col("path") == "nx.json").select(F.explode(_fields(uncommented("text"), "$.namedInputs")).alias("name", "inputs"))
    of = found.select(F.col("name").alias("project"), "root")
    each = lambda name, path, layer: of.join(_objects(files, name), "root").select("project", F.explode(_fields("document", path)).alias("name", "inputs"), F.lit(layer).alias("layer"))
    shared = of.select("project").join(F.broadcast(settings)).select("project", "name", "inputs", F.lit(0).alias("layer"))
    rows = shared.unionByName(each("package.json", "$.nx.namedInputs", 1)).unionByName(each("project.json", "$.namedInputs", 2)).unionByName(each("project.local.json", "$.namedInputs", 3))
    return rows.groupBy("project", "name").agg(F.max_by("inputs", "layer").alias("inputs"))


def resolved_fields(files: DataFrame, found: DataFrame) -> DataFrame:
    """project, field, document (canonical JSON): what a project's configuration comes to, a row for each target and named input and one for the rest."""
    kinds = [
        targets(files, found).select("project", F.concat(F.lit("targets."), "target").alias("field"), canonical("definition").alias("document")),
        named_inputs(files, found).select("project", F.concat(F.lit("namedInputs."), "name").alias("field"), canonical("inputs").alias("document")),
        found.select(F.col("name").alias("project"), F.lit("configuration").alias("field"), without_fields("document", ["targets", "namedInputs"]).alias("document")),
    ]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def target_inputs(files: DataFrame, found: DataFrame) -> DataFrame:
    """project, target, pattern: the filesets that targets name as inputs, directly or by named inputs; a target without inputs has its project's files."""
    declared = targets(files, found).select("project", "target", F.get_json_object("definition", "$.inputs").alias("inputs"))
    listed = lambda c: F.from_json(c, "array<string>")
    open_ = declared.select("project", "target", F.explode(F.coalesce(listed("inputs"), F.array(F.lit("{projectRoot}/**/*")))).alias("input"))
    named = named_inputs(files, found).select("project", F.col("name").alias("input"), listed("inputs").alias("inner"))
    done = []
    for _ in range(32):  # named inputs may name others; a ring of them ends here
        joined = checkpointed(open_.join(named, ["project", "input"], "left"))
        done.append(joined.where("inner IS NULL").select("project", "target", "input"))
        open_ = joined.where("inner IS NOT NULL").select("project", "target", F.explode("inner").alias("input")).distinct()
        if not open_.limit(1).count():
            break
    rows = reduce(DataFrame.unionByName, done)
    pattern = F.when(F.col("input").startswith("{"), F.coalesce(F.get_json_object("input", "$.fileset"), F.when(F.regexp_like("input", F.lit(r"^\{(projectRoot|workspaceRoot)\}")), F.col("input")))).otherwise(F.col("input"))
    return rows.select("project", "target", pattern.alias("pattern")).where(F.col("pattern").rlike(r"^!?\{(projectRoot|workspaceRoot)\}/")).distinct()
