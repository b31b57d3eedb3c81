"""Reviews of what tasks access: full categories, audit findings and their roll-up, suggestions, and the doctor's list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import base_name, is_dotenv, read_kind
from graphloom.operators.accesses import with_written_before
from graphloom.operators.accesses import pattern_sets
from graphloom.operators.tasks import with_self

#: Accesses that read, and flags of an event (see access_categories).
WRITES, LISTS = ("write",), ("list",)
AUDIT_KINDS = (
    "stray-write", "unkeyed-package", "hoisted-package", "unkeyed-read", "dotenv-read", "undeclared-read", "dependency-read", "manifest-read", "toolchain-read", "tsconfig-read",
)
_SPECIAL = r"[*?\[\]{}!()\\+@|,]"


def in_modules(path: str | Column) -> Column:
    return F.array_contains(F.split(path, "/"), "node_modules")


def in_git(path: str | Column) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return (path == ".git") | path.startswith(".git/")


def _held(rows: DataFrame, marks: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """rows with a flag: whether their keys, by path or a folder above it, stand in marks."""
    if "path" not in keys:
        return rows.join(marks.select(keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    others = [k for k in keys if k != "path"]
    paths = rows.select(*keys).distinct()
    hit = paths.withColumn("at", F.explode(with_self("path"))).join(marks.select(*others, F.col("path").alias("at")).distinct(), [*others, "at"], "left_semi").select(*keys).distinct()
    return rows.join(hit.withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def access_categories(accesses: DataFrame, outputs: DataFrame, warm: DataFrame, produced: DataFrame, structured: DataFrame, declared: DataFrame, resolution: DataFrame, covered: DataFrame) -> DataFrame:
    """seq, task, path, category of accesses(seq, task, path, operation, folder, package): of twelve, in order, the first that holds.

    A null path is outside the workspace; package is that of a path in node_modules and known by covered(task, package) or not.
    outputs, warm, produced(task, path) hold paths and all below; structured, declared(task, path) and resolution(path) name files.
    """
    rows = with_written_before(accesses)
    for marks, name in ((outputs, "is_output"), (warm, "is_warm"), (produced, "is_produced")):
        rows = _held(rows, marks, name, ["task", "path"])
    exact = lambda rows, marks, name, keys: rows.join(marks.select(keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    rows = exact(exact(exact(rows, structured, "is_structured", ["task", "path"]), declared, "is_declared", ["task", "path"]), resolution, "is_resolution", ["path"])
    rows = exact(rows, covered, "is_covered", ["task", "package"])
    writes, missing = F.col("operation") == "write", F.col("operation") == "missing"
    category = (
        F.when(F.col("path").isNull(), "external")
        .when(in_modules("path") & F.col("package").isNotNull() & ~F.col("is_covered") & (F.col("operation") == "read"), "unkeyed-package")
        .when(in_modules("path"), "installed-package")
        .when(in_git("path"), "git-state")
        .when(F.col("is_output"), "own-output")
        .when(F.col("is_warm"), "warm-state")
        .when(F.col("is_produced"), "dependency-output")
        .when((F.col("operation") == "list") | missing | (~writes & F.col("folder")), "discovery")
        .when(F.col("is_structured"), "structured-input")
        .when(F.col("is_declared"), "input")
        .when(F.col("own") & ~writes, "generated")
        .when(F.col("is_resolution"), "resolution-metadata")
        .otherwise("uncovered")
    )
    return rows.select("seq", "task", "path", category.alias("category"))


def audit(reports: DataFrame, ignored: DataFrame, covered: DataFrame, loaded: DataFrame, depended: DataFrame, outputs: DataFrame, naming: DataFrame) -> DataFrame:
    """task, kind, detail (a path, or a package), project of reports(task, path, writes, folder, package): ten kinds of findings.

    Left out: reads of ignored(task, path), of covered(task, package) ones and of anything else in node_modules, and the making of a folder that outputs(task, path)
    lie in. loaded(task, path) are dotenv files the task names; depended(task, root, project) the projects it depends on; naming(task) those that name their
    external packages. What a task writes outside its outputs cancels its reads of the same path.
    """
    flag = lambda rows, marks, name, keys: rows.join(marks.select(keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    rows = flag(flag(flag(flag(reports, ignored, "skip", ["task", "path"]), covered, "covered", ["task", "package"]), loaded, "named", ["task", "path"]), naming, "naming", ["task"])
    from graphloom.functions.paths import ancestors

    holding = outputs.select("task", F.explode(ancestors("path")).alias("path"))
    rows = flag(rows, holding, "holds_output", ["task", "path"])
    owner = rows.select("task", "path").distinct().withColumn("root", F.explode(ancestors("path"))).join(depended, ["task", "root"]).groupBy("task", "path").agg(F.max_by("project", F.length("root")).alias("project"))
    rows = rows.join(owner, ["task", "path"], "left")
    reads = ~F.col("writes")
    package = F.when(reads & ~F.col("covered"), F.col("package"))
    dropped = (reads & F.col("skip")) | (package.isNull() & in_modules("path")) | (F.col("writes") & F.col("folder") & F.col("holds_output"))
    kind = (
        F.when(package.isNotNull() & F.col("naming"), "unkeyed-package").when(package.isNotNull(), "hoisted-package")
        .when(F.col("writes"), "stray-write").when(in_git("path"), "unkeyed-read").when(F.col("named"), "dotenv-read").when(is_dotenv("path"), "undeclared-read")
        .when(F.col("project").isNotNull() & (read_kind("path") == "content"), "dependency-read")
        .when(read_kind("path") == "content", "undeclared-read").otherwise(F.concat(read_kind("path"), F.lit("-read")))
    )
    found = rows.where(~dropped).select("task", kind.alias("kind"), F.when(package.isNotNull(), package).otherwise(F.col("path")).alias("detail"), F.when(kind == "dependency-read", F.col("project")).alias("project")).distinct()
    cancelled = found.where("kind = 'stray-write'").select("task", "detail")
    stays = F.col("kind").isin("stray-write", "unkeyed-package", "hoisted-package", "unkeyed-read")
    return found.where(stays).unionByName(found.where(~stays).join(cancelled, ["task", "detail"], "left_anti"))


def beyond():
    """Whether a row of findings is more than what is let pass: reads of .git and of installed packages left out of the key, and writes in .git."""
    return ~F.col("kind").isin("unkeyed-read", "unkeyed-package", "hoisted-package") & ~((F.col("kind") == "stray-write") & in_git("detail"))


def audit_summary(findings: DataFrame) -> DataFrame:
    """kind, detail, tasks: how many tasks have each finding of findings(task, kind, detail); undeclared reads and packages that many share (three tasks at
    least, and a quarter of those that went beyond) stand once, under "shared", the others by kind alone (detail null), counted as findings."""
    tasks = findings.agg(F.countDistinct(F.when(beyond(), F.col("task"))).alias("all"))
    counted = findings.groupBy("kind", "detail").agg(F.countDistinct("task").alias("tasks")).join(F.broadcast(tasks))
    may = F.col("kind").isin("unkeyed-package", "hoisted-package") | ((F.col("kind") == "undeclared-read") & ~is_dotenv("detail"))
    shared = may & (F.col("tasks") >= 3) & (F.col("tasks") * 4 >= F.col("all"))
    marked = counted.withColumn("shared", shared)
    alone = marked.where("NOT shared").groupBy("kind").agg(F.sum("tasks").alias("tasks")).select("kind", F.lit(None).cast("string").alias("detail"), "tasks")
    return marked.where("shared").select(F.concat(F.lit("shared "), "kind").alias("kind"), "detail", "tasks").unionByName(alone)


def review_groups(uncovered: DataFrame) -> DataFrame:
    """group, path of uncovered(path, operation, missing) accesses: metadata checks where nothing but metadata of it is read, else by the kind of file."""
    read = uncovered.groupBy("path").agg(F.bool_or(~F.col("operation").isin("write", "metadata") & ~F.col("missing")).alias("read"))
    return read.select(F.when(~F.col("read"), "metadata-checks").otherwise(F.concat(read_kind("path"), F.lit("-reads"))).alias("group"), "path")


def candidate_filesets(observed: DataFrame, declared: DataFrame, mandatory: DataFrame) -> DataFrame:
    """fileset of the observed(path) files that are declared(path), not mandatory(path), and can be written as they are."""
    rows = observed.select("path").distinct().join(declared.select("path"), "path", "left_semi").join(mandatory.select("path"), "path", "left_anti")
    return rows.where(~F.col("path").rlike(_SPECIAL)).select(F.concat(F.lit("{workspaceRoot}/"), "path").alias("fileset"))


def suggested_filesets(observed: DataFrame, declared: DataFrame, listed: DataFrame) -> DataFrame:
    """pattern, observed_files, more_files: filesets instead of a broad one, of paths below a project: observed(path), declared(path), listed(path) folders.

    A folder with observed files becomes all its declared extensions, or everything where it was listed or holds files without one;
    two or more observed files of an extension at the top become that extension, another one stands as it is.
    """
    extension = lambda c: F.nullif(F.regexp_extract(base_name(c), r"[^.].*?\.([^.]+)$", 1), F.lit(""))
    top = lambda c: F.when(F.col(c).contains("/"), F.substring_index(c, "/", 1))
    seen = observed.select("path").distinct().join(declared.select("path"), "path", "left_semi")
    all_files = declared.select("path").distinct().withColumn("folder", top("path")).withColumn("ext", extension("path"))
    swept = listed.select(F.substring_index("path", "/", 1).alias("folder")).where("folder NOT IN ('', '.')").distinct().join(all_files.select("folder"), "folder", "left_semi")
    folders = seen.select(top("path").alias("folder")).where("folder IS NOT NULL").union(swept).distinct()
    kinds = all_files.join(folders, "folder").groupBy("folder").agg(F.array_sort(F.collect_set("ext")).alias("exts"), F.bool_or(F.col("ext").isNull()).alias("bare"))
    kinds = kinds.join(swept.withColumn("swept", F.lit(True)), "folder", "left")
    whole = F.coalesce("swept", F.lit(False)) | F.col("bare")
    one = F.when(F.size("exts") == 1, F.get("exts", F.lit(0))).otherwise(F.concat(F.lit("{"), F.array_join("exts", ","), F.lit("}")))
    of_folders = kinds.select(F.concat("folder", F.when(whole, "/**/*").otherwise(F.concat(F.lit("/**/*."), one))).alias("pattern"), "folder", F.when(~whole, F.col("exts")).alias("exts"), F.lit(None).cast("string").alias("ext"), F.lit(None).cast("string").alias("file"))
    roots = seen.where(top("path").isNull()).select("path", extension("path").alias("ext"))
    several = roots.where("ext IS NOT NULL").groupBy("ext").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    none = F.lit(None).cast("array<string>")
    tops = several.select(F.when(F.col("n") >= 2, F.concat(F.lit("*."), "ext")).otherwise(F.col("path")).alias("pattern"), F.lit(None).cast("string").alias("folder"), none.alias("exts"), F.when(F.col("n") >= 2, F.col("ext")).alias("ext"), F.when(F.col("n") < 2, F.col("path")).alias("file"))
    plain = roots.where("ext IS NULL").select(F.col("path").alias("pattern"), F.lit(None).cast("string").alias("folder"), none.alias("exts"), F.lit(None).cast("string").alias("ext"), F.col("path").alias("file"))
    patterns = of_folders.unionByName(tops).unionByName(plain)
    files = all_files.join(seen.withColumn("seen", F.lit(True)), "path", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    in_folder = patterns.where("folder IS NOT NULL").select("pattern", "folder", F.col("exts").alias("wanted")).join(files, "folder").where(F.col("wanted").isNull() | F.array_contains("wanted", F.col("ext")))
    by_ext = patterns.where("ext IS NOT NULL").select("pattern", F.col("ext").alias("wanted")).join(files.where("folder IS NULL"), F.col("wanted") == F.col("ext"))
    by_file = patterns.where("file IS NOT NULL").select("pattern", F.col("file").alias("path")).join(files, "path")
    hits = in_folder.select("pattern", "seen").union(by_ext.select("pattern", "seen")).union(by_file.select("pattern", "seen"))
    counts = hits.groupBy("pattern").agg(F.count_if("seen").alias("observed_files"), F.count_if(~F.col("seen")).alias("more_files"))
    return patterns.select("pattern").distinct().join(counts, "pattern", "left").select("pattern", F.coalesce("observed_files", F.lit(0)).alias("observed_files"), F.coalesce("more_files", F.lit(0)).alias("more_files"))


def doctor(settings: DataFrame, targets: DataFrame, executors: list[str], known_fields: dict[str, list[str]], globs: DataFrame | None = None) -> DataFrame:
    """level, code, location, detail: plugins and generators that nothing runs (settings(document)), executors other than the known, unknown fields of
    known_fields (a setting's name to its fields) in targets(project, target, executor, definition), and globs(target, task, pattern, selects) that select nothing."""
    from graphloom.functions.documents import entries

    value = lambda path: F.try_variant_get(F.try_parse_json("document"), path, "array<variant>")
    warn = lambda rows, path, code: rows.where(F.size(value(path)) > 0).select(F.lit("warning").alias("level"), F.lit(code).alias("code"), F.lit(path[2:]).alias("location"), F.lit(None).cast("string").alias("detail"))
    out = warn(settings, "$.plugins", "plugins-not-run").unionByName(warn(settings, "$.sync.globalGenerators", "sync-generators-not-run"))
    place = F.concat_ws(":", "project", "target")
    other = targets.where(F.col("executor").isNotNull() & ~F.col("executor").isin(*executors))
    out = out.unionByName(other.select(F.lit("error").alias("level"), F.lit("unsupported-executor").alias("code"), place.alias("location"), F.col("executor").alias("detail")))
    for setting, fields in known_fields.items():
        names = F.explode(F.map_keys(entries(F.to_json(entries("definition")[setting]))))
        rows = targets.select("project", "target", names.alias("field")).where(~F.col("field").isin(*fields))
        out = out.unionByName(rows.select(F.lit("warning").alias("level"), F.lit("unknown-field").alias("code"), place.alias("location"), F.concat_ws(".", F.lit(setting), "field").alias("detail")))
    if globs is not None:
        sets = pattern_sets(globs)
        out = out.unionByName(sets.select(F.lit("warning").alias("level"), F.lit("dependency-outputs-unmatched").alias("code"), F.col("patterns").alias("location"), F.col("targets").alias("detail")))
    return out
