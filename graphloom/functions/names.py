"""Paths, references, file kinds and shares of cores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files that choose tools, by their path in the workspace.
TOOLCHAIN = (".tool-versions", "mise.toml", ".nvmrc", ".node-version", ".npmrc", ".pnpmfile.cjs", "rust-toolchain", "rust-toolchain.toml")
NO_STRINGS = "array<string>"


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_name(path: str | Column) -> Column:
    return F.substring_index(_column(path), "/", -1)


def directory(path: str | Column) -> Column:
    """What holds a path, '.' at the top."""
    return F.coalesce(F.nullif(F.regexp_replace(_column(path), "(^|/)[^/]*$", ""), F.lit("")), F.lit("."))


def posix_join(base: str | Column, path: str | Column) -> Column:
    """Segments of both, '.' and '..' resolved, '..' kept where nothing is left to leave, a trailing slash kept; '.' if nothing is left."""
    base, path = _column(base), _column(path)
    parts = F.filter(F.split(F.concat_ws("/", base, path), "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast(NO_STRINGS).alias("kept"), F.lit(0).alias("up"))

    def step(state: Column, part: Column) -> Column:
        size = F.size(state["kept"])
        left = F.when((part == "..") & (size > 0), F.slice(state["kept"], 1, F.greatest(size - 1, F.lit(0)))).when(part == "..", state["kept"])
        kept = left.otherwise(F.concat(state["kept"], F.array(part)))
        return F.struct(kept.alias("kept"), (state["up"] + F.when((part == "..") & (size == 0), 1).otherwise(0)).alias("up"))

    joined = F.aggregate(parts, start, step, lambda s: F.array_join(F.concat(F.array_repeat(F.lit(".."), s["up"]), s["kept"]), "/"))
    return F.when(joined == "", ".").when(path.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def workspace_path(text: str | Column, root: str | Column, name: str | Column) -> Column:
    """An output or input with its {workspaceRoot}, {projectRoot} and {projectName} filled in, relative to the workspace; null where '..' leaves it."""
    root = _column(root)
    inner = F.regexp_replace(_column(text), r"^\{workspaceRoot\}/?", "")
    inner = F.when(root == ".", F.replace(inner, F.lit("{projectRoot}/"), F.lit(""))).otherwise(inner)
    filled = F.replace(F.replace(inner, F.lit("{projectRoot}"), root), F.lit("{projectName}"), _column(name))
    joined = posix_join(F.lit(""), filled)
    return F.when(~joined.rlike(r"^\.\.(/|$)"), F.regexp_replace(joined, "(.)/$", "$1"))


def interpolated(command: str | Column, args: Column, fallback: str = "") -> Column:
    """A command with {args.name} replaced from a map of args, unknown names by the fallback, and {args} by all of them in order of name."""
    each = F.array_sort(F.map_entries(args))
    named = F.aggregate(each, _column(command), lambda text, e: F.replace(text, F.concat(F.lit("{args."), e["key"], F.lit("}")), e["value"]))
    whole = F.array_join(F.transform(each, lambda e: F.concat(F.lit("--"), e["key"], F.lit("="), e["value"])), " ")
    return F.replace(F.regexp_replace(named, r"\{args\.[^}]*\}", fallback), F.lit("{args}"), whole)


def log_name(task: str | Column) -> Column:
    """A task's log file: letters, digits, '-' and '.' stand for themselves, other bytes are _xx."""
    code = F.lower(F.hex(F.encode(_column(task), "UTF-8")))
    pairs = F.regexp_extract_all(code, F.lit("(..)"))
    shown = lambda x: F.decode(F.unhex(x), "UTF-8")
    plain = lambda x: x.rlike("^(3[0-9]|4[1-9a-f]|5[0-9a]|6[1-9a-f]|7[0-9a]|2d|2e)$")
    return F.concat(F.array_join(F.transform(pairs, lambda x: F.when(plain(x), shown(x)).otherwise(F.concat(F.lit("_"), x))), ""), F.lit(".log"))


def output_errors(outputs: str | Column) -> Column:
    """Of an array of declared outputs, those refused, each with why: no token before anything else, or a pattern before any directory of the workspace."""
    bare = lambda x: F.regexp_replace(x, "^!", "")
    no_token = lambda x: ~bare(x).rlike(r"(?s)^\{.+\}")
    whole = lambda x: bare(x).rlike(r"^\{workspaceRoot\}/?[^/]*[*?\[{(+@!|]")
    reason = lambda x: F.when(no_token(x), F.concat(x, F.lit(": no token first"))).when(whole(x), F.concat(x, F.lit(": pattern at the workspace root")))
    return F.array_compact(F.transform(_column(outputs), reason))


def is_dotenv(path: str | Column) -> Column:
    """.env, .env.* or .*.env"""
    return base_name(path).rlike(r"^\.env$|^\.env\.|^\..*\.env$")


def read_kind(path: str | Column) -> Column:
    """manifest, toolchain, tsconfig or content."""
    name = base_name(path)
    return (
        F.when(name == "package.json", "manifest").when(_column(path).isin(*TOOLCHAIN), "toolchain")
        .when(name.startswith("tsconfig") & name.endswith(".json"), "tsconfig").otherwise("content")
    )


def node_type(project_type: Column, name: Column, has_lib: Column, has_app: Column, has_package: Column, has_entry: Column) -> Column:
    """lib, app or e2e: by the declared type, else by tsconfig files, else by whether the package can be imported."""
    e2e = name.endswith("-e2e") | (name == "e2e")
    declared = F.when(project_type == "library", "lib").when(project_type.isNotNull() & e2e, "e2e").when(project_type.isNotNull(), "app")
    return declared.when(has_lib, "lib").when(has_app, "app").when(has_package & ~has_entry, "app").otherwise("lib")


def proportion(work: Column, concurrent: Column, cores: Column) -> Column:
    """The share of cores that is the share of work, rounded up; 0 without work."""
    return F.when(concurrent == 0, 0).otherwise(F.ceil(work * cores / concurrent)).cast("long")


def even_share(free: Column, ready: Column, reserved: Column) -> Column:
    return F.floor(F.greatest(free - reserved, F.lit(0)) / F.greatest(ready, F.lit(1))).cast("long")


def core_share(budget: Column, even: Column, free: Column, idle: Column, least: Column, most: Column) -> Column:
    """A task's cores: the even share within [least, most] and the budget, one at least; null while fewer are free, unless nothing else runs."""
    share = F.greatest(F.least(F.greatest(even, least), F.coalesce(most, budget), budget), F.lit(1))
    return F.when(share <= free, share).when(idle, F.greatest(free, F.lit(1))).cast("long")


def threads(cores: Column, scale: Column) -> Column:
    return F.greatest(F.ceil(cores * scale), F.lit(1)).cast("long")


def memory_fits(need: Column, free: Column, growth: Column, reserve: Column) -> Column:
    return F.greatest(F.greatest(free - reserve, F.lit(0)) - growth, F.lit(0)) >= need


def colon_parts(text: str | Column) -> Column:
    """A reference cut at its colons, but for those in double quotes, which go."""
    found = F.regexp_extract_all(F.concat(_column(text), F.lit(":")), F.lit('((?:[^:"]|"[^"]*")*):'))
    return F.transform(found, lambda x: F.replace(x, F.lit('"'), F.lit("")))


def parsed_references(references: DataFrame, targets: DataFrame, configurations: DataFrame, projects: DataFrame) -> DataFrame:
    """current, text, project, target, configuration of references(current, text), each in its best reading.

    A reading cuts the parts in a project, a target and a configuration that all exist (the project may be the
    current one, left out); the current project comes first, then the longest names. Without any, the parts are
    taken one after the other. targets(project, target), configurations(project, target, configuration), projects(project).
    """
    parts = references.select("current", "text").distinct().withColumn("parts", colon_parts("text"))
    n = F.size("parts")
    cut = parts.withColumn("i", F.explode(F.sequence(F.lit(0), n))).withColumn("j", F.explode(F.sequence(F.col("i"), n)))
    some = lambda first, count: F.array_join(F.slice("parts", first, count), ":")
    read = cut.where("j > i OR (i = size(parts) AND i > 0)").select(
        "current", "text", "parts",
        F.when(F.col("i") == 0, F.col("current")).otherwise(some(F.lit(1), F.col("i"))).alias("project"),
        F.when(F.col("j") > F.col("i"), some(F.col("i") + 1, F.col("j") - F.col("i"))).alias("target"),
        F.when(F.col("j") < n, some(F.col("j") + 1, n - F.col("j"))).alias("configuration"),
    )
    known = read.join(projects.select("project").distinct(), "project")
    known = known.join(targets.select("project", "target").distinct().withColumn("is_target", F.lit(True)), ["project", "target"], "left")
    known = known.join(configurations.select("project", "target", "configuration").distinct().withColumn("is_configuration", F.lit(True)), ["project", "target", "configuration"], "left")
    valid = (F.col("target").isNull() & F.col("configuration").isNull()) | (F.col("is_target") & (F.col("configuration").isNull() | F.col("is_configuration")))
    length = lambda c: F.coalesce(F.length(c), F.lit(0))
    rank = F.struct((F.col("project") == F.col("current")).alias("own"), F.length("project").alias("p"), length("target").alias("t"), length("configuration").alias("c"))
    best = known.where(valid).groupBy("current", "text").agg(F.max_by(F.struct("project", "target", "configuration"), rank).alias("best"))
    found = parts.join(best, ["current", "text"], "left")
    plain = F.struct(F.get("parts", F.lit(0)).alias("project"), F.get("parts", F.lit(1)).alias("target"), F.when(n > 2, F.array_join(F.slice("parts", 3, n), ":")).alias("configuration"))
    return found.withColumn("best", F.coalesce("best", plain)).select("current", "text", "best.*")
