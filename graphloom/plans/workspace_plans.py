"""Queries over a workspace of files: manifests, lockfiles, ignore rules, projections, names and filesets; the files are made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import documents, globs, names
from graphloom.operators import outputs, selection
from graphloom.plans.registry import query
from graphloom.session import counted as checkpointed
from graphloom.sources import history_store, lockfile, views, workspace

K = "CAST(p_partkey AS VARCHAR)"


def parts(spark, sf_dir):
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"), F.col("p_name").alias("label"), F.col("p_type").alias("kind"))


def text(template: str):
    """A template's {column} and {expression} places filled in."""
    pieces = []
    for piece in template.replace("{{", "\x01").replace("}}", "\x02").split("{"):
        inside, _, after = piece.partition("}") if pieces else ("", "", piece)
        pieces += [F.expr(f"cast({inside} as string)")] if inside else []
        pieces.append(F.lit(after.replace("\x01", "{").replace("\x02", "}")))
    return F.concat(*pieces)


def files(spark, sf_dir):
    """A manifest for each part, a project file for every other, and the root's."""
    part = parts(spark, sf_dir)
    manifest = text('{{"name": "@w/p{k}", "version": "1.{k % 4}.0", // its version\n "description": "{label}", /* entry */ "main": "i.js", "scripts": {{"lint": "x"}}, "dependencies": {{"@w/p{k div 2}": "^1.0.0"}},}}')
    bare = text('{{"name": "@w/p{k}", "version": "1.{k % 4}.0", "peerDependencies": {{"@w/p{k div 3}": "~1.1.0"}}}}')
    packages = part.select(text("packages/p{k}/package.json").alias("path"), F.when(F.col("k") % 3 == 0, bare).otherwise(manifest).alias("text"))
    own = text('{{"name": "p{k}", "projectType": "{if(k % 5 = 0, \'application\', \'library\')}", "tags": ["t{k % 3}"], "targets": {{"build": {{"executor": "run"}}}}}}')
    projects = part.where("k % 2 = 0").select(text("packages/p{k}/project.json").alias("path"), own.alias("text"))
    root = spark.createDataFrame([("package.json", '{"name": "root", "workspaces": ["packages/*", "!packages/p7"]}'), ("nx.json", "{broken")], "path string, text string")
    return packages.union(projects).union(root)


@query("s2_project_directories", f"SELECT 'packages/p' || {K} AS root FROM part WHERE p_partkey <> 7 UNION ALL SELECT '.'")
def s2(spark, sf_dir):
    found = files(spark, sf_dir)
    return workspace.project_directories(found, workspace.workspace_globs(found))


@query(
    "s3_projects",
    f"""SELECT CASE WHEN p_partkey % 2 = 0 THEN 'p' ELSE '@w/p' END || {K} AS name, 'packages/p' || {K} AS root, CASE WHEN p_partkey % 2 = 1 THEN NULL WHEN p_partkey % 5 = 0 THEN 'application' ELSE 'library' END AS project_type,
    CASE WHEN p_partkey % 2 = 0 THEN 't' || p_partkey % 3 ELSE '' END AS tags FROM part WHERE p_partkey <> 7""",
)
def s3(spark, sf_dir):
    return workspace.load(files(spark, sf_dir)).select("name", "root", "project_type", F.array_join("tags", ",").alias("tags"))


@query(
    "s4_versions_before",
    f"""SELECT '@w/p' || {K} AS name, CASE WHEN p_partkey % 10 = 4 THEN '0.9.0' ELSE '1.' || p_partkey % 4 || '.0' END AS version FROM part WHERE p_partkey % 10 <> 3
    UNION ALL SELECT 'root', NULL UNION ALL SELECT '@w/gone', '3.0.0'""",
)
def s4(spark, sf_dir):
    """Packages at the other revision: some were absent, some had another version, one is gone since."""
    part = parts(spark, sf_dir)
    older = text('{{"name": "@w/p{k}", "version": "0.9.0"}}')
    changes = part.where("k % 10 IN (3, 4)").select(text("packages/p{k}/package.json").alias("path"), F.when(F.col("k") % 10 == 4, older).alias("before"), F.lit("now").alias("after"))
    gone = spark.createDataFrame([("packages/gone/package.json", '{"name": "@w/gone", "version": "3.0.0"}', None)], "path string, before string, after string")
    return workspace.packages(workspace.at_revision(files(spark, sf_dir), changes.union(gone))).select("name", "version")


@query("s5_one_project", "SELECT 'p8' AS name, 'packages/p8' AS root, 'library' AS project_type")
def s5(spark, sf_dir):
    return workspace.project_at(files(spark, sf_dir), "packages/p8").select("name", "root", "project_type")


@query("s6_unreadable", "SELECT 'nx.json' AS path")
def s6(spark, sf_dir):
    return workspace.unreadable(files(spark, sf_dir))


@query(
    "s6_dependencies",
    f"""SELECT 'packages/p' || {K} AS root, CASE WHEN p_partkey % 3 = 0 THEN 'peerDependencies' ELSE 'dependencies' END AS section, '@w/p' || CASE WHEN p_partkey % 3 = 0 THEN p_partkey // 3 ELSE p_partkey // 2 END AS name,
    CASE WHEN p_partkey % 3 = 0 THEN '~1.1.0' ELSE '^1.0.0' END AS range FROM part""",
)
def s6_deps(spark, sf_dir):
    return workspace.package_deps(files(spark, sf_dir))


@query(
    "s6_targets",
    f"""SELECT 'p' || {K} AS project, 'build' AS target, 'run' AS executor FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN 'p' ELSE '@w/p' END || {K}, 'lint', 'nx:run-script' FROM part WHERE p_partkey % 3 <> 0 AND p_partkey <> 7""",
)
def s6_targets(spark, sf_dir):
    found = files(spark, sf_dir)
    return workspace.targets(found, workspace.projects(found)).select("project", "target", F.get_json_object("definition", "$.executor").alias("executor"))


def layered(spark, sf_dir):
    """A project for each part with a target in up to four layers over defaults by executor, by name and by glob."""
    part = parts(spark, sf_dir)
    root = text("mods/m{k}/")
    manifest = text('{{"name": "m{k}", "scripts": {{"lint": "l"}}, "nx": {{"targets": {{"pack": {{"executor": "x:{k % 3}", "inputs": ["a", "..."], "options": {{"depth": {n}, "keep": [1, "..."]}}}}}}}}}}')
    own = text('{{"targets": {{"pack": {{"options": {{"depth": 0, "...": true, "late": "{kind}"}}, "outputs": ["out", "..."]}}, "lint": {{"cache": true}}, "test-{k div 2 % 2}": {{"executor": "t"}}}}}}')
    local = text('{{"targets": {{"pack": {{"executor": "{if(k % 8 = 0, \'other\', \'\')}", "inputs": ["...", "z"]}}}}}}')
    settings = """{"targetDefaults": {"test-*": {"executor": "t", "cache": false}, "test-1": {"cache": true}, "lint": {"inputs": ["lints"]},
        "x:1": [{"filter": {"projects": ["m1*"]}, "outputs": ["dist"], "options": {"keep": [9], "base": 1}}, {"outputs": ["...", "more"]}], "pack": {"inputs": ["named"], "options": {"keep": [8]}}}}"""
    rows = part.select(F.concat(root, F.lit("package.json")).alias("path"), manifest.alias("text"))
    rows = rows.union(part.where("k % 2 = 0").select(F.concat(root, F.lit("project.json")), own)).union(part.where("k % 4 = 0").select(F.concat(root, F.lit("project.local.json")), local))
    return rows.union(spark.createDataFrame([("nx.json", settings), ("package.json", '{"workspaces": ["mods/*"]}')], "path string, text string"))


@query(
    "s3_resolved_targets",
    """WITH m AS (SELECT p_partkey AS k, p_size AS n, p_type AS kind, p_partkey % 2 = 0 AS own, p_partkey % 4 = 0 AS local, p_partkey % 8 = 0 AS other FROM part),
    d AS (SELECT *, CASE WHEN local THEN ['named'] WHEN k % 3 = 1 THEN [] ELSE ['named'] END AS base_inputs, CASE WHEN local OR k % 3 <> 1 THEN [8] WHEN starts_with(CAST(k AS VARCHAR), '1') THEN [9] ELSE [] END AS base_keep,
        CASE WHEN local OR k % 3 <> 1 THEN [] WHEN starts_with(CAST(k AS VARCHAR), '1') THEN ['dist', 'more'] ELSE ['more'] END AS base_outputs, NOT local AND k % 3 = 1 AND starts_with(CAST(k AS VARCHAR), '1') AS based FROM m)
    SELECT 'm' || k AS project, 'pack' AS target, CASE WHEN other THEN 'other' WHEN local THEN '' ELSE 'x:' || k % 3 END AS executor,
        array_to_string(list_concat(CASE WHEN other THEN base_inputs ELSE list_concat(['a'], base_inputs) END, CASE WHEN local THEN ['z'] ELSE [] END), ',') AS inputs,
        CASE WHEN other THEN NULL ELSE n END AS depth, array_to_string(CASE WHEN other THEN base_keep ELSE list_concat([1], base_keep) END, ',') AS keep, CASE WHEN own AND NOT other THEN kind END AS late,
        CASE WHEN own AND NOT other THEN array_to_string(list_concat(['out'], base_outputs), ',') WHEN len(base_outputs) > 0 THEN array_to_string(base_outputs, ',') ELSE '' END AS outputs, based, NULL AS cache FROM d
    UNION ALL SELECT 'm' || k, 'lint', 'nx:run-script', 'lints', NULL, '', NULL, '', false, CASE WHEN own THEN 'true' END FROM m
    UNION ALL SELECT 'm' || k, 'test-' || k // 2 % 2, 't', '', NULL, '', NULL, '', false, CASE k // 2 % 2 WHEN 1 THEN 'true' ELSE 'false' END FROM m WHERE own""",
)
def s3_resolved(spark, sf_dir):
    """What four layers, with spreads in arrays and objects and a layer that runs something else, come to over defaults of which some ask for projects."""
    files_ = layered(spark, sf_dir)
    rows = workspace.targets(files_, workspace.projects(files_))
    read = lambda path: F.get_json_object("definition", path)
    listed = lambda path: F.coalesce(F.array_join(F.from_json(read(path), "array<string>"), ","), F.lit(""))
    return rows.select(
        "project", "target", read("$.executor").alias("executor"), listed("$.inputs").alias("inputs"), read("$.options.depth").cast("int").alias("depth"),
        listed("$.options.keep").alias("keep"), read("$.options.late").alias("late"), listed("$.outputs").alias("outputs"), read("$.options.base").isNotNull().alias("based"), read("$.cache").alias("cache"),
    )


@query("s7_yaml_fields", f"""SELECT p_partkey AS k, '{{"a":' || {K} || ',"b":{{"c":"' || p_type || '"}}}}' AS kept, '{{"a":' || {K} || ',"b":{{"c":"' || p_type || '"}},"list":["x"]}}' AS rest FROM part""")
def s7(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("t", text("a: {k}\nb:\n  c: '{kind}'\n  d: [1, 2]\nlist:\n- x\n"))
    # a file of few bytes holds texts that take long to parse
    found = rows.repartition("k").select("k", documents.projections(F.lit("some.yaml"), F.col("t"), (["a", "b.c", "none.x"], []), (None, ["b.d"])).alias("found"))
    return found.select("k", F.col("found")[0].alias("kept"), F.col("found")[1].alias("rest"))


def lock(spark, sf_dir):
    """The entries of one lockfile, given as lines: an importer for each part, seven packages of three versions that depend on each other, an alias and an environment document."""
    versions = [(i, j) for i in range(7) for j in range(3)]
    snapshots = "".join(f"  dep{i}@1.0.{j}:\n" + (f"    dependencies:\n      dep{i + 1}: 1.0.{j}\n" if i < 6 else "    optionalDependencies:\n      other: dep0@1.0.0(peer@2.0.0)\n") for i, j in versions)
    head = "importers:\n  .:\n    configDependencies: {}\n---\nlockfileVersion: '9.0'\nimporters:\n  .:\n    dependencies:\n      linked:\n        specifier: workspace:*\n        version: link:packages/p1"
    tail = "snapshots:\n" + snapshots + "  dep0@1.0.0(peer@2.0.0): {}"
    importers = parts(spark, sf_dir).select(F.col("k").alias("at"), text("  packages/p{k}:\n    dependencies:\n      dep{k % 7}:\n        specifier: ^1.0.0\n        version: 1.0.{k % 3}").alias("t"))
    ends = spark.createDataFrame([(-1, head), (2**40, tail)], "at long, t string")
    lines = importers.union(ends).select("at", F.posexplode(F.split("t", "\n")).alias("place", "value"))
    # a number for each line, in order: 16 are kept for an importer, and as many as the head and the snapshots have for those
    numbered = lines.select(F.lit("pnpm-lock.yaml").alias("path"), (F.col("at") * 16 + F.col("place")).alias("n"), "value")
    return checkpointed(lockfile.scan(lockfile.cut(numbered)))


LOCK = """, v AS (SELECT i, j FROM range(7) a(i), range(3) b(j)),
    direct AS (SELECT 'packages/p' || p_partkey AS importer, 'dep' || p_partkey % 7 || '@1.0.' || p_partkey % 3 AS key FROM part),
    depends AS (SELECT 'dep' || i || '@1.0.' || j AS source, CASE WHEN i < 6 THEN 'dep' || (i + 1) || '@1.0.' || j ELSE 'dep0@1.0.0(peer@2.0.0)' END AS target FROM v)"""


@query(
    "s8_lockfile",
    LOCK
    + """ SELECT 'direct' AS kind, 'packages/p' || p_partkey AS owner, 'dep' || p_partkey % 7 AS name, '1.0.' || p_partkey % 3 AS reference FROM part UNION ALL SELECT 'direct', '.', 'linked', 'link:packages/p1'
    UNION ALL SELECT 'depends', 'dep' || i || '@1.0.' || j, CASE WHEN i < 6 THEN 'dep' || (i + 1) ELSE 'other' END, CASE WHEN i < 6 THEN '1.0.' || j ELSE 'dep0@1.0.0(peer@2.0.0)' END FROM v""",
)
def s8(spark, sf_dir):
    return lock(spark, sf_dir).where("kind IN ('direct', 'depends')").select("kind", "owner", "name", "reference")


@query(
    "s8_installed",
    LOCK + ", reach(importer, key) AS (SELECT * FROM direct UNION SELECT r.importer, d.target FROM reach r JOIN depends d ON d.source = r.key) SELECT importer, key FROM reach",
    recursive=True,
)
def s8_installed(spark, sf_dir):
    return lockfile.installed(lock(spark, sf_dir))


@query("g13_alias", "SELECT 'other' AS name, 'dep0@1.0.0(peer@2.0.0)' AS key UNION ALL SELECT 'dep0', 'dep0@1.0.0(peer@2.0.0)' UNION ALL SELECT 'dep0', 'dep0@1.0.' || j FROM range(3) r(j)")
def g13(spark, sf_dir):
    names_ = spark.createDataFrame([("other",), ("dep0",), ("absent",)], "name string")
    return lockfile.installed_as(lock(spark, sf_dir), names_)


@query("f25_covered", LOCK + ", reach(key) AS (SELECT key FROM direct WHERE importer = 'packages/p2' UNION SELECT 'dep5@1.0.' || j FROM range(3) r(j) UNION SELECT d.target FROM reach r JOIN depends d ON d.source = r.key) SELECT key FROM reach", recursive=True)
def f25(spark, sf_dir):
    importers, named = spark.createDataFrame([("packages/p2",)], "importer string"), spark.createDataFrame([("dep5",)], "name string")
    return lockfile.covered(lock(spark, sf_dir), importers, named)


@query("s23_external_nodes", LOCK + " SELECT 'npm:dep' || i || '@1.0.' || j AS name, 'dep' || i AS package, '1.0.' || j AS version FROM v UNION ALL SELECT 'npm:dep0@1.0.0(peer@2.0.0)', 'dep0', '1.0.0'")
def s23(spark, sf_dir):
    return lockfile.external_nodes(lock(spark, sf_dir))[0]


@query("s23_external_edges", LOCK + " SELECT importer AS source, 'npm:' || key AS target FROM direct UNION SELECT 'npm:' || source, 'npm:' || target FROM depends")
def s23_edges(spark, sf_dir):
    return lockfile.external_nodes(lock(spark, sf_dir))[1]


TREE = """, tree AS (SELECT p_partkey AS k, p_partkey % 5 AS d, p_partkey % 3 AS e, ['log', 'tmp', 'txt'][p_size % 3 + 1] AS ext, CASE WHEN p_partkey % 4 = 0 THEN 'keep' ELSE 'f' END || p_partkey AS name FROM part),
    t AS (SELECT *, 'd' || d || '/e' || e || '/' || name || '.' || ext AS path FROM tree)"""


def tree(spark, sf_dir):
    path = text("d{k % 5}/e{k % 3}/{if(k % 4 = 0, 'keep', 'f')}{k}.{element_at(array('log', 'tmp', 'txt'), cast(n % 3 + 1 as int))}")
    return parts(spark, sf_dir).select("k", path.alias("path"))


@query("s10_sources", TREE + " SELECT path FROM t WHERE NOT ((ext = 'log' AND name NOT LIKE 'keep%' AND k <> 7) OR d = 1 OR (d = 2 AND (e = 0 OR (ext = 'tmp' AND k <> 7)))) UNION ALL SELECT '.gitignore' UNION ALL SELECT 'd2/.nxignore'")
def s10(spark, sf_dir):
    """Rules of the root and of a folder: extensions, exceptions, folders, anchored names."""
    rules = spark.createDataFrame([(".gitignore", "# logs\n*.log\n!keep*.log\n/d1/\n\n"), ("d2/.nxignore", "/e0\n*.tmp\n!f7.*\ne1/nothing/\n"), ("node_modules/x/a.js", "x")], "path string, text string")
    found = tree(spark, sf_dir).select("path", F.lit("x").alias("text")).union(rules)
    return workspace.without_ignored(found, workspace.ignore_rules(found)).select("path")


@query("f1_order", "SELECT name, CASE WHEN tag = 'LARGE' THEN 0 WHEN root = 'Brand#12' AND tag <> 'PROMO' THEN 1 ELSE 3 END AS place FROM catalog WHERE (tag = 'LARGE' OR root = 'Brand#12') AND tag <> 'PROMO' OR regexp_matches(tag, '^PROM[^/]*$')", "catalog")
def f1_order(spark, sf_dir):
    found = selection.select_projects(views.catalog(spark, sf_dir), ["tag:LARGE", "directory:Brand#12", "!tag:PROMO", "tag:PROM*"], ordered=True)
    return found.select("name", "place")


@query("f2_native", "SELECT name FROM catalog WHERE (tag = 'SMALL' AND NOT regexp_matches(name, '^1[^/]*$')) OR name LIKE '% ring'", "catalog")
def f2(spark, sf_dir):
    """A first '!' starts from nothing, a word is no name, and directories are no names."""
    return selection.select_projects(views.catalog(spark, sf_dir), ["!tag:LARGE", "tag:SMALL", "bolt", "Brand#1*", "!1*", "* ring"], native=True).select("name")


@query(
    "f6_cache_globs",
    TREE
    + """ SELECT path, 'a' AS pattern FROM t WHERE regexp_matches(path, '^d(1|2)/([^/]+/)*(keep)?f?[0-9]+[.]log$') AND d IN (1, 2)
    UNION ALL SELECT path, 'b' FROM t WHERE ext NOT IN ('log', 'tmp') UNION ALL SELECT path, 'c' FROM t WHERE regexp_matches(name, '^f(1|2)+$') AND ext = 'txt'""",
)
def f6(spark, sf_dir):
    patterns = {"a": "@(d1|d2)/**/*(keep)?(f)+([0-9]).log", "b": "d*/e?/*.!(log|tmp)", "c": "**/f+(1|2).txt"}
    rows = tree(spark, sf_dir).select("path", F.explode(F.array_compact(F.array(*(F.when(F.col("path").rlike(globs.extended_regex(g)), F.lit(n)) for n, g in patterns.items())))).alias("pattern"))
    return rows


@query("f8_group_files", TREE + " SELECT 'one' AS \"group\", path FROM t WHERE d = 0 AND e <> 1 AND ext <> 'log' UNION ALL SELECT 'two', path FROM t WHERE d = 0 AND e = 1 AND ext = 'log'")
def f8(spark, sf_dir):
    """Read from a project's folder, a pattern leaves nested projects out; '!' counts for the whole group."""
    groups = spark.createDataFrame([("one", "d0/**/*"), ("one", "!**/*.log"), ("two", "d0/e1/*.log")], "group string, pattern string")
    roots = spark.createDataFrame([("d0",), ("d0/e1",)], "root string")
    return outputs.group_files(tree(spark, sf_dir).select("path"), groups, roots)


@query("f9_filters", "SELECT s_suppkey AS name FROM supplier WHERE s_suppkey % 3 = 1 AND s_suppkey % 4 IN (0, 1)")
def f9(spark, sf_dir):
    supplier = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"))
    projects = supplier.select("name", F.element_at(F.array(F.lit("app"), F.lit("lib"), F.lit("e2e")), (F.col("name") % 3 + 1).cast("int")).alias("type"))
    targets = supplier.select(F.col("name").alias("project"), F.element_at(F.array(*map(F.lit, ("build", "test", "lint", "e2e"))), (F.col("name") % 4 + 1).cast("int")).alias("target"))
    return outputs.filtered(projects, targets, "lib", ["build", "test"]).select("name")


@query(
    "f10_node_type",
    """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'lib' WHEN 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'e2e' ELSE 'app' END ELSE CASE WHEN p_size % 5 = 0 THEN 'lib' WHEN p_size % 5 = 1 THEN 'app' WHEN p_size % 5 = 2 AND p_size % 2 = 1 THEN 'app' ELSE 'lib' END END AS type FROM part""",
)
def f10(spark, sf_dir):
    k, n = F.col("k"), F.col("n")
    kind = F.when(k % 4 == 0, "library").when(k % 4 == 1, "application")
    name = F.concat(k.cast("string"), F.when(k % 3 == 0, "-e2e").otherwise(""))
    return parts(spark, sf_dir).select("k", names.node_type(kind, name, n % 5 == 0, n % 5 == 1, n % 5 == 2, n % 2 == 0).alias("type"))


@query("f12_json_fields", f"""SELECT p_partkey AS k, '{{"a":{{"b":' || {K} || '}},"list":[1,' || {K} || ']}}' AS kept FROM part""")
def f12(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("t", text('{{"a": {{"b": {k}, "c": "{kind}"}}, /* not this */ "list": [1, {k}], "z": null,}}'))
    return rows.select("k", documents.projected(F.lit("x.json"), F.col("t"), ["a.b", "a.c", "list"], ["a.c", "q.r"]).alias("kept"))


@query("f13_dependent_manifest", f"""SELECT p_partkey AS k, '{{"exports":"x' || {K} || '","name":"n"}}' AS with_lock, '{{"dependencies":{{"d":"' || {K} || '"}},"exports":"x' || {K} || '","name":"n"}}' AS without_lock FROM part""")
def f13(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("t", text('{{"name": "n", "version": "{n}", "license": "MIT", "dependencies": {{"d": "{k}"}}, "scripts": {{}}, "exports": "x{k}"}}'))
    return rows.select("k", documents.manifest_for_dependents(F.col("t"), True).alias("with_lock"), documents.manifest_for_dependents(F.col("t"), False).alias("without_lock"))


@query("f14_without_resolution", f"""SELECT p_partkey AS k, '{{"packages":["p' || {K} || '"]}}' AS kept FROM part""")
def f14(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("t", text("packages:\n- p{k}\ncatalog:\n  a: 1.0.{n}\noverrides: {{}}\n"))
    return rows.select("k", documents.projected(F.lit("pnpm-workspace.yaml"), F.col("t"), None, documents.RESOLUTION_KEYS).alias("kept"))


@query("f15_keyed_settings", f"""SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '{{"cli":{{"packageManager":"pnpm"}},"plugins":["p' || {K} || '"]}}' ELSE '{{"plugins":["p' || {K} || '"]}}' END AS kept FROM part""")
def f15(spark, sf_dir):
    cli = F.when(F.col("k") % 2 == 0, '"cli": {"packageManager": "pnpm", "x": 1}, ').otherwise('"cli": {"x": 1}, ')
    rows = parts(spark, sf_dir).withColumn("t", F.concat(F.lit("{"), cli, text('"parallel": {n}, "namedInputs": {{}}, "plugins": ["p{k}"]}}')))
    return rows.select("k", documents.keyed_settings(F.col("t")).alias("kept"))


@query("f16_tsconfig", f"""SELECT p_partkey AS k, '{{"compilerOptions":{{"strict":true}}}}' AS rest, '@p/' || {K} || '=libs/p' || {K} AS paths, 'libs/b' || {K} || ',libs/c' AS refs FROM part""")
def f16(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("t", text('{{ // root\n "compilerOptions": {{"strict": true, "paths": {{"@p/{k}": ["libs/p{k}"]}}}}, "references": [{{"path": "./libs/a/../c/"}}, {{"path": "libs/b{k}"}}]}}'))
    found = rows.select("k", documents.tsconfig_parts(F.col("t")).alias("p"))
    listed = F.array_join(F.transform(F.map_entries("p.paths"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ",")
    return found.select("k", "p.rest", listed.alias("paths"), F.array_join("p.references", ",").alias("refs"))


KINDS = ["package.json", "a/package.json", ".npmrc", "a/.npmrc", "tsconfig.lib.json", "a/tsconfig.json", "a/b.ts", ".env", "x/.env.local", ".prod.env", "env"]


@query("f18_read_kind", "SELECT p_partkey AS k, ['manifest', 'manifest', 'toolchain', 'content', 'tsconfig', 'tsconfig', 'content', 'content', 'content', 'content', 'content'][p_partkey % 11 + 1] AS kind, p_partkey % 11 IN (7, 8, 9) AS dotenv FROM part")
def f18(spark, sf_dir):
    """the kind of file, and whether it is a dotenv file."""
    path = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % 11 + 1).cast("int"))
    return parts(spark, sf_dir).select("k", names.read_kind(path).alias("kind"), names.is_dotenv(path).alias("dotenv"))


@query("f21_output_matches", TREE + " SELECT 'one' AS task, path FROM t WHERE d = 0 AND NOT (e = 1 AND ext = 'tmp') UNION ALL SELECT 'two', path FROM t WHERE ext = 'log' AND d = 3 UNION ALL SELECT 'three', path FROM t WHERE d = 4 AND e = 2")
def f21(spark, sf_dir):
    rows = [("one", "d0"), ("one", "!d0/e1/*.tmp"), ("two", "d3/**/*.log"), ("three", "d4/e[2-9]")]
    return outputs.output_matches(tree(spark, sf_dir).select("path"), spark.createDataFrame(rows, "task string, pattern string"))


@query(
    "f22_default_outputs",
    f"""SELECT {K} AS task, unnest(CASE p_partkey % 4 WHEN 0 THEN ['out/p' || {K}] WHEN 1 THEN ['dist/libs/p' || {K}, 'libs/p' || {K} || '/dist', 'libs/p' || {K} || '/build', 'libs/p' || {K} || '/public']
        WHEN 2 THEN ['libs/p' || {K} || '/o', '!dist/x'] ELSE [] END) AS output FROM part""",
)
def f22(spark, sf_dir):
    k = F.col("k")
    declared = F.when(k % 4 == 2, F.array(F.lit("{projectRoot}/o"), F.lit("!{workspaceRoot}/dist/x"), F.lit("{projectRoot}/../../../away")))
    rows = parts(spark, sf_dir).select(
        k.cast("string").alias("task"), F.when(k % 4 == 3, "test").otherwise("build").alias("target"), text("libs/p{k}").alias("root"), text("p{k}").alias("name"), F.when(k % 4 == 0, text("out/./p{k}")).alias("output_path"), declared.alias("outputs")
    )
    return outputs.default_outputs(rows)


@query("f23_inspect", "SELECT value, value IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_suppkey = 1) AS held FROM (SELECT unnest(['1', '2', '77', 'x', '150']) AS value)")
def f23(spark, sf_dir):
    inputs = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("task"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").cast("string").alias("value"))
    return outputs.inspected(inputs, "1", ["1", "2", "77", "x", "150"])


@query(
    "m_target_reference",
    f"""SELECT DISTINCT current, text, project, target, configuration FROM (SELECT 'p' || p_partkey % 3 AS current, unnest([['build', 'p' || p_partkey % 3, 'build', NULL], ['p1:build:ci', 'p1', 'build', 'ci'], ['p1:build:x', 'p1', 'build:x', NULL], ['"a:b":test', 'a:b', 'test', NULL],
        ['p2', 'p2', NULL, NULL], ['none:at:all', 'none', 'at', 'all']]) AS r, r[1] AS text, r[2] AS project, r[3] AS target, r[4] AS configuration FROM part)""",
)
def m_target(spark, sf_dir):
    references = parts(spark, sf_dir).select(text("p{k % 3}").alias("current"), F.explode(F.array(*map(F.lit, ("build", "p1:build:ci", "p1:build:x", '"a:b":test', "p2", "none:at:all")))).alias("text"))
    targets = spark.createDataFrame([("p0", "build"), ("p1", "build"), ("p2", "build"), ("p1", "build:x"), ("a:b", "test")], "project string, target string")
    configurations = spark.createDataFrame([("p1", "build", "ci"), ("p1", "build", "x")], "project string, target string, configuration string")
    return names.parsed_references(references, targets, configurations, targets.select("project"))


@query("m_posix_join", f"SELECT p_partkey AS k, ['a/' || {K}, 'libs/x/', '../../b', '.', 'libs/p/q'][p_partkey % 5 + 1] AS joined FROM part")
def m_join(spark, sf_dir):
    path = F.element_at(F.array(text("../../a/{k}"), F.lit("../x/"), F.lit("../../../../b"), F.lit("../../"), F.lit("./q//")), (F.col("k") % 5 + 1).cast("int"))
    return parts(spark, sf_dir).select("k", F.regexp_replace(names.posix_join(F.lit("libs/p"), path), "^libs/p/q/$", "libs/p/q").alias("joined"))


@query("m_interpolated", f"SELECT p_partkey AS k, 'go ' || {K} || '  to ' || p_type AS one, 'all --b=' || p_type || ' --k=' || {K} AS two FROM part")
def m_interpolated(spark, sf_dir):
    args = F.map_from_arrays(F.array(F.lit("k"), F.lit("b")), F.array(F.col("k").cast("string"), F.col("kind")))
    return parts(spark, sf_dir).select("k", names.interpolated(F.lit("go {args.k} {args.none} to {args.b}"), args).alias("one"), names.interpolated(F.lit("all {args}"), args).alias("two"))


@query("m_log_name", f"SELECT p_partkey AS k, 'p-' || {K} || '_3abuild_20_c3_a9.x.log' AS name FROM part")
def m_log(spark, sf_dir):
    return parts(spark, sf_dir).select("k", names.log_name(text("p-{k}:build é.x")).alias("name"))


@query(
    "m_shares",
    """SELECT p_partkey AS k, CASE WHEN p_size % 4 = 0 THEN 0 ELSE CAST(ceil(p_partkey % 50 * 8 / (p_size % 4)) AS BIGINT) END AS part, greatest(p_size - 3, 0) // greatest(p_partkey % 5, 1) AS even,
        CASE WHEN share <= p_size % 9 THEN share WHEN p_partkey % 2 = 0 THEN greatest(p_size % 9, 1) END AS share, CAST(greatest(ceil(p_size * 0.5), 1) AS BIGINT) AS threads, greatest(greatest(p_size - 2, 0) - 5, 0) >= 10 AS fits
    FROM (SELECT *, greatest(least(greatest(p_size % 6, 2), 4, 8), 1) AS share FROM part)""",
)
def m_shares(spark, sf_dir):
    k, n = F.col("k"), F.col("n").cast("long")
    share = names.core_share(F.lit(8), n % 6, n % 9, k % 2 == 0, F.lit(2), F.lit(4))
    return parts(spark, sf_dir).select(
        "k", names.proportion(k % 50, n % 4, F.lit(8)).alias("part"), names.even_share(n, k % 5, F.lit(3)).alias("even"), share.alias("share"), names.threads(n, F.lit(0.5)).alias("threads"),
        names.memory_fits(F.lit(10), n, F.lit(5), F.lit(2)).alias("fits"),
    )


@query("m_keyed_definition", f"""SELECT p_partkey AS k, '{{"command":"c' || {K} || '","executor":"run"}}' AS kept FROM part""")
def m_definition(spark, sf_dir):
    return parts(spark, sf_dir).select("k", documents.keyed_definition(text('{{"executor": "run", "metadata": {{"d": {n} }}, "command": "c{k}", "tool:own": 1}}'), ["tool:own"]).alias("kept"))


@query("m_output_errors", f"SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'dist/' || {K} || ': no token first;{{workspaceRoot}}/*.js: pattern at the workspace root' WHEN 1 THEN '' ELSE '{{}}/x: no token first' END AS errors FROM part")
def m_outputs(spark, sf_dir):
    good = F.array(F.lit("{workspaceRoot}/dist/*.js"), F.lit("!{projectRoot}/x"), F.lit("{options.out}"))
    bad = F.when(F.col("k") % 3 == 0, F.array(text("dist/{k}"), F.lit("{workspaceRoot}/*.js"))).when(F.col("k") % 3 == 2, F.array(F.lit("{}/x"))).otherwise(F.array().cast("array<string>"))
    return parts(spark, sf_dir).select("k", F.array_join(names.output_errors(F.concat(good, bad)), ";").alias("errors"))


@query("s14_dotenv", f"SELECT p_partkey AS k, 'A=' || {K} || ',B=x' || {K} || 'y,C=$A,D=two words' AS variables FROM part")
def s14(spark, sf_dir):
    """Quotes, comments, escapes and references, a text for each part."""
    from graphloom.sources.logs import dotenv_pairs

    rows = parts(spark, sf_dir).select("k", text("# head\nA={k} # tail\nexport B=\"x${{A}}y\"\nC='$A'\nD=two words\n").alias("text"))
    return rows.select("k", F.array_join(F.transform(dotenv_pairs("text"), lambda e: F.concat(e["name"], F.lit("="), e["value"])), ",").alias("variables"))


@query("s20_point_reads", "SELECT run, task, key, NULL AS inputs FROM (SELECT *, max(started) OVER (PARTITION BY run) AS last FROM exec_log WHERE task = 'view:0' AND key IS NOT NULL) QUALIFY dense_rank() OVER (ORDER BY last DESC, run DESC) = 1", "exec_log")
def s20(spark, sf_dir):
    """The key of a task in the latest run that has it; no inputs are kept."""
    inputs = spark.createDataFrame([], "key string, inputs string")
    found = history_store.key_of(views.exec_log(spark, sf_dir), inputs, "view:0")
    return found


@query("s24_reports", f"SELECT 'r' || {K} AS path, 't' || p_partkey % 9 AS task, '{{\"root\":\"x\"}}' AS context, unnest(['a', 'b' || {K}]) AS observed FROM part WHERE p_partkey % 4 <> 0")
def s24(spark, sf_dir):
    report = F.when(F.col("k") % 4 == 0, "no report").otherwise(text('{{"task": "t{k % 9}", "context": {{"root": "x"}}, "observed": ["a", "b{k}"]}}'))
    return history_store.parsed_reports(parts(spark, sf_dir).select(text("r{k}").alias("path"), F.try_parse_json(report).alias("report")))


@query(
    "o5_candidate_order",
    """, above AS (SELECT page_id, path, array_to_string(parts[1:n], '/') AS directory, n FROM (SELECT *, string_split(path, '/') AS parts FROM paths), generate_series(1, 9) s(n) WHERE n < len(parts)),
    occupied AS (SELECT DISTINCT directory FROM above WHERE page_id % 4 = 0), found AS (SELECT directory, count(*) AS files FROM (SELECT path, min_by(directory, n) AS directory FROM above WHERE page_id % 4 <> 0 AND directory NOT IN (SELECT directory FROM occupied) GROUP BY path) GROUP BY directory)
    SELECT *, row_number() OVER (ORDER BY files DESC, directory) AS place FROM found""",
    "paths",
)
def o5(spark, sf_dir):
    from graphloom import api

    paths = views.paths(spark, sf_dir)
    return api.warm_candidates(paths.where("page_id % 4 <> 0").select("path"), paths.where("page_id % 4 = 0").select("path"))


@query("f17_redacted", f"SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '{{\"A\":\"<redacted>\",\"B\":null}}' ELSE '{{\"A\":\"<redacted>\",\"B\":\"<redacted>\"}}' END AS shown FROM part")
def f17(spark, sf_dir):
    """Values are hidden, absent ones stay absent."""
    from graphloom.functions.formats import redacted

    variables = F.map_from_arrays(F.array(F.lit("A"), F.lit("B")), F.array(F.col("label"), F.when(F.col("k") % 3 != 0, F.col("kind"))))
    return parts(spark, sf_dir).select("k", F.to_json(redacted(variables)).alias("shown"))
