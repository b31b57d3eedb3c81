"""Queries over task plans, configuration, commits, traces, verdicts and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import formats
from graphloom.operators import affected, storage, verdicts
from graphloom.plans.registry import query
from graphloom.sources import history_store, logs, views

TARGETS = """, targets AS (SELECT p_partkey AS project, 'build' AS target FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT p_partkey, 'prepare' FROM part WHERE p_partkey % 2 = 0),
    near(start, target, here) AS (SELECT id, t, id FROM nodes, (VALUES ('build')) v(t) UNION
        SELECT n.start, n.target, e.target FROM near n JOIN edges e ON e.source = n.here
        WHERE n.here = n.start OR NOT EXISTS (SELECT 1 FROM targets x WHERE x.project = n.here AND x.target = n.target)),
    nearest AS (SELECT DISTINCT start, target, here AS project FROM near n WHERE here <> start AND EXISTS (SELECT 1 FROM targets x WHERE x.project = n.here AND x.target = n.target)),
    links AS (SELECT t.project, t.target, n.project AS on_project, 'build' AS on_target FROM targets t JOIN nearest n ON n.start = t.project WHERE t.target = 'build'
        UNION SELECT t.project, 'build', t.project, 'prepare' FROM targets t JOIN targets o ON o.project = t.project AND o.target = 'prepare' WHERE t.target = 'build'),
    tasks(project, target) AS (SELECT project, target FROM targets WHERE target = 'build' AND project % 100 = 7 UNION
        SELECT l.on_project, l.on_target FROM tasks k JOIN links l USING (project, target))"""


def targets(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("project"), "p_size")
    return part.where("p_size % 3 <> 0").select("project", F.lit("build").alias("target")).union(part.where("project % 2 = 0").select("project", F.lit("prepare").alias("target")))


def plan(spark, sf_dir):
    """build depends on build of the nearest dependencies and on its own prepare."""
    has = targets(spark, sf_dir)
    rules = spark.createDataFrame([("build", "build", True), ("build", "prepare", False)], "target string, on_target string, upstream boolean")
    return affected.plan_tasks(has.where("target = 'build' AND project % 100 = 7"), has, rules, views.edges(spark, sf_dir))


@query("g8_task_plan", TARGETS + " SELECT project, target FROM tasks", "nodes edges", recursive=True)
def g8(spark, sf_dir):
    return plan(spark, sf_dir)[0]


@query("g8_task_edges", TARGETS + " SELECT l.* FROM links l JOIN tasks USING (project, target)", "nodes edges", recursive=True)
def g8_edges(spark, sf_dir):
    return plan(spark, sf_dir)[1]


@query(
    "j12_config_diff",
    """, pair AS (SELECT p_partkey AS project, 'size' AS field, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 5 END AS a, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_partkey % 5 END AS b FROM part)
    SELECT project, field, CASE WHEN a IS NULL THEN 'Added' WHEN b IS NULL THEN 'Deleted' ELSE 'Modified' END AS kind FROM pair WHERE a IS DISTINCT FROM b""",
)
def j12(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("project"), F.lit("size").alias("field"), "p_size")
    before = part.where("p_size % 7 <> 0").select("project", "field", F.concat(F.lit('{"x": 1, "v": '), (F.col("p_size") % 5).cast("string"), F.lit("}")).alias("document"))
    after = part.where("p_size % 11 <> 0").select("project", "field", F.concat(F.lit('{"v":'), (F.col("project") % 5).cast("string"), F.lit(',"x":1}')).alias("document"))
    return affected.config_differences(before, after)


ANCESTORS = """, a(id) AS (SELECT CAST(190 AS BIGINT) UNION SELECT e.target FROM a JOIN edges e ON e.source = a.id), b(id) AS (SELECT CAST(142 AS BIGINT) UNION SELECT e.target FROM b JOIN edges e ON e.source = b.id)"""


@query(
    "s12_merge_base",
    ANCESTORS + """, common AS (SELECT id FROM a WHERE id IN (SELECT id FROM b)), bases AS (SELECT id FROM common c WHERE NOT EXISTS (SELECT 1 FROM common d JOIN edges e ON e.source = d.id WHERE e.target = c.id))
    SELECT min(id) AS id FROM bases""",
    "edges",
    recursive=True,
)
def s12(spark, sf_dir):
    return affected.merge_base(views.edges(spark, sf_dir), 190, 142)


@query(
    "s12_upstream_base",
    """, h(id) AS (SELECT CAST(190 AS BIGINT) UNION SELECT e.target FROM h JOIN edges e ON e.source = h.id), l(id) AS (SELECT CAST(3 AS BIGINT) UNION SELECT e.target FROM l JOIN edges e ON e.source = l.id),
    u(id) AS (SELECT CAST(95 AS BIGINT) UNION SELECT e.target FROM u JOIN edges e ON e.source = u.id), near AS (SELECT id FROM h WHERE id IN (SELECT id FROM l)), far AS (SELECT id FROM h WHERE id IN (SELECT id FROM u)),
    one AS (SELECT min(id) AS id FROM near n WHERE NOT EXISTS (SELECT 1 FROM near d JOIN edges e ON e.source = d.id WHERE e.target = n.id)),
    two AS (SELECT min(id) AS id FROM far n WHERE NOT EXISTS (SELECT 1 FROM far d JOIN edges e ON e.source = d.id WHERE e.target = n.id)),
    older(id) AS (SELECT id FROM two UNION SELECT e.target FROM older o JOIN edges e ON e.source = o.id)
    SELECT CASE WHEN two.id <> one.id AND one.id IN (SELECT id FROM older) THEN two.id ELSE one.id END AS id FROM one, two""",
    "edges",
    recursive=True,
)
def s12_upstream(spark, sf_dir):
    """A stale branch: its upstream's base with the head is later and counts."""
    return affected.merge_base(views.edges(spark, sf_dir), 3, 190, upstream=95)


@query(
    "s13_landed",
    ANCESTORS + ", c(id) AS (SELECT CAST(95 AS BIGINT) UNION SELECT e.target FROM c JOIN edges e ON e.source = c.id) SELECT count(*) AS n FROM a WHERE id NOT IN (SELECT id FROM b) AND id IN (SELECT id FROM c)",
    "edges",
    recursive=True,
)
def s13(spark, sf_dir):
    return affected.landed(views.edges(spark, sf_dir), 142, 190, 95)


@query("l1_by_path", "SELECT DISTINCT owner AS project, path AS detail FROM (SELECT p.path, (SELECT root FROM roots r WHERE p.path = r.root OR starts_with(p.path, r.root || '/') ORDER BY length(root) DESC LIMIT 1) AS owner FROM paths p) WHERE owner IS NOT NULL", "paths roots")
def l1(spark, sf_dir):
    return affected.touched_by_path(views.paths(spark, sf_dir), views.roots(spark, sf_dir))


@query(
    "l6_lockfile_touched",
    """SELECT DISTINCT coalesce(a.importer, b.importer) AS importer FROM installs_before b FULL JOIN installs_after a USING (importer, key) WHERE a.fingerprint IS DISTINCT FROM b.fingerprint""",
    "installs_before installs_after",
)
def l6(spark, sf_dir):
    from graphloom.operators.locate import install_changes

    before, after = (views.installs(spark, sf_dir, s) for s in "OF")
    return install_changes(before, after).select("importer").distinct()


LINES = """, lines AS (SELECT event_id AS seq, CASE event_id % 5 WHEN 0 THEN '12 openat(AT_FDCWD, "/src/' || k || '", O_RDONLY|O_CLOEXEC) = 3' WHEN 1 THEN '13 openat(AT_FDCWD, "/out/' || k || '", O_WRONLY|O_CREAT, 0644) = 4'
    WHEN 2 THEN 'stat("/src/' || k || '", 0x7f) = -1 ENOENT (No such file)' WHEN 3 THEN '14 openat(AT_FDCWD, "/dir/' || k || '", O_RDONLY|O_DIRECTORY) = 5' ELSE '15 +++ exited with 0 +++' END AS value, k
    FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events))"""


@query(
    "s15_trace_lines",
    LINES
    + """ SELECT seq, CAST(CASE seq % 5 WHEN 0 THEN 12 WHEN 1 THEN 13 WHEN 3 THEN 14 END AS BIGINT) AS process, CASE seq % 5 WHEN 1 THEN '/out/' WHEN 3 THEN '/dir/' ELSE '/src/' END || k AS path,
    CASE seq % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'metadata' ELSE 'list' END AS operation, CASE WHEN seq % 5 = 2 THEN 'missing' ELSE 'ok' END AS result FROM lines WHERE seq % 5 <> 4""",
)
def s15(spark, sf_dir):
    k, n = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    text = (
        F.when(n == 0, F.concat(F.lit('12 openat(AT_FDCWD, "/src/'), k, F.lit('", O_RDONLY|O_CLOEXEC) = 3')))
        .when(n == 1, F.concat(F.lit('13 openat(AT_FDCWD, "/out/'), k, F.lit('", O_WRONLY|O_CREAT, 0644) = 4')))
        .when(n == 2, F.concat(F.lit('stat("/src/'), k, F.lit('", 0x7f) = -1 ENOENT (No such file)')))
        .when(n == 3, F.concat(F.lit('14 openat(AT_FDCWD, "/dir/'), k, F.lit('", O_RDONLY|O_DIRECTORY) = 5')))
        .otherwise("15 +++ exited with 0 +++")
    )
    return logs.trace_accesses(views.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), text.alias("value")))


@query("s21_listed_keys", "SELECT left(sha256(CAST(l_partkey AS VARCHAR)), 20) AS key, max(l_orderkey) AS time FROM lineitem WHERE l_quantity > 5 GROUP BY l_partkey")
def s21(spark, sf_dir):
    key = F.substring(F.sha2(F.col("l_partkey").cast("string"), 256), 1, 20)
    text = F.when(F.col("l_quantity") > 5, F.concat_ws(" ", key, F.col("l_orderkey").cast("string"))).otherwise("# not a key")
    return logs.listed_keys(views.table(spark, sf_dir, "lineitem").select(text.alias("value")))


@query(
    "c2_audit_findings",
    """, k AS (SELECT task, path, bool_or(operation = 'write') AS w, bool_or(operation = 'read') AS r, bool_or(operation = 'list') AS l FROM accesses GROUP BY ALL)
    SELECT * FROM (SELECT task, path, CASE WHEN w AND task % 2 <> CAST(path AS INT) % 2 THEN 'stray-write' WHEN r AND NOT w AND CAST(path AS INT) % 3 <> 0 THEN 'undeclared-read'
        WHEN l AND NOT w AND CAST(path AS INT) % 3 <> 0 THEN 'undeclared-listing' END AS kind FROM k) WHERE kind IS NOT NULL""",
    "accesses",
)
def c2(spark, sf_dir):
    seen = views.accesses(spark, sf_dir)
    return verdicts.audit_findings(seen, seen.where("cast(path AS int) % 3 = 0"), seen.where("task % 2 = cast(path AS int) % 2"))


@query(
    "c5_lookup_verdicts",
    """SELECT task, CASE WHEN bool_or(execution % 97 = 0) THEN 'failed' WHEN min(CASE WHEN cache = 'local-hit' THEN cores + millis % 2 END) = 0 THEN 'declared' WHEN bool_or(cache = 'local-hit') THEN 'hit'
    WHEN bool_or(warm) THEN 'missed' ELSE 'unrecorded' END AS verdict FROM (SELECT * REPLACE (run AS task) FROM exec_log) GROUP BY task""",
    "exec_log",
)
def c5(spark, sf_dir):
    log = views.exec_log(spark, sf_dir)
    found = log.select(F.col("run").alias("task"), (F.col("cores") + F.col("millis") % 2).alias("pos"), (F.col("cache") == "local-hit").alias("found"), F.col("warm").alias("recorded"), (F.col("execution") % 97 == 0).alias("failed"))
    return verdicts.lookup_verdicts(found)


@query("c11_run_outcome", "SELECT run, CAST(CASE WHEN bool_or(status = 'failure') THEN 1 ELSE 0 END AS BIGINT) AS code FROM exec_log GROUP BY run", "exec_log")
def c11(spark, sf_dir):
    return verdicts.run_outcome(views.exec_log(spark, sf_dir))


@query(
    "w10_prefetch_stop",
    """, r AS (SELECT run, execution AS pos, row_number() OVER w AS n, sum(CASE WHEN warm THEN 1 ELSE 0 END) OVER w AS m FROM exec_log WINDOW w AS (PARTITION BY run ORDER BY execution ROWS UNBOUNDED PRECEDING))
    SELECT run, min(pos) AS pos FROM r WHERE n >= 8 AND m < n * 0.5 GROUP BY run""",
    "exec_log",
)
def w10(spark, sf_dir):
    return verdicts.prefetch_stops(views.exec_log(spark, sf_dir).select("run", F.col("execution").alias("pos"), F.col("warm").alias("matched")))


@query(
    "w12_newest_sets",
    """SELECT task, digest, time, place FROM (SELECT task, key AS digest, max(started) AS time, row_number() OVER (PARTITION BY task ORDER BY max(started) DESC, key) AS place FROM exec_log WHERE key IS NOT NULL GROUP BY task, key) WHERE place <= 8""",
    "exec_log",
)
def w12(spark, sf_dir):
    return verdicts.newest_sets(views.exec_log(spark, sf_dir).where("key IS NOT NULL").select("task", F.col("key").alias("digest"), F.col("started").alias("time")))


@query("a9_doctor_counts", "SELECT count(*) FILTER (WHERE tag = 'SMALL') AS errors, count(*) FILTER (WHERE tag = 'LARGE') AS warnings, count(DISTINCT root) AS targets FROM catalog", "catalog")
def a9(spark, sf_dir):
    level = F.when(F.col("tag") == "SMALL", "error").when(F.col("tag") == "LARGE", "warning")
    return verdicts.doctor_counts(views.catalog(spark, sf_dir).select(F.col("root").alias("target"), level.alias("level")))


@query(
    "a13_peaks",
    "SELECT run, CAST(max(total) AS BIGINT) AS peak FROM (SELECT run, started // 86400000 AS tick, sum(memory) AS total FROM exec_log WHERE memory IS NOT NULL GROUP BY ALL) GROUP BY run",
    "exec_log",
)
def a13(spark, sf_dir):
    """The peak of a run's sums per tick; a day is a tick."""
    ticks = views.exec_log(spark, sf_dir).where("memory IS NOT NULL").groupBy("run", F.expr("started div 86400000").alias("tick")).agg(F.sum("memory").alias("total"))
    return ticks.groupBy("run").agg(F.max("total").alias("peak"))


@query("o6_newest_tasks", "SELECT task, max(started) AS updated FROM exec_log GROUP BY task ORDER BY updated DESC, task LIMIT 12", "exec_log")
def o6(spark, sf_dir):
    return views.exec_log(spark, sf_dir).groupBy("task").agg(F.max("started").alias("updated")).orderBy(F.desc("updated"), "task").limit(12)


@query(
    "f20_environment",
    """, e AS (SELECT p_partkey, ['PATH', 'APP_' || p_size, 'SECRET_' || p_type, 'CI'] AS names FROM part)
    SELECT p_partkey AS id, array_to_string(list_sort(list_filter(names, lambda x: (x = 'CI' OR starts_with(x, 'APP_') OR starts_with(x, 'SECRET')) AND NOT (starts_with(x, 'SECRET_S') OR x = 'PATH'))), ',') AS names FROM e""",
)
def f20(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    variables = F.map_from_arrays(F.array(F.lit("PATH"), F.concat(F.lit("APP_"), size), F.concat(F.lit("SECRET_"), F.col("p_type")), F.lit("CI")), F.array(F.lit("/bin"), size, F.col("p_type"), F.lit("1")))
    kept = formats.environment(variables, ["CI", "APP_*", "SECRET*"], ["SECRET_S*", "PATH"])
    return part.select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("names"))


@query(
    "f20_task_environment",
    """, e AS (SELECT p_partkey AS id, ['CI', 'PATH', 'APP_' || p_size, 'SECRET_' || p_type] AS names, 'APP_' || p_size AS app, p_partkey % 3 = 0 AS sets, p_partkey % 5 = 0 AS provides, p_partkey % 4 = 0 AS passes FROM part)
    SELECT id, array_to_string(list_sort(list_transform(list_distinct(list_concat(list_filter(names, lambda x: x <> 'PATH' AND NOT starts_with(x, 'SECRET_S') AND (passes OR x <> 'CI')), CASE WHEN sets THEN [app] ELSE [] END,
            CASE WHEN provides THEN ['PATH'] ELSE [] END)), lambda x: x || '=' || CASE WHEN x = app AND sets THEN 'set' WHEN x = 'PATH' THEN '/made' ELSE 'was' END)), ',') AS environment,
        CASE WHEN sets THEN '' ELSE app END AS keyed, array_to_string(list_sort(list_filter(names, lambda x: x = 'PATH' OR starts_with(x, 'SECRET_S') OR (NOT passes AND x = 'CI'))), ',') AS left_out,
        CASE WHEN id % 7 = 0 THEN 'both:' || app ELSE '' END AS errors FROM e""",
)
def f20_task(spark, sf_dir):
    n, kind = F.col("p_partkey"), F.col("p_type")
    app = F.concat(F.lit("APP_"), F.col("p_size").cast("string"))
    held = F.array(F.lit("CI"), F.lit("PATH"), app, F.concat(F.lit("SECRET_"), kind))
    secret = F.when(kind.startswith("S"), "none*").otherwise("SECRET_*")
    found = formats.task_environment(
        F.map_from_arrays(held, F.array_repeat(F.lit("was"), 4)), F.array(F.lit("APP_*")), F.concat(F.array(secret), F.when(n % 4 == 0, F.array(F.lit("C*I"))).otherwise(F.array().cast("array<string>")), F.when(n % 7 == 0, F.array(F.lit("*APP_*"))).otherwise(F.array().cast("array<string>"))),
        F.when(n % 3 == 0, F.create_map(app, F.lit("set"))), F.when(n % 5 == 0, F.create_map(F.lit("PATH"), F.lit("/made"))),
    )
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    rows = views.table(spark, sf_dir, "part").select(n.alias("id"), found.alias("e"))
    pairs = F.transform(F.map_entries("e.environment"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return rows.select("id", listed(pairs).alias("environment"), listed(F.map_keys("e.keyed")).alias("keyed"), listed(F.col("e.left_out")).alias("left_out"), listed(F.col("e.errors")).alias("errors"))


@query(
    "m_size_bytes",
    """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 1 THEN CAST(floor((p_size + 0.5) * 1024) AS BIGINT) WHEN 2 THEN CAST(p_size AS BIGINT) * 1048576 WHEN 3 THEN CAST(floor((p_size + 0.25) * 1073741824) AS BIGINT) END AS bytes FROM part""",
)
def size_bytes(spark, sf_dir):
    n, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(n == 0, size).when(n == 1, F.concat(size, F.lit(".5KB"))).when(n == 2, F.concat(size, F.lit(" mib"))).when(n == 3, F.concat(size, F.lit(".25GB"))).otherwise("many")
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), formats.size_bytes(text).alias("bytes"))


@query("m_duration", "SELECT execution, CASE WHEN millis < 1000 THEN millis || 'ms' WHEN millis < 60000 THEN millis // 1000 || '.' || (millis % 1000) // 100 || 's' ELSE millis // 60000 || 'm ' || (millis // 1000) % 60 || 's' END AS text FROM (SELECT execution, millis * 7 AS millis FROM exec_log)", "exec_log")
def duration(spark, sf_dir):
    return views.exec_log(spark, sf_dir).select("execution", formats.duration_text(F.col("millis") * 7).alias("text"))


@query("s22_graph_json", "SELECT source, '{\"dependencies\":[' || string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) || ']}' AS document FROM edges GROUP BY source", "edges")
def s22(spark, sf_dir):
    return history_store.graph_json(views.edges(spark, sf_dir))


@query(
    "f24_store_packages",
    "SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN '@scope/' ELSE '' END || lower(p_type) AS package FROM part",
)
def f24(spark, sf_dir):
    """Packages of installation keys, with scopes, versions and peers."""
    scope = F.when(F.col("p_partkey") % 2 == 0, "@scope/").otherwise("")
    key = F.concat(scope, F.lower("p_type"), F.lit("@1."), F.col("p_size").cast("string"), F.lit(".0(peer@2.0.0)"))
    return views.table(spark, sf_dir, "part").select(formats.package_of(key).alias("package")).distinct()


@query(
    "j21_warm_choice",
    """, r AS (SELECT task, execution, cores, warm, started, CASE WHEN cores = 1 THEN 0 WHEN cores IN (2, 3) THEN 1 END AS quality, run % 3 <> 0 AS other, CASE WHEN execution % 4 > 0 THEN execution % 4 END AS behind FROM exec_log WHERE status = 'success')
    SELECT task, execution AS record FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY quality, other, behind NULLS LAST, started DESC, execution) AS place FROM r WHERE quality IS NOT NULL AND (NOT other OR warm)) WHERE place = 1""",
    "exec_log",
)
def j21(spark, sf_dir):
    """The record to start each task from; keys are of one to four parts by cores, worktrees by run."""
    log = views.exec_log(spark, sf_dir)
    key = F.when(F.col("cores") == 4, F.array(F.lit("other"))).otherwise(F.concat(F.array(F.lit("a"), F.lit("b")), F.array_repeat(F.lit("c"), (F.col("cores") - 1).cast("int"))))
    records = log.where("status = 'success'").select(
        "task", F.col("execution").alias("record"), key.alias("key"), F.when(F.col("run") % 3 == 0, "own").otherwise("else").alias("worktree"), F.col("warm").alias("portable"),
        F.when(F.col("execution") % 4 > 0, F.col("execution") % 4).alias("behind"), "started",
    )
    wanted = log.select("task").distinct().select("task", F.array(F.lit("a"), F.lit("b")).alias("key"), F.lit("own").alias("worktree"))
    return storage.warm_choice(records, wanted)


@query(
    "c10_key_match",
    "SELECT execution, CAST(CASE cores WHEN 1 THEN 0 WHEN 4 THEN NULL ELSE 1 END AS BIGINT) AS match FROM exec_log",
    "exec_log",
)
def c10(spark, sf_dir):
    key = F.when(F.col("cores") == 4, F.array(F.lit("other"))).otherwise(F.concat(F.array(F.lit("a"), F.lit("b")), F.array_repeat(F.lit("c"), (F.col("cores") - 1).cast("int"))))
    return views.exec_log(spark, sf_dir).select("execution", verdicts.key_match(F.array(F.lit("a"), F.lit("b")), key).cast("long").alias("match"))


@query(
    "a21_longest_steps",
    """, chains(start, here, total, chain) AS (SELECT id, id, weight, [id] FROM nodes UNION ALL SELECT c.start, n.id, c.total + n.weight, list_append(c.chain, n.id) FROM chains c JOIN edges e ON e.source = c.here JOIN nodes n ON n.id = e.target),
    best AS (SELECT chain FROM chains ORDER BY total DESC, chain LIMIT 1), back AS (SELECT unnest(list_reverse(chain)) AS id, generate_subscripts(chain, 1) - 1 AS position FROM best)
    SELECT CAST(position AS BIGINT) AS position, id, weight FROM back JOIN nodes USING (id) WHERE weight >= 30 ORDER BY weight DESC, position LIMIT 3""",
    "nodes edges",
    recursive=True,
)
def a21(spark, sf_dir):
    """The three heaviest steps of the critical path, in its order."""
    from graphloom.operators.closure import critical_path

    return verdicts.longest_on_path(critical_path(views.nodes(spark, sf_dir), views.edges(spark, sf_dir)), 3, 30)


@query("w7_ranks", "SELECT entry, row_number() OVER (ORDER BY used, entry) AS rank FROM entries", "entries")
def ranks(spark, sf_dir):
    return storage.ranked(views.entries(spark, sf_dir).select("entry", "used"), "used", "entry").select("entry", "rank")
