"""Queries over paths, selectors, accesses and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import documents, semver
from graphloom.operators import accesses, locate, selection
from graphloom.plans.registry import query
from graphloom.sources import views
from graphloom.streaming import watch

GLOBS = ["*.example.com/en/**", "www.*/**/[0-9]*", "m.*/{de,fr}/*", "**/*.html"]
#: The same, as regular expressions written by hand.
REGEXES = ["^[^/]*[.]example[.]com/en/([^/]+/)*[^/]+$", "^www[.][^/]*/([^/]+/)*[0-9][^/]*$", "^m[.][^/]*/(de|fr)/[^/]*$", "^([^/]+/)*[^/]*[.]html$"]
MATCHED = " UNION ALL ".join(f"SELECT '{g}' AS pattern, path FROM paths WHERE regexp_matches(path, '{r}')" for g, r in zip(GLOBS, REGEXES, strict=True))


@query(
    "f11_owner",
    """SELECT p.page_id, p.path, coalesce((SELECT root FROM roots r WHERE p.path = r.root OR starts_with(p.path, r.root || '/') ORDER BY length(root) DESC LIMIT 1), '.') AS owner FROM paths p""",
    "paths roots",
)
def f11(spark, sf_dir):
    return locate.owners(views.paths(spark, sf_dir), views.roots(spark, sf_dir)).select("page_id", "path", "owner")


@query("j5_file_glob", MATCHED, "paths")
def j5(spark, sf_dir):
    return locate.selected(views.paths(spark, sf_dir), GLOBS)


@query("j6_include_minus_exclude", f"SELECT pattern, path FROM ({MATCHED}) WHERE NOT regexp_matches(path, '^([^/]+/)*[^/]*5[^/]*$')", "paths")
def j6(spark, sf_dir):
    return locate.selected(views.paths(spark, sf_dir), GLOBS, ["**/*5*"])


@query("j9_first_match", f"SELECT pattern, min(path) AS path FROM ({MATCHED}) GROUP BY pattern", "paths")
def j9(spark, sf_dir):
    return locate.first_match(views.paths(spark, sf_dir), GLOBS)


@query(
    "g22_topmost_dir",
    """, above AS (SELECT page_id, path, array_to_string(parts[1:n], '/') AS directory, n FROM (SELECT *, string_split(path, '/') AS parts FROM paths), generate_series(1, 9) s(n) WHERE n < len(parts)),
    occupied AS (SELECT DISTINCT directory FROM above WHERE page_id % 4 = 0)
    SELECT directory, count(*) AS files FROM (SELECT path, min_by(directory, n) AS directory FROM above WHERE page_id % 4 <> 0 AND directory NOT IN (SELECT directory FROM occupied) GROUP BY path) GROUP BY directory""",
    "paths",
)
def g22(spark, sf_dir):
    paths = views.paths(spark, sf_dir)
    return locate.topmost_directories(paths.where("page_id % 4 <> 0").select("path"), paths.where("page_id % 4 = 0").select("path"))


@query("f3_word", "SELECT name FROM catalog WHERE regexp_matches(name, '(?i)(^|[^@a-zA-Z0-9-])bolt($|[^@a-zA-Z0-9-])')", "catalog")
def f3(spark, sf_dir):
    return views.catalog(spark, sf_dir).where(selection.has_word("name", "BOLT")).select("name")


@query("f5_glob", "SELECT root, name FROM catalog WHERE regexp_matches(root, '^Brand#(1[^/]|2)$')", "catalog")
def f5(spark, sf_dir):
    from graphloom.functions.globs import matches

    return views.catalog(spark, sf_dir).where(matches("root", "Brand#{1?,2}")).select("root", "name")


@query(
    "f1_selectors",
    """SELECT name FROM catalog WHERE ((tag = 'SMALL' OR regexp_matches(root, '^Brand#1[^/]*$')) AND NOT regexp_matches(name, '(?i)(^|[^@a-zA-Z0-9-])ring($|[^@a-zA-Z0-9-])'))
        OR regexp_matches(tag, '^PROM[^/]*$')""",
    "catalog",
)
def f1(spark, sf_dir):
    """The third pattern has no label: it is held against names; the second matches no name and so is held against directories."""
    return selection.select_projects(views.catalog(spark, sf_dir), ["tag:SMALL", "Brand#1*", "!ring", "tag:PROM*"]).select("name")


@query("f4_select_exclude", "SELECT name FROM catalog WHERE tag = 'LARGE' AND NOT regexp_matches(root, '^Brand#[^/]*3$')", "catalog")
def f4(spark, sf_dir):
    chosen = selection.select_projects(views.catalog(spark, sf_dir), ["tag:LARGE"])
    return chosen.join(selection.select_projects(chosen, ["directory:Brand#*3"]).select("name"), "name", "left_anti").select("name")


@query(
    "o4_specificity",
    """, t AS (SELECT DISTINCT root AS executor, tag AS target FROM catalog)
    SELECT executor, target, key FROM (SELECT executor, target, CASE WHEN executor = 'Brand#7' THEN 'Brand#7' WHEN target = 'SMALL' THEN 'SMALL' WHEN starts_with(target, 'STAND') THEN 'STAND*'
        WHEN starts_with(target, 'S') THEN 'S*' END AS key FROM t) WHERE key IS NOT NULL""",
    "catalog",
)
def o4(spark, sf_dir):
    targets = views.catalog(spark, sf_dir).select(F.col("root").alias("executor"), F.col("tag").alias("target")).distinct()
    return selection.by_specificity(targets, ["S*", "SMALL", "STAND*", "Brand#7"])


MEMBERS = """, members AS (SELECT CAST(s_suppkey AS VARCHAR) AS name, 'area' || s_suppkey % 3 || '/m' || s_suppkey AS root, 't' || s_suppkey % 4 AS tag, s_suppkey AS k FROM supplier),
    selectors AS (SELECT CAST(s_suppkey AS VARCHAR) AS source, CASE s_suppkey % 6 WHEN 0 THEN ['tag:t1', '!' || (s_suppkey + 1)] WHEN 1 THEN ['area1/*'] WHEN 2 THEN ['!tag:t2', CAST(s_suppkey // 2 AS VARCHAR)]
        WHEN 3 THEN ['directory:area2/m?', 'nothing*'] WHEN 4 THEN ['*', '!area0/m*'] ELSE [CAST(s_suppkey + 1000 AS VARCHAR)] END AS patterns FROM supplier),
    rules AS (SELECT *, source::BIGINT % 6 AS kind, source::BIGINT AS n FROM selectors)"""


def members(spark, sf_dir):
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    return views.table(spark, sf_dir, "supplier").select(text(k).alias("name"), F.concat(F.lit("area"), text(k % 3), F.lit("/m"), text(k)).alias("root"), F.array(F.concat(F.lit("t"), text(k % 4))).alias("tags"), k.alias("k"))


def selectors(spark, sf_dir):
    n, text = F.col("s_suppkey"), lambda c: c.cast("string")
    lists = [(F.lit("tag:t1"), F.concat(F.lit("!"), text(n + 1))), (F.lit("area1/*"),), (F.lit("!tag:t2"), F.expr("cast(s_suppkey div 2 as string)")), (F.lit("directory:area2/m?"), F.lit("nothing*")), (F.lit("*"), F.lit("!area0/m*")), (text(n + 1000),)]
    chosen = F.coalesce(*(F.when(n % 6 == k, F.array(*found)) for k, found in enumerate(lists)))
    return views.table(spark, sf_dir, "supplier").select(text(n).alias("source"), F.posexplode(chosen).alias("turn", "pattern"))


@query(
    "j3_edges_minus_excluded",
    MEMBERS
    + """, picked AS (SELECT source, name AS target FROM rules, members WHERE CASE kind WHEN 0 THEN tag = 't1' AND k <> n + 1 WHEN 1 THEN starts_with(root, 'area1/') WHEN 2 THEN k = n // 2 AND tag <> 't2'
            WHEN 3 THEN regexp_matches(root, '^area2/m.$') WHEN 4 THEN NOT starts_with(root, 'area0/') ELSE k = n + 1000 END),
        out AS (SELECT source, name AS target FROM rules, members WHERE CASE kind WHEN 0 THEN k = n + 1 WHEN 2 THEN tag = 't2' WHEN 4 THEN starts_with(root, 'area0/') ELSE false END)
    SELECT * FROM (SELECT CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target, 'static' AS kind FROM ring UNION SELECT source, target, 'implicit' FROM picked WHERE source <> target) ANTI JOIN out USING (source, target)""",
    "ring",
)
def j3(spark, sf_dir):
    """Selectors by tag, name, directory and of everything, some of which take away."""
    static = views.ring(spark, sf_dir).select(F.col("source").cast("string"), F.col("target").cast("string"))
    return selection.edges_with_implicit(static, selectors(spark, sf_dir), members(spark, sf_dir))


@query(
    "j4_missing",
    MEMBERS
    + """, most AS (SELECT * FROM members WHERE k % 5 <> 0), each AS (SELECT source, ltrim(unnest(patterns), '!') AS target FROM selectors)
    SELECT source, target FROM each WHERE target = 'nothing*' OR (regexp_matches(target, '^[0-9]+$') AND target NOT IN (SELECT name FROM most)) OR (starts_with(target, 'tag:') AND target NOT IN (SELECT 'tag:' || tag FROM most))
        OR (target = 'directory:area2/m?' AND NOT EXISTS (SELECT 1 FROM most WHERE regexp_matches(root, '^area2/m.$'))) OR (regexp_matches(target, '^area') AND NOT EXISTS (SELECT 1 FROM most WHERE starts_with(root, target[:5])))""",
)
def j4(spark, sf_dir):
    return selection.unknown_names(selectors(spark, sf_dir), members(spark, sf_dir).where("k % 5 <> 0"))


OWN = "coalesce(max(CASE WHEN operation = 'write' THEN 1 ELSE 0 END) OVER (PARTITION BY task, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS own"


@query("w5_written_before_read", f"SELECT task, path, count(*) AS n FROM (SELECT *, {OWN} FROM accesses) WHERE operation = 'read' AND NOT own GROUP BY task, path", "accesses")
def w5(spark, sf_dir):
    return accesses.outside_reads(views.accesses(spark, sf_dir))


@query("w6_generated", f"SELECT seq, task, path FROM (SELECT *, {OWN} FROM accesses) WHERE operation IN ('read', 'metadata', 'list') AND own", "accesses")
def w6(spark, sf_dir):
    return accesses.generated(views.accesses(spark, sf_dir))


@query("a10_distinct_paths", "SELECT left(path, 1) AS package, count(DISTINCT path) AS paths FROM accesses WHERE operation IN ('read', 'metadata', 'list') GROUP BY 1", "accesses")
def a10(spark, sf_dir):
    return accesses.package_paths(views.accesses(spark, sf_dir), F.substring("path", 1, 1))


DECLARED = ", declared AS (SELECT DISTINCT user_id AS task, CAST(event_id % 100 AS VARCHAR) AS path FROM events WHERE event_id % 7 = 0)"


def declared(spark, sf_dir):
    return views.table(spark, sf_dir, "events").where("event_id % 7 = 0").select(F.col("user_id").alias("task"), (F.col("event_id") % 100).cast("string").alias("path")).distinct()


@query(
    "c1_category",
    DECLARED
    + f""" SELECT a.seq, a.task, CASE WHEN operation = 'write' THEN 'output' WHEN own THEN 'generated' WHEN a.path IN (SELECT CAST(s_suppkey * 3 AS VARCHAR) FROM supplier) THEN 'dependency-output'
        WHEN d.task IS NOT NULL THEN 'input' WHEN operation IN ('list', 'metadata') THEN 'discovery' WHEN operation = 'missing' THEN 'resolution' ELSE 'uncovered' END AS category
    FROM (SELECT *, {OWN} FROM accesses) a LEFT JOIN declared d ON d.task = a.task AND d.path = a.path""",
    "accesses",
)
def c1(spark, sf_dir):
    produced = views.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).cast("string").alias("path"))
    return accesses.categories(views.accesses(spark, sf_dir), declared(spark, sf_dir), produced)


@query(
    "u3_unobserved",
    DECLARED
    + """ SELECT task, path FROM declared d WHERE path NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)
        AND NOT EXISTS (SELECT 1 FROM accesses a WHERE a.task = d.task AND a.path = d.path AND operation IN ('read', 'metadata', 'list'))""",
    "accesses",
)
def u3(spark, sf_dir):
    mandatory = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"))
    return accesses.unobserved(declared(spark, sf_dir), mandatory, views.accesses(spark, sf_dir))


@query("u4_merged", "SELECT DISTINCT task, key AS path FROM exec_log WHERE target = 'view' AND status = 'success'", "exec_log")
def u4(spark, sf_dir):
    reports = views.exec_log(spark, sf_dir).select("task", F.col("key").alias("path"), F.col("target").alias("context"), "status")
    return accesses.merged_observations(reports, "view")


@query(
    "a8_pattern_sets",
    """, idle AS (SELECT run AS target, CAST(cores AS VARCHAR) AS pattern FROM exec_log GROUP BY ALL HAVING bool_and(NOT (millis % 3 = 0))),
    sets AS (SELECT target, string_agg(pattern, ',' ORDER BY pattern) AS patterns FROM idle GROUP BY target)
    SELECT patterns, string_agg(CAST(target AS VARCHAR), ',' ORDER BY CAST(target AS VARCHAR)) AS targets FROM sets GROUP BY patterns""",
    "exec_log",
)
def a8(spark, sf_dir):
    rows = views.exec_log(spark, sf_dir).select(F.col("run").cast("string").alias("target"), "task", F.col("cores").cast("string").alias("pattern"), (F.col("millis") % 3 == 0).alias("selects"))
    return accesses.pattern_sets(rows)


@query("k1_canonical_digest", """SELECT event_id, sha256('{"a":' || json_extract_string(props, '$.k') || ',"z":{"b":1,"k":"' || event_type || '"}}') AS digest FROM events""")
def k1(spark, sf_dir):
    events = views.table(spark, sf_dir, "events")
    text = F.concat(F.lit('{ "z": {"k": "'), "event_type", F.lit('", "b": 1}, "a": '), F.get_json_object("props", "$.k"), F.lit("}"))
    return events.select("event_id", documents.digest(text).alias("digest"))


@query(
    "k2_key_diff",
    """, keys AS (SELECT *, lag(key) OVER w AS old_key, lag(cores) OVER w AS old_cores, lag(status) OVER w AS old_status, row_number() OVER w AS n FROM exec_log WINDOW w AS (PARTITION BY task ORDER BY started, execution))
    SELECT execution, concat_ws(',', CASE WHEN key IS DISTINCT FROM old_key THEN 'files' END, CASE WHEN cores IS DISTINCT FROM old_cores THEN 'env' END,
        CASE WHEN status IS DISTINCT FROM old_status THEN 'configuration' END) AS changed FROM keys WHERE n > 1""",
    "exec_log",
)
def k2(spark, sf_dir):
    """Which groups of a key's inputs differ from the task's previous execution; columns stand in for groups."""
    from pyspark.sql import Window

    order = Window.partitionBy("task").orderBy("started", "execution")
    groups = {"files": "key", "env": "cores", "configuration": "status"}
    rows = views.exec_log(spark, sf_dir).select("execution", F.row_number().over(order).alias("n"), *(F.when(~F.col(c).eqNullSafe(F.lag(c).over(order)), F.lit(g)).alias(g) for g, c in groups.items()))
    return rows.where("n > 1").select("execution", F.concat_ws(",", *groups).alias("changed"))


@query(
    "s1_semver",
    """, v AS (SELECT DISTINCT p_size % 3 AS a, p_partkey % 5 AS b, p_size % 7 AS c FROM part)
    SELECT a || '.' || b || '.' || c AS version, r AS wanted, CASE r WHEN '^1.2.0' THEN a = 1 AND (b, c) >= (2, 0) WHEN '~2.1.3' THEN a = 2 AND b = 1 AND c >= 3 WHEN '1.x' THEN a = 1
        WHEN '>=1.3.0 <2.2.0' THEN (a, b, c) >= (1, 3, 0) AND (a, b, c) < (2, 2, 0) WHEN '0.2.1 - 1.1.0' THEN (a, b, c) >= (0, 2, 1) AND (a, b, c) <= (1, 1, 0)
        WHEN '^0.3.1 || 2.0.0' THEN (a = 0 AND b = 3 AND c >= 1) OR (a, b, c) = (2, 0, 0) ELSE false END AS satisfied
    FROM v, (SELECT unnest(['^1.2.0', '~2.1.3', '1.x', '>=1.3.0 <2.2.0', '0.2.1 - 1.1.0', '^0.3.1 || 2.0.0', 'none of this']) AS r)""",
)
def s1(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    version = F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_partkey") % 5).cast("string"), (F.col("p_size") % 7).cast("string"))
    ranges = ["^1.2.0", "~2.1.3", "1.x", ">=1.3.0 <2.2.0", "0.2.1 - 1.1.0", "^0.3.1 || 2.0.0", "none of this"]
    pairs = part.select(version.alias("version")).distinct().withColumn("wanted", F.explode(F.array(*map(F.lit, ranges))))
    return semver.with_satisfies(pairs, "version", "wanted")


@query(
    "s1_newest_within",
    """, v AS (SELECT DISTINCT p_brand AS name, p_size % 3 AS a, p_partkey % 5 AS b, p_size % 7 AS c FROM part),
    w AS (SELECT name, range, CASE range WHEN '^1.2.0' THEN a = 1 AND (b, c) >= (2, 0) WHEN '~2.1' THEN a = 2 AND b = 1 WHEN '<2.2.5-rc.1' THEN (a, b, c) < (2, 2, 5) WHEN '<0.1 || 1.0.x' THEN (a = 0 AND b = 0) OR (a = 1 AND b = 0)
        ELSE false END AS held, a, b, c FROM v, (SELECT unnest(['^1.2.0', '~2.1', '<2.2.5-rc.1', '<0.1 || 1.0.x', 'none of this']) AS range))
    SELECT name, range, CASE WHEN bool_or(held) THEN max(CASE WHEN held THEN (a, b, c) END)[1] || '.' || max(CASE WHEN held THEN (a, b, c) END)[2] || '.' || max(CASE WHEN held THEN (a, b, c) END)[3] END AS version FROM w GROUP BY name, range""",
)
def s1_newest(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    version = F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_partkey") % 5).cast("string"), (F.col("p_size") % 7).cast("string"))
    ranges = ["^1.2.0", "~2.1", "<2.2.5-rc.1", "<0.1 || 1.0.x", "none of this"]
    wanted = part.select(F.col("p_brand").alias("name")).distinct().withColumn("range", F.explode(F.array(*map(F.lit, ranges))))
    return semver.newest_within(wanted, part.select(F.col("p_brand").alias("name"), version.alias("version")))


@query(
    "d1_json_diff",
    """, d AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS t FROM events)
    SELECT event_id, 'Modified' AS kind, 'k' AS path, k AS before, CAST(CAST(k AS INT) + 1 AS VARCHAR) AS after FROM d
    UNION ALL SELECT event_id, 'Added', 'more', NULL, '[1,"' || t || '"]' FROM d
    UNION ALL SELECT event_id, 'Modified', 'in', '{"a":1,"b":2}', '{"a":1,"b":3}' FROM d UNION ALL SELECT event_id, 'Modified', 'in.b', '2', '3' FROM d""",
)
def d1(spark, sf_dir):
    from graphloom.session import importable

    importable(spark)
    events = views.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    before = F.concat(F.lit('{"in": {"a": 1, "b": 2}, "k": '), k, F.lit("}"))
    after = F.concat(F.lit('{"k": '), (k.cast("int") + 1).cast("string"), F.lit(', "in": {"b": 3, "a": 1}, "more": [1, "'), "event_type", F.lit('"]}'))
    rows = events.select("event_id", before.alias("b"), after.alias("a"))
    return rows.lateralJoin(documents.JsonDiff(F.col("b").outer(), F.col("a").outer())).select("event_id", "kind", "path", "before", "after")


@query(
    "t1_session_gap",
    """, gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS batch FROM gaps)
    SELECT user_id, epoch_us(min(ts)) // 1000 AS first_ms, count(*) AS n FROM numbered GROUP BY user_id, batch""",
)
def t1(spark, sf_dir):
    """The batch twin of the watch stream: paths of a user within an hour of each other are one batch."""
    return watch.session_batches(views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "1 hour")


@query(
    "t1_capped_batches",
    """, e AS (SELECT user_id AS watcher, json_extract_string(props, '$.k') AS path, epoch_us(ts) // 1000 AS t0, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, json_extract_string(props, '$.k')) AS n FROM events),
    s(watcher, n, first, deadline, paths, batch) AS (SELECT watcher, n, t0, t0 + 3600000, [path], 1 FROM e WHERE n = 1
        UNION ALL SELECT e.watcher, e.n, CASE WHEN e.t0 >= s.deadline THEN e.t0 ELSE s.first END,
            CASE WHEN e.t0 >= s.deadline THEN e.t0 + 3600000 WHEN list_contains(s.paths, e.path) THEN s.deadline ELSE least(e.t0 + 3600000, s.first + 21600000) END,
            CASE WHEN e.t0 >= s.deadline THEN [e.path] WHEN list_contains(s.paths, e.path) THEN s.paths ELSE list_append(s.paths, e.path) END, s.batch + CASE WHEN e.t0 >= s.deadline THEN 1 ELSE 0 END
        FROM s JOIN e ON e.watcher = s.watcher AND e.n = s.n + 1)
    SELECT watcher, first, max(len(paths)) AS paths FROM s GROUP BY watcher, batch, first""",
    recursive=True,
)
def t1_capped(spark, sf_dir):
    """Batches that only a new path extends and that end after six hours at most; the same state machine as the stream's."""
    events = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("watcher"), F.get_json_object("props", "$.k").alias("path"), views.millis("ts").alias("at"))
    return watch.capped_batches(events, gap=3_600_000, cap=21_600_000)


@query(
    "t3_samples",
    """SELECT user_id, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) // 1000 AS window_ms, max(value) AS peak FROM events GROUP BY ALL""",
)
def t3(spark, sf_dir):
    """Peaks of samples in tumbling windows."""
    return watch.window_peaks(views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "value", "6 hours")
