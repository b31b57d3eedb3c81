"""Queries about what changed between two states of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import locate
from graphloom.plans.registry import query
from graphloom.sources import views

CHANGED = """, changes AS (SELECT importer, key, CASE WHEN b.fingerprint IS NULL THEN 'added' WHEN a.fingerprint IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM installs_before b FULL JOIN installs_after a USING (importer, key) WHERE b.fingerprint IS DISTINCT FROM a.fingerprint)"""


def changes(spark, sf_dir):
    return locate.install_changes(views.installs(spark, sf_dir, "O"), views.installs(spark, sf_dir, "F"))


@query("j10_install_diff", CHANGED + " SELECT importer, key, change FROM changes", "installs_before installs_after")
def j10(spark, sf_dir):
    return changes(spark, sf_dir)


@query(
    "a23_package_moves",
    CHANGED
    + """, counts AS (SELECT key, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'changed') AS changed FROM changes GROUP BY key)
    SELECT *, CASE WHEN added > 0 AND removed > 0 THEN 'moved' WHEN added > 0 THEN 'added' WHEN removed > 0 THEN 'removed' ELSE 'changed' END AS kind,
        key IN (SELECT s_suppkey * 7 FROM supplier) AS direct FROM counts""",
    "installs_before installs_after",
)
def a23(spark, sf_dir):
    direct = views.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7).alias("key"))
    return locate.package_moves(changes(spark, sf_dir), direct)


@query(
    "a23_package_report",
    CHANGED
    + """, k AS (SELECT CASE WHEN key % 2 = 0 THEN '@' ELSE '' END || 'p' || key // 6 AS name, CAST(CASE WHEN key % 3 = 2 THEN 0 ELSE key % 3 END AS VARCHAR) AS version, change FROM changes),
    g AS (SELECT name, list_sort(list(DISTINCT version) FILTER (WHERE change = 'removed')) AS b, list_sort(list(DISTINCT version) FILTER (WHERE change = 'added')) AS a FROM k GROUP BY name),
    t AS (SELECT name, coalesce(array_to_string(b, ','), '') AS before, coalesce(array_to_string(a, ','), '') AS after FROM g)
    SELECT name, name IN (SELECT 'p' || s_suppkey FROM supplier) AS direct, before, after, CASE WHEN before = '' AND after = '' THEN 'dependencies' WHEN before = '' THEN 'added' WHEN after = '' THEN 'removed' WHEN before = after THEN 'peers' ELSE 'moved' END AS kind,
        CASE WHEN before = '' AND after = '' THEN 3 WHEN before = '' OR after = '' THEN 1 WHEN before = after THEN 2 ELSE 0 END AS rank FROM t""",
    "installs_before installs_after",
)
def a23_report(spark, sf_dir):
    version = F.when(F.col("key") % 3 == 2, "0(q@2.0.0)(@r/s@1)").otherwise((F.col("key") % 3).cast("string"))
    key = F.concat(F.when(F.col("key") % 2 == 0, "@").otherwise(""), F.lit("p"), F.expr("cast(key div 6 AS string)"), F.lit("@"), version)
    direct = views.table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("name"))
    found = locate.package_report(changes(spark, sf_dir).select(key.alias("key"), "change"), direct)
    return found.withColumns({c: F.array_join(c, ",") for c in ("before", "after")})


@query(
    "u6_substitution",
    CHANGED
    + """ SELECT DISTINCT path FROM (SELECT path FROM (SELECT DISTINCT key AS path FROM changes) WHERE path % 3 <> 0
    UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_size % 2 <> p_partkey % 2)""",
    "installs_before installs_after",
)
def u6(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").where("p_partkey % 3 = 0")
    artifacts = part.select(F.col("p_partkey").alias("path"), (F.col("p_size") % 2).cast("long").alias("before"), (F.col("p_partkey") % 2).alias("after"))
    changed = changes(spark, sf_dir).select(F.col("key").alias("path")).distinct()
    return locate.substituted(changed, part.select(F.col("p_partkey").alias("path")), artifacts)


@query(
    "u2_symdiff",
    """SELECT key, 'left' AS side FROM (SELECT key FROM installs_before WHERE importer = 1 EXCEPT SELECT key FROM installs_after WHERE importer = 1)
    UNION ALL SELECT key, 'right' FROM (SELECT key FROM installs_after WHERE importer = 1 EXCEPT SELECT key FROM installs_before WHERE importer = 1)""",
    "installs_before installs_after",
)
def u2(spark, sf_dir):
    of = lambda status: views.installs(spark, sf_dir, status).where("importer = 1").select("key")
    return locate.symmetric_difference(of("O"), of("F"))


@query(
    "u1_reasons",
    """, r AS (SELECT root AS project, 0 AS place, 'path' AS reason, name AS detail FROM catalog WHERE tag = 'SMALL' UNION SELECT root, 1, 'manifest', tag FROM catalog WHERE name LIKE '2%'
        UNION SELECT root, 2, 'lockfile', tag FROM catalog WHERE tag IN ('LARGE', 'PROMO'))
    SELECT project, string_agg(reason || ':' || detail, ';' ORDER BY place, detail) AS reasons FROM r GROUP BY project""",
    "catalog",
)
def u1(spark, sf_dir):
    catalog = views.catalog(spark, sf_dir).withColumn("project", F.col("root"))
    return locate.reasons(
        [
            ("path", catalog.where("tag = 'SMALL'").withColumn("detail", F.col("name"))),
            ("manifest", catalog.where("name LIKE '2%'").withColumn("detail", F.col("tag"))),
            ("lockfile", catalog.where("tag IN ('LARGE', 'PROMO')").withColumn("detail", F.col("tag"))),
        ]
    )


DEPS = """, deps AS (SELECT p_partkey AS project, CASE p_size % 4 WHEN 0 THEN 'dependencies' WHEN 1 THEN 'devDependencies' WHEN 2 THEN 'peerDependencies' ELSE 'optionalDependencies' END AS section,
        'pkg' || (p_partkey % 50) AS name, CASE p_partkey % 3 WHEN 0 THEN '^1.0.0' WHEN 1 THEN '~1.2.0' ELSE '*' END AS range FROM part),
    packages AS (SELECT 'pkg' || (s_suppkey % 60) AS name, s_suppkey AS project, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS path, '1.' || (s_suppkey % 4) || '.0' AS version, s_suppkey % 4 AS minor FROM supplier),
    last AS (SELECT name, arg_max(project, path) AS target, arg_max(version, path) AS version, arg_max(minor, path) AS minor FROM packages {where} GROUP BY name)"""
LINKS = " SELECT project AS source, target, version, range FROM deps JOIN last USING (name) WHERE project <> target AND (range IN ('*', '^1.0.0') OR minor = 2)"


def links(spark, sf_dir, condition="true"):
    part, supplier = views.table(spark, sf_dir, "part"), views.table(spark, sf_dir, "supplier").where(condition)
    sections = F.array(*map(F.lit, ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")))
    ranges = F.array(*map(F.lit, ("^1.0.0", "~1.2.0", "*")))
    deps = part.select(
        F.col("p_partkey").alias("project"), F.get(sections, F.col("p_size") % 4).alias("section"),
        F.concat(F.lit("pkg"), (F.col("p_partkey") % 50).cast("string")).alias("name"), F.get(ranges, (F.col("p_partkey") % 3).cast("int")).alias("range"),
    )
    packages = supplier.select(
        F.concat(F.lit("pkg"), (F.col("s_suppkey") % 60).cast("string")).alias("name"), F.col("s_suppkey").alias("project"),
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("path"), F.concat(F.lit("1."), (F.col("s_suppkey") % 4).cast("string"), F.lit(".0")).alias("version"),
    )
    return locate.resolved_links(deps, packages)


@query("j1_links", DEPS.format(where="") + LINKS)
def j1(spark, sf_dir):
    return links(spark, sf_dir)


@query(
    "j11_relinked",
    DEPS.format(where="") + ", head AS (" + LINKS + ")"
    + """, last2 AS (SELECT name, arg_max(project, path) AS target, arg_max(minor, path) AS minor FROM packages WHERE project % 5 <> 0 GROUP BY name),
    base AS (SELECT project AS source, target FROM deps JOIN last2 USING (name) WHERE project <> target AND (range IN ('*', '^1.0.0') OR minor = 2))
    SELECT coalesce(h.source, b.source) AS source, h.target AS after, b.target AS before FROM head h FULL JOIN base b USING (source) WHERE h.target IS DISTINCT FROM b.target""",
)
def j11(spark, sf_dir):
    """Projects whose dependency resolves elsewhere than before; before, every fifth package was absent."""
    head = links(spark, sf_dir).select("source", F.col("target").alias("after"))
    base = links(spark, sf_dir, "s_suppkey % 5 <> 0").select("source", F.col("target").alias("before"))
    return head.join(base, "source", "full_outer").where(~F.col("after").eqNullSafe(F.col("before"))).select("source", "after", "before")
