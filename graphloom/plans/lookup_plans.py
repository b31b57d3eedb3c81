"""Queries over path sets, their keys and what lookups by them give."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import pathsets
from graphloom.plans.registry import query
from graphloom.sources import views

KEYS = """, sets AS (SELECT DISTINCT 'w' || l_orderkey // 2 AS weak, CASE l_linestatus WHEN 'O' THEN 'here' ELSE 'there' END AS place, CAST(l_linenumber AS BIGINT) AS pos, l_returnflag AS kind, CAST(l_partkey AS VARCHAR) AS path FROM lineitem),
    seen AS (SELECT s.*, p_partkey % 13 = 0 AS bad, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN p_partkey % 13 = 0 THEN 'unkeyed' ELSE '=' || p_name END AS state
        FROM sets s LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 <> 0) p ON p.p_partkey = CAST(path AS BIGINT)),
    leaves AS (SELECT *, sha256(length(kind) || ':' || kind || length(path) || ':' || path) AS leaf, sha256(length(kind) || ':' || kind || length(path) || ':' || path || length(state) || ':' || state) AS full_leaf FROM seen),
    low AS (SELECT weak, place, pos, left(leaf, 4) AS b, sha256(string_agg(DISTINCT leaf, '' ORDER BY leaf)) AS d, sha256(string_agg(DISTINCT full_leaf, '' ORDER BY full_leaf)) AS f, bool_or(coalesce(bad, false)) AS bad FROM leaves GROUP BY ALL),
    middle AS (SELECT weak, place, pos, left(b, 2) AS b, sha256(string_agg(DISTINCT d, '' ORDER BY d)) AS d, sha256(string_agg(DISTINCT f, '' ORDER BY f)) AS f, bool_or(bad) AS bad FROM low GROUP BY ALL),
    top AS (SELECT weak, place, pos, sha256(string_agg(DISTINCT d, '' ORDER BY d)) AS digest, sha256(string_agg(DISTINCT f, '' ORDER BY f)) AS f, bool_or(bad) AS bad FROM middle GROUP BY ALL),
    keys AS (SELECT weak, place, pos, digest, CASE WHEN NOT bad THEN sha256(length(weak) || ':' || weak || '64:' || digest || '64:' || f) END AS strong FROM top)"""


def keys(spark, sf_dir):
    read = views.table(spark, sf_dir, "lineitem")
    sets = read.select(
        F.expr("concat('w', l_orderkey div 2)").alias("weak"), F.when(F.col("l_linestatus") == "O", "here").otherwise("there").alias("place"), F.col("l_linenumber").cast("long").alias("pos"),
        F.col("l_returnflag").alias("kind"), F.col("l_partkey").cast("string").alias("path"),
    )
    part = views.table(spark, sf_dir, "part").where("p_partkey % 5 <> 0")
    return pathsets.strong_keys(sets, part.select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_name")).alias("value")))


@query("k3_strong_keys", KEYS + " SELECT * FROM keys")
def strong(spark, sf_dir):
    return keys(spark, sf_dir)


@query(
    "c5_recorded_verdicts",
    KEYS
    + """, results AS (SELECT strong AS key, bool_or(left(strong, 1) < '3') AS here, bool_or(left(strong, 1) BETWEEN '3' AND '5') AS there FROM keys WHERE left(strong, 1) < '6' GROUP BY ALL
        UNION ALL SELECT 'd' || n, n % 4 = 0, n % 4 = 1 FROM (SELECT DISTINCT o_orderkey % 50 AS n FROM orders) WHERE n % 4 < 2),
    firsts AS (SELECT weak, digest, min((place <> 'here', pos)) AS o, max(strong) AS strong FROM keys GROUP BY ALL),
    turns AS (SELECT *, row_number() OVER (PARTITION BY weak ORDER BY o, digest) AS turn FROM firsts),
    found AS (SELECT weak, count(*) AS sets, count(*) FILTER (NOT o[1]) AS sets_here, arg_min(strong, turn) FILTER (r.here AND NOT o[1]) AS own, arg_min(strong, turn) FILTER (r.here) AS local,
        arg_min(strong, turn) FILTER (r.there) AS remote FROM turns LEFT JOIN results r ON r.key = strong WHERE turn <= 8 GROUP BY weak),
    tasks AS (SELECT o_orderkey AS task, 'w' || o_orderkey // 2 AS weak, o_orderkey % 7 <> 0 AS on_, o_orderkey % 10 = 0 AS cold, 'd' || o_orderkey % 50 AS declared, o_orderkey % 3 = 0 AS covered, o_orderkey % 17 = 0 AS unkeyable,
        CASE o_orderkey % 5 WHEN 0 THEN 'saved' WHEN 1 THEN 'refused' WHEN 2 THEN 'unsaved' WHEN 3 THEN 'unkept' END AS ran FROM orders),
    asked AS (SELECT t.*, coalesce(sets, 0) AS sets, coalesce(sets_here, 0) AS sets_here, own, local, remote, coalesce(r.here, false) AS dh, coalesce(r.there, false) AS dt, coalesce(sets_here, 0) > 0 OR NOT coalesce(r.here, false) AS asks
        FROM tasks t LEFT JOIN found USING (weak) LEFT JOIN results r ON r.key = declared),
    judged AS (SELECT *, CASE WHEN on_ AND NOT cold AND asks THEN sets ELSE sets_here END > 0 AS had, CASE WHEN on_ AND NOT cold AND NOT unkeyable THEN coalesce(own, CASE WHEN asks THEN coalesce(local, remote) END) END AS hit FROM asked),
    taken AS (SELECT *, NOT cold AND (dh OR dt) AND (NOT on_ OR NOT had OR covered) AS under FROM judged)
    SELECT task, CASE WHEN unkeyable AND on_ THEN 'failed' WHEN unkeyable THEN CASE WHEN NOT under AND ran = 'refused' THEN 'failed' END WHEN hit IS NOT NULL THEN 'hit'
        WHEN under THEN CASE WHEN on_ THEN CASE WHEN had THEN 'declared' ELSE 'unrecorded' END END WHEN ran = 'saved' THEN 'saved' WHEN ran IN ('refused', 'unsaved') THEN 'failed'
        WHEN on_ THEN CASE WHEN had THEN 'missed' ELSE 'unrecorded' END END AS verdict, CASE WHEN hit IS NOT NULL THEN hit WHEN under THEN declared END AS key FROM taken""",
)
def c5_recorded(spark, sf_dir):
    """All six verdicts, by lookups through path sets and declared keys."""
    from graphloom.session import checkpointed

    found = checkpointed(keys(spark, sf_dir))
    n = F.col("o_orderkey")
    orders = views.table(spark, sf_dir, "orders")
    results = found.where("left(strong, 1) < '6'").select(F.col("strong").alias("key"), F.when(F.expr("left(strong, 1) < '3'"), "here").otherwise("there").alias("place")).unionByName(
        orders.select((n % 50).alias("n")).distinct().where("n % 4 < 2").select(F.concat(F.lit("d"), "n").alias("key"), F.when(F.col("n") % 4 == 0, "here").otherwise("there").alias("place"))
    )
    ran = F.element_at(F.array(*(F.lit(x) for x in ("saved", "refused", "unsaved", "unkept", None))), (n % 5 + 1).cast("int"))
    tasks = orders.select(
        n.alias("task"), F.expr("concat('w', o_orderkey div 2)").alias("weak"), F.when(n % 7 != 0, "on").otherwise("record").alias("mode"), (n % 10 == 0).alias("cold"), F.concat(F.lit("d"), n % 50).alias("declared"),
        (n % 3 == 0).alias("covered"), (n % 17 == 0).alias("unkeyable"), ran.alias("ran"),
    )
    return pathsets.recorded_verdicts(tasks, found, results)
