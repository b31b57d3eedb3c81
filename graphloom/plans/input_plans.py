"""Queries over task inputs, layers and filtered closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import inputs, tasks
from graphloom.plans.registry import query
from graphloom.sources import views


@query(
    "m_layered_merge",
    """, l AS (SELECT p_partkey AS project, ['a', 'b' || (p_size % 3)] AS one, CASE WHEN p_partkey % 2 = 0 THEN ['x', '...'] END AS two, CASE WHEN p_partkey % 3 = 0 THEN ['...', 'y', '...'] WHEN p_partkey % 3 = 1 THEN ['z'] END AS three FROM part),
    m AS (SELECT project, CASE WHEN two IS NULL THEN one ELSE list_concat(['x'], one) END AS base, three FROM l)
    SELECT project, array_to_string(CASE WHEN three IS NULL THEN base WHEN len(three) = 1 THEN three ELSE list_concat(list_concat(base, ['y']), base) END, ',') AS items FROM m""",
)
def layered(spark, sf_dir):
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("project"), "p_size")
    put = lambda rows, layer, items: rows.select("project", F.lit("inputs").alias("field"), F.lit(layer).alias("layer"), items.alias("items"))
    texts = lambda *x: F.array(*map(F.lit, x))
    layers = put(part, 1, F.array(F.lit("a"), F.concat(F.lit("b"), (F.col("p_size") % 3).cast("string")))).union(put(part.where("project % 2 = 0"), 2, texts("x", "...")))
    layers = layers.union(put(part.where("project % 3 = 0"), 3, texts("...", "y", "..."))).union(put(part.where("project % 3 = 1"), 3, texts("z")))
    return inputs.merged_layers(layers).select("project", F.array_join("items", ",").alias("items"))


@query(
    "u5_declared_wins",
    """, d AS (SELECT DISTINCT user_id AS task, event_type AS kind, CAST(event_id % 50 AS VARCHAR) AS value FROM events WHERE event_id % 9 = 0),
    i AS (SELECT DISTINCT user_id AS task, event_type AS kind, CAST(event_id % 50 AS VARCHAR) AS value FROM events WHERE event_id % 9 <> 0)
    SELECT *, 'declared' AS origin FROM d UNION ALL SELECT *, 'inferred' FROM i WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.task = i.task AND d.kind = i.kind)""",
)
def u5(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("task"), F.col("event_type").alias("kind"), (F.col("event_id") % 50).cast("string").alias("value"))
    return inputs.joined_inputs(rows.where("event_id % 9 = 0"), rows.where("event_id % 9 <> 0"))


@query(
    "j8_changed_inputs",
    "SELECT l_suppkey AS task, l_partkey AS path, bool_or(l_linestatus = 'O') AS whole FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY ALL",
)
def j8(spark, sf_dir):
    items = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), F.col("l_partkey").alias("path"), (F.col("l_linestatus") == "O").alias("whole"))
    return inputs.changed_inputs(items, views.table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("path")))


@query(
    "c8_glob_verdict",
    """, o AS (SELECT s_suppkey AS dependency, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey % 3 = 1 END AS built, s_suppkey % 14 = 1 AS selected FROM supplier)
    SELECT task, CASE WHEN count(built) = 0 THEN 'no-declared-outputs' WHEN bool_or(selected) THEN 'some' WHEN NOT bool_or(built) THEN 'not-built' ELSE 'none' END AS verdict
    FROM (SELECT DISTINCT l_orderkey AS task, l_suppkey AS dependency FROM lineitem) g JOIN o USING (dependency) GROUP BY task""",
)
def c8(spark, sf_dir):
    n = F.col("s_suppkey")
    outputs = views.table(spark, sf_dir, "supplier").select(n.alias("dependency"), F.when(n % 3 != 0, n % 3 == 1).alias("built"), (n % 14 == 1).alias("selected"))
    globs = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("dependency")).distinct()
    return inputs.glob_verdicts(globs, outputs)


@query(
    "g23_process_totals",
    """, tree(root, id) AS (SELECT id, id FROM nodes WHERE id BETWEEN 2 AND 9 UNION SELECT t.root, n.id FROM tree t JOIN nodes n ON n.id // 2 = t.id AND n.id > 1)
    SELECT root AS id, CAST(sum(weight) AS BIGINT) AS memory FROM tree JOIN nodes USING (id) GROUP BY root""",
    "nodes",
    recursive=True,
)
def g23(spark, sf_dir):
    nodes = views.nodes(spark, sf_dir)
    processes = nodes.select("id", F.when(F.col("id") > 1, F.expr("id div 2")).alias("parent"), F.col("weight").alias("memory"))
    return inputs.process_totals(nodes.where("id BETWEEN 2 AND 9").select("id"), processes)


SERVERS = """, reach(start, id) AS (SELECT id, id FROM nodes WHERE id % 50 = 23 UNION SELECT r.start, e.target FROM reach r JOIN edges e ON e.source = r.id WHERE {counting}) SELECT start AS task, id AS dependency FROM reach WHERE id <> start"""


@query("g18_closures", SERVERS.format(counting="true"), "nodes edges", recursive=True)
def g18(spark, sf_dir):
    """All that some tasks depend on, themselves left out."""
    starts = views.nodes(spark, sf_dir).where("id % 50 = 23").select(F.col("id").alias("task"))
    edges = views.edges(spark, sf_dir).select(F.col("source").alias("task"), F.col("target").alias("dependency"))
    return tasks.output_dependencies(starts, edges, transitive=True)


@query("g19_servers", SERVERS.format(counting="(e.source + e.target) % 3 <> 1"), "nodes edges", recursive=True)
def g19(spark, sf_dir):
    """The same over edges that count as inputs alone."""
    starts = views.nodes(spark, sf_dir).where("id % 50 = 23").select(F.col("id").alias("task"))
    counting = views.edges(spark, sf_dir).where("(source + target) % 3 <> 1").select(F.col("source").alias("task"), F.col("target").alias("dependency"))
    return tasks.output_dependencies(starts, counting, transitive=True)


@query("g9_direct_outputs", "SELECT e.source AS task, e.target AS dependency FROM edges e WHERE e.source % 50 = 23", "edges")
def g9(spark, sf_dir):
    starts = views.nodes(spark, sf_dir).where("id % 50 = 23").select(F.col("id").alias("task"))
    return tasks.output_dependencies(starts, views.edges(spark, sf_dir).select(F.col("source").alias("task"), F.col("target").alias("dependency")), transitive=False)
