"""Queries over the dependency graph of parts (nodes, edges) and the cyclic ring of suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import closure, history, schedule
from graphloom.plans.registry import query
from graphloom.session import checkpointed
from graphloom.sources import views

UP = """, reach(id) AS (SELECT id FROM nodes WHERE id IN (7, 11) UNION SELECT e.source FROM reach r JOIN edges e ON e.target = r.id)"""
#: As SQL: every chain that ends in a part, with its weight, from its end down.
CHAINS = """, chains(start, here, total, chain) AS (SELECT id, id, weight, [id] FROM nodes
    UNION ALL SELECT c.start, n.id, c.total + n.weight, list_append(c.chain, n.id) FROM chains c JOIN edges e ON e.{near} = c.here JOIN nodes n ON n.id = e.{far})"""
TOUCHED = "id % 97 = 5"


def seeds(spark, sf_dir, condition="id IN (7, 11)"):
    return views.nodes(spark, sf_dir).where(condition).select("id")


@query(
    "g1_dependents",
    """, reach(id, depth) AS (SELECT id, 0 FROM nodes WHERE id IN (7, 11) UNION SELECT e.source, r.depth + 1 FROM reach r JOIN edges e ON e.target = r.id)
    SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM reach GROUP BY id""",
    "nodes edges",
    recursive=True,
)
def g1(spark, sf_dir):
    return closure.reachable(seeds(spark, sf_dir), views.edges(spark, sf_dir))


@query("g1_by_doubling", UP + " SELECT id FROM reach", "nodes edges", recursive=True)
def g1_doubling(spark, sf_dir):
    return closure.reachable_by_doubling(seeds(spark, sf_dir), views.edges(spark, sf_dir)).select("id")


@query("g1_cyclic", """, reach(id) AS (SELECT 3 AS id UNION SELECT g.target FROM reach r JOIN ring g ON g.source = r.id) SELECT CAST(id AS BIGINT) AS id FROM reach""", "ring", recursive=True)
def g1_cyclic(spark, sf_dir):
    return closure.reachable(spark.createDataFrame([(3,)], "id long"), views.ring(spark, sf_dir), dependents=False).select("id")


@query(
    "g2_related",
    """, up(id) AS (SELECT CAST(12 AS BIGINT) UNION SELECT e.source FROM up r JOIN edges e ON e.target = r.id),
    down(id) AS (SELECT CAST(12 AS BIGINT) UNION SELECT e.target FROM down r JOIN edges e ON e.source = r.id)
    SELECT id FROM up UNION SELECT id FROM down""",
    "edges",
    recursive=True,
)
def g2(spark, sf_dir):
    seed, edges = spark.createDataFrame([(12,)], "id long"), views.edges(spark, sf_dir)
    return closure.reachable(seed, edges).select("id").union(closure.reachable(seed, edges, False).select("id")).distinct()


@query("g3_retain", "SELECT source, target FROM edges WHERE source % 3 <> 1", "edges")
def g3(spark, sf_dir):
    """Edges of the retained nodes; those to dropped nodes stay."""
    kept = views.nodes(spark, sf_dir).where("id % 3 <> 1").select(F.col("id").alias("source"))
    return views.edges(spark, sf_dir).join(kept, "source", "left_semi")


AFFECTED = f""", chains(id, chain) AS (SELECT id, [id] FROM nodes WHERE {TOUCHED} UNION ALL
        SELECT e.source, list_append(chain, e.source) FROM chains c JOIN edges e ON e.target = c.id WHERE NOT (e.source % 97 = 5)),
    best AS (SELECT id, chain FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(chain), chain) AS place FROM chains) WHERE place = 1)"""


@query(
    "g4_affected_cause",
    AFFECTED
    + """, others AS (SELECT b.id, string_agg(CAST(e.target AS VARCHAR), ',' ORDER BY e.target) AS also FROM best b JOIN edges e ON e.source = b.id
        WHERE len(b.chain) > 1 AND e.target IN (SELECT id FROM best) AND e.target <> b.chain[-2] GROUP BY b.id)
    SELECT b.id, array_to_string(chain, '>') AS chain, len(chain) - 1 AS depth, chain[1] AS first, CASE WHEN len(chain) > 1 THEN chain[-2] END AS parent, CASE WHEN len(chain) = 1 THEN 'touched' ELSE 'depends-on' END AS cause, coalesce(also, '') AS also
    FROM best b LEFT JOIN others o ON o.id = b.id""",
    "nodes edges",
    recursive=True,
)
def g4(spark, sf_dir):
    """Every affected node with why: its whole way, the touched one that begins at, and whom it is affected through."""
    found = checkpointed(closure.explained(seeds(spark, sf_dir, TOUCHED), views.edges(spark, sf_dir)))
    cause = F.when(F.col("parent").isNull(), "touched").otherwise("depends-on")
    join = lambda c, by: F.array_join(F.transform(c, lambda x: x.cast("string")), by)
    whole = found.join(closure.chains(found), "id")
    return whole.select("id", join("chain", ">").alias("chain"), "depth", "first", "parent", cause.alias("cause"), join("also", ",").alias("also"))


@query("g5_chain", AFFECTED + " SELECT id, array_to_string(chain, '>') AS chain FROM best WHERE id % 13 = 4", "nodes edges", recursive=True)
def g5(spark, sf_dir):
    """The whole ways to the nodes that were asked for."""
    found = closure.explained(seeds(spark, sf_dir, TOUCHED), views.edges(spark, sf_dir))
    return closure.chains(found, found.where("id % 13 = 4").select("id")).select("id", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


DIRECT = "SELECT DISTINCT l_suppkey AS importer, l_partkey AS id FROM lineitem"


@query(
    "g11_installed_closure",
    f""", reach(importer, id) AS ({DIRECT} UNION SELECT r.importer, e.target FROM reach r JOIN edges e ON e.source = r.id) SELECT importer, id AS key FROM reach""",
    "edges",
    recursive=True,
)
def g11(spark, sf_dir):
    direct = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("group"), F.col("l_partkey").alias("id"))
    found = closure.reachable_pairs(direct, views.edges(spark, sf_dir))
    return found.select(F.col("group").alias("importer"), F.col("id").alias("key"))


@query(
    "g12_packages_reached",
    f""", reach(id) AS (SELECT DISTINCT id FROM ({DIRECT}) UNION SELECT e.target FROM reach r JOIN edges e ON e.source = r.id)
    SELECT DISTINCT p_name AS package FROM reach JOIN part ON p_partkey = id""",
    "edges",
    recursive=True,
)
def g12(spark, sf_dir):
    items = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"))
    found = closure.reachable(items, views.edges(spark, sf_dir), dependents=False)
    names = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("package"))
    return found.join(names, "id").select("package").distinct()


@query(
    "g14_critical_path",
    CHAINS.format(near="source", far="target")
    + """, best AS (SELECT chain FROM chains ORDER BY total DESC, chain LIMIT 1), back AS (SELECT unnest(list_reverse(chain)) AS id, generate_subscripts(chain, 1) - 1 AS position FROM best)
    SELECT CAST(position AS BIGINT) AS position, id, weight FROM back JOIN nodes USING (id)""",
    "nodes edges",
    recursive=True,
)
def g14(spark, sf_dir):
    return closure.critical_path(views.nodes(spark, sf_dir), views.edges(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@query(
    "g15_priority",
    CHAINS.format(near="target", far="source")
    + """, longest AS (SELECT start AS id, max(total) AS path FROM chains GROUP BY start)
    SELECT id, path, row_number() OVER (ORDER BY path DESC, id) AS rank FROM longest""",
    "nodes edges",
    recursive=True,
)
def g15(spark, sf_dir):
    return schedule.priorities(views.nodes(spark, sf_dir), views.edges(spark, sf_dir))


@query("g16_waves", CHAINS.format(near="source", far="target") + " SELECT start AS id, max(len(chain)) - 1 AS wave FROM chains GROUP BY start", "nodes edges", recursive=True)
def g16(spark, sf_dir):
    return schedule.waves(views.nodes(spark, sf_dir), views.edges(spark, sf_dir))


@query(
    "g24_beside",
    """, after(asked, id) AS (SELECT id, id FROM nodes WHERE id BETWEEN 3 AND 12 UNION SELECT a.asked, e.source FROM after a JOIN edges e ON e.target = a.id),
    others AS (SELECT a.id AS asked, n.weight, row_number() OVER (PARTITION BY a.id ORDER BY n.weight DESC, n.id) AS place FROM (SELECT id FROM nodes WHERE id BETWEEN 3 AND 12) a, nodes n
        WHERE NOT EXISTS (SELECT 1 FROM after x WHERE x.asked = a.id AND x.id = n.id))
    SELECT n.id, CAST(n.weight + coalesce((SELECT sum(weight) FROM others o WHERE o.asked = n.id AND place <= 3), 0) AS BIGINT) AS work FROM nodes n WHERE n.id BETWEEN 3 AND 12""",
    "nodes edges",
    recursive=True,
)
def g24(spark, sf_dir):
    return schedule.work_beside(views.nodes(spark, sf_dir), views.edges(spark, sf_dir), list(range(3, 13)), 4)


@query(
    "c12_skips",
    """, reach(id) AS (SELECT id FROM nodes WHERE id IN (9, 10) UNION SELECT e.source FROM reach r JOIN edges e ON e.target = r.id) SELECT id FROM reach WHERE id NOT IN (9, 10)""",
    "nodes edges",
    recursive=True,
)
def c12(spark, sf_dir):
    return history.skipped_after(seeds(spark, sf_dir, "id IN (9, 10)"), views.edges(spark, sf_dir)).select("id")


CYCLES = """, pairs(a, b) AS (SELECT source, target FROM ring UNION SELECT p.a, e.target FROM pairs p JOIN ring e ON e.source = p.b),
    tree(a, b) AS (SELECT source, target FROM edges UNION SELECT p.a, e.target FROM tree p JOIN edges e ON e.source = p.b)"""


@query("g10_cycles", CYCLES + " SELECT 'edges' AS graph, EXISTS (SELECT 1 FROM tree WHERE a = b) AS cyclic UNION ALL SELECT 'ring', EXISTS (SELECT 1 FROM pairs WHERE a = b)", "edges ring", recursive=True)
def g10(spark, sf_dir):
    found = [("edges", closure.has_cycle(views.edges(spark, sf_dir))), ("ring", closure.has_cycle(views.ring(spark, sf_dir)))]
    return spark.createDataFrame(found, "graph string, cyclic boolean")


@query(
    "g10_cycle_path",
    """, pairs(a, b) AS (SELECT source, target FROM ring UNION SELECT p.a, e.target FROM pairs p JOIN ring e ON e.source = p.b), on_way AS (SELECT DISTINCT a FROM pairs WHERE a IN (SELECT a FROM pairs WHERE a = b) OR b IN (SELECT a FROM pairs WHERE a = b)),
    first AS (SELECT source AS id, min(target) AS parent FROM ring WHERE source IN (SELECT a FROM on_way) AND target IN (SELECT a FROM on_way) GROUP BY source),
    walk(id, n) AS (SELECT min(id), 0 FROM first UNION ALL SELECT f.parent, n + 1 FROM walk JOIN first f USING (id) WHERE n < 2 * (SELECT count(*) FROM first)),
    late AS (SELECT min(id) AS id FROM walk WHERE n >= (SELECT count(*) FROM first)),
    again(id, place) AS (SELECT id, 0 FROM late UNION ALL SELECT f.parent, place + 1 FROM again JOIN first f USING (id) WHERE f.parent <> (SELECT id FROM late))
    SELECT CAST(place AS BIGINT) AS place, id FROM again""",
    "ring",
    recursive=True,
)
def g10_path(spark, sf_dir):
    """One cycle, from its smallest id on."""
    return closure.cycle(views.ring(spark, sf_dir))


@query("g10_acyclic")
def g10_acyclic(spark, sf_dir):
    """The ring without the edges that close cycles in a depth-first search; a sequence, so without a SQL twin."""
    return closure.acyclic(views.ring(spark, sf_dir))


@query("g17_node_order", "SELECT p_partkey AS id, row_number() OVER (ORDER BY strlen(p_brand) DESC, p_name, p_partkey) AS place FROM part")
def g17(spark, sf_dir):
    """Longest roots first, then by name, over all nodes without one task sorting them."""
    from graphloom.operators.storage import ranked

    rows = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (-F.octet_length("p_brand")).alias("length"), "p_name")
    return ranked(rows, "length", "p_name", "id").select("id", F.col("rank").alias("place"))
