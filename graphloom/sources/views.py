"""Stand-ins for build data, derived from the driver's tables by one definition per engine.

The tables hold no projects, tasks or runs, so each view gives an existing table the schema that an
operator works on: event rows become task executions and file accesses, parts a dependency graph, pages
file paths, and so on. VIEWS is the DuckDB side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_STATES = ["local-hit", "remote-hit", "miss", "uncached"]

VIEWS = {
    "exec_log": """
        SELECT event_id AS execution, user_id AS run, event_type || ':' || CAST(event_id % 8 AS VARCHAR) AS task, event_type AS target,
            CASE WHEN value < 10 THEN 'failure' ELSE 'success' END AS status,
            CASE event_id % 4 WHEN 0 THEN 'local-hit' WHEN 1 THEN 'remote-hit' WHEN 2 THEN 'miss' ELSE 'uncached' END AS cache,
            json_extract_string(props, '$.k') AS key, epoch_us(ts) // 1000 AS started, CAST(floor(value * 100) AS BIGINT) AS millis,
            CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id * 7919) % 1000003 END AS memory, 1 + event_id % 4 AS cores,
            event_id % 3 = 0 AS warm, (event_id * 31) % (1 + 4 * CAST(floor(value * 100) AS BIGINT)) AS cpu
        FROM events""",
    "nodes": "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS weight FROM part",
    "edges": """
        SELECT DISTINCT source, target FROM (SELECT p_partkey AS source, p_partkey // 2 AS target FROM part
            UNION ALL SELECT p_partkey, p_partkey // 3 FROM part) WHERE source > 1 AND target >= 1""",
    "ring": """
        SELECT DISTINCT source, target FROM (SELECT s_suppkey AS source, (7 * s_suppkey + 1) % (SELECT count(*) FROM supplier) AS target FROM supplier
            UNION ALL SELECT s_suppkey, s_suppkey // 2 FROM supplier WHERE s_suppkey > 0) WHERE source <> target""",
    "installs_before": "SELECT l_suppkey AS importer, l_partkey AS key, max(l_returnflag) AS fingerprint FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL",
    "installs_after": "SELECT l_suppkey AS importer, l_partkey AS key, max(l_returnflag) AS fingerprint FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL",
    "paths": "SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages",
    "roots": """
        SELECT DISTINCT root FROM (SELECT array_to_string(parts[1:n], '/') AS root FROM (SELECT string_split(path, '/') AS parts FROM (
            SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)), generate_series(1, 9) AS s(n) WHERE n < len(parts))
        WHERE length(root) % 2 = 0""",
    "entries": "SELECT o_orderkey AS entry, epoch_us(o_orderdate) // 1000 AS used, 100 + o_orderkey % 900 AS size FROM orders",
    "entry_blobs": "SELECT DISTINCT l_orderkey AS entry, l_partkey AS blob FROM lineitem",
    "blobs": "SELECT p_partkey AS blob, CAST(p_size AS BIGINT) * 1000 AS size FROM part",
    "accesses": """
        SELECT event_id AS seq, user_id AS task, json_extract_string(props, '$.k') AS path,
            CASE event_type WHEN 'purchase' THEN 'write' WHEN 'view' THEN 'read' WHEN 'click' THEN 'metadata' WHEN 'signup' THEN 'list' ELSE 'missing' END AS operation
        FROM events""",
    "catalog": "SELECT CAST(p_partkey AS VARCHAR) || ' ' || p_name AS name, p_type AS tag, p_brand AS root FROM part",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def exec_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    took = F.floor(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("execution"),
        F.col("user_id").alias("run"),
        F.concat_ws(":", "event_type", (F.col("event_id") % 8).cast("string")).alias("task"),
        F.col("event_type").alias("target"),
        F.when(F.col("value") < 10, "failure").otherwise("success").alias("status"),
        F.element_at(F.array(*map(F.lit, CACHE_STATES)), (F.col("event_id") % 4 + 1).cast("int")).alias("cache"),
        F.get_json_object("props", "$.k").alias("key"),
        millis("ts").alias("started"),
        took.alias("millis"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") * 7919 % 1000003).alias("memory"),
        (1 + F.col("event_id") % 4).alias("cores"),
        (F.col("event_id") % 3 == 0).alias("warm"),
        (F.col("event_id") * 31 % (1 + 4 * took)).alias("cpu"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("weight"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"))
    both = part.withColumn("target", F.explode(F.array(F.expr("source div 2"), F.expr("source div 3"))))
    return both.where("source > 1 AND target >= 1").distinct()


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"))
    n = supplier.count()
    around = supplier.withColumn("target", (7 * F.col("source") + 1) % n)
    return around.union(supplier.where("source > 0").withColumn("target", F.expr("source div 2"))).where("source <> target").distinct()


def installs(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == status)
    return items.groupBy(F.col("l_suppkey").alias("importer"), F.col("l_partkey").alias("key")).agg(F.max("l_returnflag").alias("fingerprint"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", bare.alias("path"))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.functions.paths import ancestors

    return paths(spark, sf_dir).select(F.explode(ancestors("path")).alias("root")).where(F.length("root") % 2 == 0).distinct()


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), millis("o_orderdate").alias("used"), (100 + F.col("o_orderkey") % 900).alias("size"))


def entry_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("blob")).distinct()


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("blob"), (F.col("p_size").cast("long") * 1000).alias("size"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    operation = F.when(kind == "purchase", "write").when(kind == "view", "read").when(kind == "click", "metadata").when(kind == "signup", "list").otherwise("missing")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("task"), F.get_json_object("props", "$.k").alias("path"), operation.alias("operation")
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name")
    return table(spark, sf_dir, "part").select(name.alias("name"), F.col("p_type").alias("tag"), F.col("p_brand").alias("root"))
