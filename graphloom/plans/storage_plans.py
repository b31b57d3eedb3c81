"""Queries about stored results: evictions, references, prefetching."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import documents
from graphloom.operators import storage
from graphloom.plans.registry import query
from graphloom.sources import views


@query(
    "a11_blob_refs",
    "SELECT blob, size, coalesce(entries, 0) AS entries FROM blobs LEFT JOIN (SELECT blob, count(DISTINCT entry) AS entries FROM entry_blobs GROUP BY blob) USING (blob)",
    "entry_blobs blobs",
)
def a11(spark, sf_dir):
    return storage.references(views.entry_blobs(spark, sf_dir), views.blobs(spark, sf_dir))


@query(
    "a11_pinned_blobs",
    """SELECT blob, size, coalesce(entries, 0) AS entries, blob IN (SELECT s_suppkey * 3 FROM supplier) AS pinned FROM blobs LEFT JOIN (SELECT blob, count(DISTINCT entry) AS entries FROM entry_blobs GROUP BY blob) USING (blob)""",
    "entry_blobs blobs",
)
def a11_pinned(spark, sf_dir):
    pins = views.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("blob"))
    return storage.references(views.entry_blobs(spark, sf_dir), views.blobs(spark, sf_dir), pins)


@query(
    "a14_set_digest",
    "SELECT importer, sha256(string_agg(f, chr(10) ORDER BY f)) AS digest FROM (SELECT DISTINCT importer, CAST(key AS VARCHAR) || fingerprint AS f FROM installs_after) GROUP BY importer",
    "installs_after",
)
def a14(spark, sf_dir):
    rows = views.installs(spark, sf_dir, "F").withColumn("f", F.concat(F.col("key").cast("string"), "fingerprint"))
    return rows.groupBy("importer").agg(documents.set_digest("f").alias("digest"))


LIMIT, UNUSED = 6_000_000, "1996-03-01"


@query(
    "w7_eviction",
    f""", lru AS (SELECT *, row_number() OVER (ORDER BY used, entry) AS rank FROM entries),
    gone AS (SELECT max(rank) AS rank, blob FROM entry_blobs JOIN lru USING (entry) GROUP BY blob),
    freeing AS (SELECT l.*, l.size + coalesce((SELECT sum(b.size) FROM gone g JOIN blobs b USING (blob) WHERE g.rank = l.rank), 0) AS freed FROM lru l),
    total AS (SELECT (SELECT sum(size) FROM entries) + (SELECT sum(size) FROM blobs WHERE blob IN (SELECT blob FROM entry_blobs)) AS total),
    running AS (SELECT f.*, sum(freed) OVER (ORDER BY rank) AS so_far FROM freeing f)
    SELECT entry, rank, CAST(freed AS BIGINT) AS freed FROM running, total
    WHERE NOT (total - so_far + freed <= CASE WHEN total > {LIMIT} THEN {LIMIT} - {LIMIT} // 10 ELSE {LIMIT} END AND used >= epoch_us(TIMESTAMP '{UNUSED}') // 1000)""",
    "entries entry_blobs blobs",
)
def w7(spark, sf_dir):
    before = spark.sql(f"SELECT unix_millis(timestamp '{UNUSED} 00:00:00') AS t").first()[0]
    return storage.evictions(views.entries(spark, sf_dir), views.entry_blobs(spark, sf_dir), views.blobs(spark, sf_dir), LIMIT, before)


@query(
    "w9_prefetch_order",
    """, members AS (SELECT run, max(started) OVER (PARTITION BY run) AS time, row_number() OVER (PARTITION BY run ORDER BY started, execution) AS pos, key AS member FROM exec_log WHERE key IS NOT NULL),
    hit AS (SELECT run, time, min(pos) AS place FROM members WHERE member = '42' GROUP BY run, time ORDER BY time DESC, run DESC LIMIT 3),
    found AS (SELECT m.member, -a.time AS t, -a.run AS r, m.pos < a.place AS before, abs(m.pos - a.place) AS far FROM members m JOIN hit a ON m.run = a.run WHERE m.pos <> a.place AND m.member <> '42'),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY t, r, before, far) AS n FROM found) WHERE n = 1)
    SELECT member, row_number() OVER (ORDER BY t, r, before, far) AS place FROM first""",
    "exec_log",
)
def w9(spark, sf_dir):
    from pyspark.sql import Window

    log = views.exec_log(spark, sf_dir).where("key IS NOT NULL")
    run = Window.partitionBy("run")
    members = log.select("run", F.max("started").over(run).alias("time"), F.row_number().over(run.orderBy("started", "execution")).alias("pos"), F.col("key").alias("member"))
    return storage.prefetch_order(members, "42")


@query(
    "j20_prefix_join",
    """, keys AS (SELECT sha256(CAST(p_partkey AS VARCHAR)) AS key FROM part UNION ALL SELECT left(sha256(CAST(p_partkey AS VARCHAR)), 16) || repeat('0', 48) FROM part WHERE p_partkey % 3 = 0),
    single AS (SELECT left(key, 16) AS prefix, min(key) AS key FROM keys GROUP BY 1 HAVING count(DISTINCT key) = 1)
    SELECT s.key, count(*) AS n FROM lineitem l JOIN single s ON left(sha256(CAST(l.l_partkey AS VARCHAR)), 16) = s.prefix GROUP BY s.key""",
)
def j20(spark, sf_dir):
    """Members named by 16 digits of a key; a prefix that two keys share names neither."""
    digest = lambda c: F.sha2(F.col(c).cast("string"), 256)
    part = views.table(spark, sf_dir, "part")
    twins = part.where("p_partkey % 3 = 0").select(F.concat(F.substring(digest("p_partkey"), 1, 16), F.lit("0" * 48)))
    members = views.table(spark, sf_dir, "lineitem").select("l_orderkey", F.substring(digest("l_partkey"), 1, 16).alias("member"))
    return storage.followed(members, part.select(digest("p_partkey").alias("key")).union(twins)).groupBy("key").agg(F.count("*").alias("n"))


@query(
    "a15_bloom_filter",
    """, keys AS (SELECT DISTINCT sha256(CAST(p_partkey AS VARCHAR)) AS key FROM part), size AS (SELECT greatest(64, CAST(ceil(-count(*) * ln(0.01) / (ln(2) * ln(2))) AS BIGINT)) AS bits FROM keys),
    swapped AS (SELECT key, CAST('0x' || array_to_string(list_transform(range(8), lambda i: substr(key, 15 - 2 * i, 2)), '') AS UHUGEINT) AS a, CAST('0x' || array_to_string(list_transform(range(8), lambda i: substr(key, 31 - 2 * i, 2)), '') AS UHUGEINT) AS b FROM keys),
    positions AS (SELECT DISTINCT CAST((a + CAST(i AS UHUGEINT) * (b + CAST(1 AS UHUGEINT) - b % CAST(2 AS UHUGEINT))) % CAST('18446744073709551616' AS UHUGEINT) % CAST(bits AS UHUGEINT) AS BIGINT) AS p FROM swapped, size, range(7) r(i))
    SELECT p // 8 AS byte, CAST(sum(1 << (p % 8)) AS BIGINT) AS value FROM positions GROUP BY 1""",
)
def a15(spark, sf_dir):
    """A filter over digests of part keys, sized for one false positive in a hundred."""
    return storage.bloom_filter(views.table(spark, sf_dir, "part").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("key")))
