"""Queries about past runs, over the exec_log view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import history
from graphloom.plans.registry import query
from graphloom.sources import views

#: 30 days, and the last start of the events, in milliseconds.
MONTH = 30 * 24 * 3600 * 1000
RAN = "cache IN ('miss', 'uncached')"
#: As SQL: the last five executions of each task.
LAST = f""", last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY started DESC, execution DESC) AS age
    FROM exec_log WHERE {RAN}) WHERE age <= 5)"""
EXPECTED = (
    LAST
    + """, expected AS (SELECT task, target, millis, cores, memory FROM (SELECT task, target, millis, cores, row_number() OVER (PARTITION BY task ORDER BY millis, age) AS rank,
    count(*) OVER (PARTITION BY task) AS n, max(memory) OVER (PARTITION BY task) AS memory FROM last) WHERE rank = n // 2 + 1)"""
)


@query("a1_cache_counts", "SELECT run, coalesce(cache, status) AS state, count(*) AS n FROM exec_log GROUP BY ALL", "exec_log")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.cache_counts(views.exec_log(spark, sf_dir))


@query(
    "a2_flaky",
    f"""SELECT task, key, count(*) FILTER (WHERE status = 'success') AS successes, count(*) FILTER (WHERE status = 'failure') AS failures,
    max(started) AS last_started FROM exec_log WHERE {RAN} AND key IS NOT NULL GROUP BY task, key
    HAVING count(*) FILTER (WHERE status = 'success') > 0 AND count(*) FILTER (WHERE status = 'failure') > 0""",
    "exec_log",
)
def a2(spark, sf_dir):
    return history.flaky(views.exec_log(spark, sf_dir))


@query("a3_expected", EXPECTED + " SELECT task, millis, cores, memory FROM expected", "exec_log")
def a3(spark, sf_dir):
    return history.expected(views.exec_log(spark, sf_dir))


@query(
    "a5_memory_fallback",
    EXPECTED
    + """, known AS (SELECT task, target, CASE WHEN hash_free % 3 = 0 THEN NULL ELSE memory END AS memory FROM (SELECT *, millis AS hash_free FROM expected)),
    usual AS (SELECT target, memory AS usual FROM (SELECT target, memory, row_number() OVER (PARTITION BY target ORDER BY memory, task) AS rank,
        count(*) OVER (PARTITION BY target) AS n FROM known WHERE memory IS NOT NULL) WHERE rank = n // 2 + 1)
    SELECT task, target, coalesce(memory, usual) AS memory FROM known LEFT JOIN usual USING (target) WHERE coalesce(memory, usual) IS NOT NULL""",
    "exec_log",
)
def a5(spark, sf_dir):
    """Every third expectation (by its milliseconds) is taken to be without a measured memory."""
    log = views.exec_log(spark, sf_dir)
    known = history.expected(log).select("task", F.when(F.col("millis") % 3 != 0, F.col("memory")).alias("memory"))
    return history.memory_with_fallback(known.select("task", F.split("task", ":")[0].alias("target")), known)


@query(
    "a6_warm_vs_cold",
    f"""SELECT * FROM (SELECT task, CAST(sum(millis) FILTER (WHERE warm) // count(*) FILTER (WHERE warm) AS BIGINT) AS warm_millis,
    CAST(sum(millis) FILTER (WHERE NOT warm) // count(*) FILTER (WHERE NOT warm) AS BIGINT) AS cold_millis FROM exec_log WHERE {RAN} GROUP BY task)
    WHERE warm_millis IS NOT NULL AND cold_millis IS NOT NULL""",
    "exec_log",
)
def a6(spark, sf_dir):
    return history.warm_effect(views.exec_log(spark, sf_dir))


@query("a7_busy", "SELECT execution, CASE WHEN millis >= 2000 THEN round(CAST(cpu AS DOUBLE) / millis, 6) END AS busy FROM exec_log", "exec_log")
def a7(spark, sf_dir):
    return history.busy_cores(views.exec_log(spark, sf_dir))


@query(
    "a19_run_summary",
    """SELECT run, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status = 'failure') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped,
    count(*) FILTER (WHERE cache IN ('local-hit', 'remote-hit')) AS cached, max(started + millis) - min(started) AS wall_millis FROM exec_log GROUP BY run""",
    "exec_log",
)
def a19(spark, sf_dir):
    return history.run_summary(views.exec_log(spark, sf_dir))


@query(
    "a20_top_memory",
    """SELECT run, task, peak, place FROM (SELECT run, task, peak, row_number() OVER (PARTITION BY run ORDER BY peak DESC, task) AS place
    FROM (SELECT run, task, max(memory) AS peak FROM exec_log GROUP BY run, task) WHERE peak IS NOT NULL) WHERE place <= 3""",
    "exec_log",
)
def a20(spark, sf_dir):
    return history.top_memory(views.exec_log(spark, sf_dir))


@query(
    "a22_parallel_verdict",
    """, r AS (SELECT run, task, split_part(task, ':', 1) AS kind, CAST(split_part(task, ':', 2) AS INT) AS k, min(started) AS started, max(started + millis) AS ended, max(cores) * 10 AS memory_wait FROM exec_log GROUP BY run, task),
    m AS (SELECT run, min(started) AS begun, max(ended) - min(started) AS wall FROM r GROUP BY run),
    w AS (SELECT a.run, a.kind, a.started, coalesce(b.ended, m.begun) AS ready, greatest(a.started - coalesce(b.ended, m.begun) - a.memory_wait, 0) AS wait FROM r a JOIN m USING (run) LEFT JOIN r b ON b.run = a.run AND b.kind = a.kind AND b.k = a.k - 1),
    p AS (SELECT run, kind FROM (SELECT run, kind, sum(ended - started) AS total FROM r GROUP BY run, kind) QUALIFY row_number() OVER (PARTITION BY run ORDER BY total DESC, kind) = 1),
    t AS (SELECT run, sum(wait) AS waited FROM w JOIN p USING (run, kind) GROUP BY run),
    l AS (SELECT run, avg(CAST(cpu AS DOUBLE) / (1 + 4 * millis)) AS busy FROM exec_log s WHERE EXISTS (SELECT 1 FROM w WHERE w.run = s.run AND w.ready <= s.started AND s.started < w.started) GROUP BY run)
    SELECT run, CAST(waited AS BIGINT) AS waited, CASE WHEN waited < 200 OR waited < wall * 0.05 THEN 'no-wait' WHEN busy IS NULL THEN 'waited' WHEN round(busy, 6) >= 0.85 THEN 'machine-bound' ELSE 'more-slots' END AS verdict FROM m LEFT JOIN t USING (run) LEFT JOIN l USING (run)""",
    "exec_log",
)
def a22(spark, sf_dir):
    """A task needs the one before it of its kind, so that a run's critical path is its kind that took longest; load is sampled as executions start."""
    log = views.exec_log(spark, sf_dir)
    kind, k = F.substring_index("task", ":", 1), F.substring_index("task", ":", -1).cast("int")
    records = log.groupBy("run", "task").agg(F.min("started").alias("started"), F.max(F.col("started") + F.col("millis")).alias("ended"), (F.max("cores") * 10).alias("memory_wait"))
    edges = records.select("task").distinct().select(F.col("task").alias("src"), F.concat(kind, F.lit(":"), (k - 1).cast("string")).alias("dst")).where(~F.col("dst").endswith(":-1"))
    totals = records.groupBy("run", kind.alias("kind")).agg(F.sum(F.col("ended") - F.col("started")).alias("total"))
    path = totals.groupBy("run").agg(F.min_by("kind", F.struct(-F.col("total"), "kind")).alias("kind"))
    waits = history.slot_waits(records, edges)
    walls = records.groupBy("run").agg((F.max("ended") - F.min("started")).alias("wall"))
    load = history.load_while_waiting(log.select("run", F.col("started").alias("at"), (F.col("cpu") / (1 + 4 * F.col("millis"))).alias("load")), waits)
    return history.parallel_verdict(waits.withColumn("kind", kind).join(path, ["run", "kind"], "left_semi"), walls, load)


@query("w2_newest_runs", "SELECT run, min(started) AS started FROM exec_log GROUP BY run ORDER BY min(started) DESC, run DESC LIMIT 50", "exec_log")
def w2(spark, sf_dir):
    return history.newest_runs(views.exec_log(spark, sf_dir), 50)


PREVIOUS = "SELECT execution, task, key, lag(key) OVER (PARTITION BY task ORDER BY started, execution) AS previous_key FROM exec_log WHERE key IS NOT NULL"


@query("w4_previous_key", PREVIOUS, "exec_log")
def w4(spark, sf_dir):
    return history.previous_keys(views.exec_log(spark, sf_dir))


@query(
    "j16_asof",
    """SELECT b.execution, a.key AS previous_key FROM (SELECT * FROM exec_log WHERE status = 'failure' AND key IS NOT NULL) b
    LEFT JOIN LATERAL (SELECT key FROM exec_log a WHERE a.task = b.task AND a.key IS NOT NULL AND a.status = 'success'
        AND (a.started < b.started OR (a.started = b.started AND a.execution < b.execution)) ORDER BY a.started DESC, a.execution DESC LIMIT 1) a ON true""",
    "exec_log",
)
def j16(spark, sf_dir):
    """As-of join: each failure with the key of its task's latest earlier success, by one window over both sides."""
    log = views.exec_log(spark, sf_dir).where("key IS NOT NULL")
    before = Window.partitionBy("task").orderBy("started", "execution").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("status") == "success", F.col("key")), ignorenulls=True).over(before)
    return log.withColumn("previous_key", latest).where("status = 'failure'").select("execution", "previous_key")


@query(
    "w1_log_budget",
    """SELECT doc_id AS id, n_chars AS length, sum(n_chars) OVER (ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) <= (SELECT sum(n_chars) // 5 FROM documents) AS kept FROM documents""",
)
def w1(spark, sf_dir):
    """Documents stand in for logs; the budget is a fifth of them."""
    logs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("length"))
    return history.retained_logs(logs, (logs.agg(F.sum("length")).first()[0] or 0) // 5)


@query(
    "w11_expectation_merge",
    LAST
    + f""", kept AS (SELECT task, max(started) AS updated FROM last GROUP BY task HAVING max(started) + {MONTH // 15} >= (SELECT max(started) FROM exec_log)
        ORDER BY updated DESC, task LIMIT 25)
    SELECT task, updated, age, millis, cores, memory FROM last JOIN kept USING (task)""",
    "exec_log",
)
def w11(spark, sf_dir):
    log = views.exec_log(spark, sf_dir)
    now = log.agg(F.max("started")).first()[0] or 0
    return history.merged_expectations(log, now, MONTH // 15, tasks=25)


@query(
    "w8_history_bound",
    f""", runs AS (SELECT run, min(started) AS time, count(*) AS members FROM exec_log GROUP BY run),
    newest AS (SELECT * FROM runs WHERE time >= (SELECT max(time) FROM runs) - {MONTH // 2} ORDER BY time DESC, run DESC LIMIT 32)
    SELECT run, time, members, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(members) OVER (ORDER BY time DESC, run DESC) AS total FROM newest) WHERE total <= 1500""",
    "exec_log",
)
def w8(spark, sf_dir):
    runs = views.exec_log(spark, sf_dir).groupBy("run").agg(F.min("started").alias("time"), F.count("*").alias("members"))
    return history.bounded_history(runs, runs.agg(F.max("time")).first()[0] or 0, MONTH // 2, members=1500)


@query(
    "j14_key_inputs",
    """SELECT e.execution, o.o_orderpriority AS inputs FROM exec_log e LEFT JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0) o USING (key)""",
    "exec_log",
)
def j14(spark, sf_dir):
    """Left join of executions with the stored inputs of their key; orders stand in for those."""
    inputs = views.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("inputs"))
    return views.exec_log(spark, sf_dir).join(inputs, "key", "left").select("execution", "inputs")


@query("j17_orphans", "SELECT p_partkey AS key FROM part WHERE NOT EXISTS (SELECT 1 FROM exec_log WHERE exec_log.key = CAST(p_partkey AS VARCHAR))", "exec_log")
def j17(spark, sf_dir):
    """Stored keys that no execution names any more."""
    used = views.exec_log(spark, sf_dir).select("key").distinct()
    stored = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stored"))
    return stored.join(used, F.col("stored").cast("string") == F.col("key"), "left_anti").select(F.col("stored").alias("key"))


@query("a12_last_seen", "SELECT key, max(started) AS time FROM exec_log WHERE key IS NOT NULL GROUP BY key", "exec_log")
def a12(spark, sf_dir):
    from graphloom.operators import storage

    return storage.last_seen(views.exec_log(spark, sf_dir).where("key IS NOT NULL").select("key", F.col("started").alias("time")))


@query("o2_task_records", "SELECT execution, task, row_number() OVER (PARTITION BY run ORDER BY started DESC NULLS LAST, task, execution) AS place FROM exec_log", "exec_log")
def o2(spark, sf_dir):
    """Task records of each run, newest first, ones without a start last."""
    order = Window.partitionBy("run").orderBy(F.desc_nulls_last("started"), "task", "execution")
    return views.exec_log(spark, sf_dir).select("execution", "task", F.row_number().over(order).alias("place"))


FLAKY = """, f AS (SELECT task, key, count(*) FILTER (WHERE status = 'success') AS successes, count(*) FILTER (WHERE status = 'failure') AS failures, max(started) AS last_started FROM exec_log
    WHERE cache IN ('miss', 'uncached') AND key IS NOT NULL GROUP BY task, key)"""


@query("o3_flaky_order", FLAKY + " SELECT *, row_number() OVER (ORDER BY last_started DESC, task, key) AS place FROM f WHERE successes > 0 AND failures > 0", "exec_log")
def o3(spark, sf_dir):
    return history.flaky_order(history.flaky(views.exec_log(spark, sf_dir)))


@query(
    "j15_logged_tasks",
    """, t AS (SELECT DISTINCT run, task FROM exec_log WHERE status = 'failure'), l AS (SELECT run, task, sum(millis) AS length FROM exec_log WHERE warm GROUP BY ALL), r AS (SELECT run, max(started) AS started, run % 3 AS worktree FROM exec_log GROUP BY run HAVING run % 4 <> 1)
    SELECT t.run, t.task, CAST(length AS BIGINT) AS length, started, worktree FROM t JOIN l USING (run, task) JOIN r USING (run)""",
    "exec_log",
)
def j15(spark, sf_dir):
    """Tasks, their logs and their runs as tables of their own; some runs are gone."""
    log = views.exec_log(spark, sf_dir)
    runs = log.where("run % 4 <> 1").groupBy("run").agg(F.max("started").alias("started")).withColumn("worktree", F.col("run") % 3)
    return history.logged(log.where("status = 'failure'").select("run", "task").distinct(), log.where("warm").groupBy("run", "task").agg(F.sum("millis").alias("length")), runs)
