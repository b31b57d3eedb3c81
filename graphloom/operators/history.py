"""Questions about past runs, over executions (run, task, target, status, cache, key, started, millis, memory, cores)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.storage import sums_before

#: How many executions an expectation is made of; runs and tasks that are kept.
RECENT, KEPT_RUNS, KEPT_TASKS = 5, 200, 10_000


def cache_counts(log: DataFrame) -> DataFrame:
    """Executions of each run by cache state, or by status without one."""
    return log.groupBy("run", F.coalesce("cache", "status").alias("state")).agg(F.count("*").alias("n"))


def executed(log: DataFrame) -> DataFrame:
    """Executions that ran rather than being restored."""
    return log.where(F.col("cache").isin("miss", "uncached") & F.col("status").isin("success", "failure"))


def flaky(log: DataFrame) -> DataFrame:
    """Keys of a task that both succeeded and failed, with counts and the last start."""
    counted = executed(log).where("key IS NOT NULL").groupBy("task", "key")
    count = lambda status: F.count_if(F.col("status") == status)
    return counted.agg(count("success").alias("successes"), count("failure").alias("failures"), F.max("started").alias("last_started")).where("successes > 0 AND failures > 0")


def flaky_order(found: DataFrame) -> DataFrame:
    """flaky() rows with place: the last started first, then by task and key."""
    from graphloom.operators.storage import ranked

    rows = found.withColumn("order", -F.col("last_started"))
    return ranked(rows, "order", "task", "key").drop("order").withColumnRenamed("rank", "place")


def logged(tasks: DataFrame, logs: DataFrame, runs: DataFrame) -> DataFrame:
    """tasks(run, task, ...) that have one of logs(run, task, length), with it and what runs(run, worktree) says of their run."""
    return tasks.join(logs, ["run", "task"]).join(runs, "run")


def expected(log: DataFrame, recent: int = RECENT) -> DataFrame:
    """task, millis, cores, memory: the upper median of the last executions with its cores, and their largest memory.

    Among equal durations the newer execution comes first.
    """
    newest = Window.partitionBy("task").orderBy(F.desc("started"), F.desc("execution"))
    last = executed(log).withColumn("age", F.row_number().over(newest)).where(F.col("age") <= recent)
    rank = F.row_number().over(Window.partitionBy("task").orderBy("millis", "age"))
    whole = Window.partitionBy("task")
    ranked = last.select("task", "millis", "cores", rank.alias("rank"), F.count("*").over(whole).alias("n"), F.max("memory").over(whole).alias("memory"))
    return ranked.where(F.col("rank") == F.floor(F.col("n") / 2) + 1).select("task", "millis", "cores", "memory")


def memory_with_fallback(tasks: DataFrame, known: DataFrame) -> DataFrame:
    """memory of tasks(task, target): its own in known(task, memory), else the upper median of its target's tasks; without either no row."""
    own = tasks.join(known.select("task", "memory"), "task", "left")
    by_size = Window.partitionBy("target").orderBy("memory", "task")
    of_target = own.where("memory IS NOT NULL").select("target", "memory", F.row_number().over(by_size).alias("rank"), F.count("*").over(Window.partitionBy("target")).alias("n"))
    median = of_target.where(F.col("rank") == F.floor(F.col("n") / 2) + 1).select("target", F.col("memory").alias("usual"))
    return own.join(median, "target", "left").select("task", "target", F.coalesce("memory", "usual").alias("memory")).where("memory IS NOT NULL")


def warm_effect(log: DataFrame) -> DataFrame:
    """Mean milliseconds, rounded down, of warm and cold executions of tasks that have both."""
    mean = lambda warm: F.floor(F.sum(F.when(F.col("warm") == warm, F.col("millis"))) / F.count_if(F.col("warm") == warm)).cast("long")
    return executed(log).groupBy("task").agg(mean(True).alias("warm_millis"), mean(False).alias("cold_millis")).where("warm_millis IS NOT NULL AND cold_millis IS NOT NULL")


def busy_cores(log: DataFrame, least_millis: int = 2000) -> DataFrame:
    """CPU over elapsed time of executions long enough to tell."""
    busy = F.when(F.col("millis") >= least_millis, F.round(F.col("cpu") / F.col("millis"), 6))
    return log.select("execution", busy.alias("busy"))


def run_summary(log: DataFrame) -> DataFrame:
    """Outcome counts and wall time of each run."""
    ended = F.col("started") + F.col("millis")
    cached = F.col("cache").isin("local-hit", "remote-hit")
    return log.groupBy("run").agg(
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failure").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(cached).alias("cached"),
        (F.max(ended) - F.min("started")).alias("wall_millis"),
    )


def top_memory(log: DataFrame, n: int = 3) -> DataFrame:
    """The n tasks of each run with the highest peak, by peak, then task."""
    peaks = log.groupBy("run", "task").agg(F.max("memory").alias("peak")).where("peak IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("peak"), "task"))
    return peaks.withColumn("place", place).where(F.col("place") <= n)


def slot_waits(records: DataFrame, edges: DataFrame) -> DataFrame:
    """run, task, ready, started, wait of records(run, task, started, ended, memory_wait): a task is ready when the last of what it needs, edges(src, dst: needed), has
    ended in its run, or as the run begins; until it starts it waits for a slot, less what it waited for memory."""
    begun = records.groupBy("run").agg(F.min("started").alias("begun"))
    ended = edges.select("src", "dst").distinct().join(records.select("run", F.col("task").alias("dst"), "ended"), "dst").groupBy("run", F.col("src").alias("task")).agg(F.max("ended").alias("needed"))
    rows = records.join(ended, ["run", "task"], "left").join(begun, "run").withColumn("ready", F.coalesce("needed", "begun"))
    wait = F.greatest(F.col("started") - F.col("ready") - F.coalesce("memory_wait", F.lit(0)), F.lit(0))
    return rows.select("run", "task", "ready", "started", wait.alias("wait"))


def load_while_waiting(samples: DataFrame, waits: DataFrame, width: int = 60_000) -> DataFrame:
    """run, at, load, waiting of samples(run, at, load): whether a task of the run is within its wait, from ready until started.

    A sweep over beginnings (+1) and ends (-1): sums of a run's ranges of width milliseconds first, then within each range.
    """
    mark = lambda at, step: F.struct(F.col(at).cast("long").alias("at"), F.lit(step).alias("step"))
    marks = waits.where("ready < started").select("run", F.explode(F.array(mark("ready", 1), mark("started", -1))).alias("m")).select("run", "m.at", "m.step", F.lit(None).cast("double").alias("load"), F.lit(False).alias("sample"))
    rows = marks.unionByName(samples.select("run", F.col("at").cast("long").alias("at"), F.lit(0).alias("step"), "load", F.lit(True).alias("sample"))).withColumn("range", F.floor(F.col("at") / width))
    earlier = Window.partitionBy("run").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("run", "range").agg(F.sum("step").alias("steps")).select("run", "range", F.coalesce(F.sum("steps").over(earlier), F.lit(0)).alias("before"))
    here = F.sum("step").over(Window.partitionBy("run", "range").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("here", here).join(before, ["run", "range"]).where("sample").select("run", "at", "load", (F.col("before") + F.col("here") > 0).alias("waiting"))


def parallel_verdict(waits: DataFrame, walls: DataFrame, load: DataFrame) -> DataFrame:
    """Whether more slots would help each run: waits(run, wait) of the critical path, walls(run, wall), load(run, load, waiting).

    No wait if it is under 200 ms or 5 % of the wall; otherwise the load while tasks waited decides: from 0.85 the machine is the limit.
    """
    total = waits.groupBy("run").agg(F.sum("wait").alias("waited"))
    busy = load.groupBy("run").agg(F.round(F.avg(F.when(F.col("waiting"), F.col("load"))), 6).alias("busy"))
    rows = walls.join(total, "run", "left").join(busy, "run", "left").withColumn("waited", F.coalesce("waited", F.lit(0)))
    none = (F.col("waited") < 200) | (F.col("waited") < F.col("wall") * 0.05)
    verdict = F.when(none, "no-wait").when(F.col("busy").isNull(), "waited").when(F.col("busy") >= 0.85, "machine-bound").otherwise("more-slots")
    return rows.select("run", "waited", verdict.alias("verdict"))


def newest_runs(log: DataFrame, n: int) -> DataFrame:
    """The n runs that started last, ties by the higher run."""
    starts = log.groupBy("run").agg(F.min("started").alias("started"))
    return starts.orderBy(F.desc("started"), F.desc("run")).limit(n)


def previous_keys(log: DataFrame, width: int = 7 * 86_400_000) -> DataFrame:
    """The key each execution's task had before it, of the executions that have one.

    Windows are of a task's ranges of width milliseconds; a range's first execution looks at the last of the range before.
    """
    rows = log.where("key IS NOT NULL").select("execution", "task", "key", "started", F.floor(F.col("started") / width).alias("range"))
    lasts = rows.groupBy("task", "range").agg(F.max_by("key", F.struct("started", "execution")).alias("last"))
    carried = lasts.select("task", "range", F.lag("last").over(Window.partitionBy("task").orderBy("range")).alias("carried"))
    order = Window.partitionBy("task", "range").orderBy("started", "execution")
    here = rows.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("key").over(order))
    both = here.join(carried, here.task.eqNullSafe(carried.task) & here.range.eqNullSafe(carried.range)).drop(carried.task, carried.range)
    return both.select("execution", "task", "key", F.when(F.col("place") == 1, F.col("carried")).otherwise(F.col("before")).alias("previous_key"))


def retained_logs(logs: DataFrame, budget: int) -> DataFrame:
    """kept: whether the logs(id, length) up to this one, newest (highest id) first, fit the budget; rows stay either way.

    The running sum is of ranges of ids first, so that no task orders all rows.
    """
    width = 4096
    ranges = logs.withColumn("range", F.floor(F.col("id") / width))
    before = sums_before(ranges.groupBy("range").agg(F.sum("length").alias("total")), "range", "total", descending=True)
    within = Window.partitionBy("range").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    running = ranges.withColumn("here", F.sum("length").over(within)).join(before.drop("total"), "range")
    return running.select("id", "length", (F.col("before") + F.col("here") <= budget).alias("kept"))


def merged_expectations(log: DataFrame, now: int, keep_millis: int, recent: int = RECENT, tasks: int = KEPT_TASKS) -> DataFrame:
    """The last `recent` executions of the `tasks` tasks executed last, none of which is older than keep_millis."""
    newest = Window.partitionBy("task").orderBy(F.desc("started"), F.desc("execution"))
    last = executed(log).withColumn("age", F.row_number().over(newest)).where(F.col("age") <= recent)
    updated = last.groupBy("task").agg(F.max("started").alias("updated")).where(F.col("updated") + keep_millis >= now)
    kept = updated.orderBy(F.desc("updated"), "task").limit(tasks)
    return last.join(F.broadcast(kept), "task").select("task", "updated", "age", "millis", "cores", "memory")


def bounded_history(runs: DataFrame, now: int, keep_millis: int, n: int = 32, members: int = 100_000) -> DataFrame:
    """Of runs(run, time, members) the newest n within keep_millis, up to the first whose members overflow the sum."""
    newest = runs.where(F.col("time") >= now - keep_millis).orderBy(F.desc("time"), F.desc("run")).limit(n)
    total = F.sum("members").over(Window.orderBy(F.desc("time"), F.desc("run")))
    return newest.withColumn("total", total).where(F.col("total") <= members)


def skipped_after(failed: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks that failures keep from running: all that depend on a failed(id), less the failed themselves."""
    from graphloom.operators.closure import reachable

    return reachable(failed, edges).join(failed.select("id"), "id", "left_anti")
