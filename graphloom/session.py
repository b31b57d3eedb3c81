"""Session helpers: a local session for tests and benches, and shared-folder checkpoints."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "graphloom") -> SparkSession:
    """A local session with the settings the engine is tested under; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites of columns cost more than small plans
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows that one task may order, and that may be broadcast.
FEW = 100_000


def met(rows: DataFrame, most: int = FEW) -> DataFrame:
    """rows to join with others: broadcast if they are counted and few, else sorted and merged, whatever size Spark takes them for.

    From a file that packs well, or before rows are exploded, a plan takes millions of rows for a few MB and would send them through the driver.
    """
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("merge")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df through the folder of spark.checkpoint.dir.

    Only on one machine, such as in tests, is a folder of our own taken where that setting is absent; a
    cluster without it raises ValueError, as its executors share no local folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> DataFrame:
    """As checkpointed, but more than FEW rows are not broadcast by a join that takes them for small (see met)."""
    found = checkpointed(df)
    return found if found.limit(FEW + 1).count() <= FEW else found.hint("merge")


def importable(spark: SparkSession) -> None:
    """Let Python workers that share this machine's paths import the package; elsewhere it is shipped with --py-files."""
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH", "")]))
