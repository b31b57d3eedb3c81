"""Every query of the engine with its DuckDB counterpart, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", recursive: bool = False):
    """Registers a query under a name; its int columns come out as long, as both engines then agree. sql is over the views named and may begin with further common table expressions, ', name AS (...)'."""

    def put(function):
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = function(spark, sf_dir)
            return found.withColumns({c: F.col(c).cast("long") for c, kind in found.dtypes if kind == "int"})

        QUERIES[name] = run
        if sql is not None:
            parts = ", ".join(f"{view} AS ({VIEWS[view]})" for view in views.split())
            body = sql.strip()
            if parts or body.startswith(","):
                body = f"WITH {'RECURSIVE ' if recursive else ''}{parts}{body if parts else body[1:]}" if body.startswith(",") else f"WITH {parts} {body}"
            ORACLES[name] = body
        return function

    return put


from graphloom.plans import change_plans, file_plans, graph_plans, history_plans, input_plans, lookup_plans, review_plans, storage_plans, task_plans, trace_plans, workspace_plans  # noqa: E402, F401
