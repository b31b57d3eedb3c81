"""Path expressions: workspace-relative, '/'-separated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ancestors(path: str | Column) -> Column:
    """Every proper prefix of a path at a '/', shortest first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(
        F.array().cast("array<string>")
    )


def depth(path: str | Column) -> Column:
    return F.size(F.split(path, "/"))
