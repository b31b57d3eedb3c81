"""The last value before a row, of keys that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, keys: list[str], block: str, order: list[str], value: str, name: str = "last") -> DataFrame:
    """rows with the last non-null value of the same keys before each row, by (block, order); null where there is none.

    block is a column that never falls as order rises: a task orders one block of a key, or one row for each of its
    blocks. Rows equal in keys and order must not both hold values. Null keys are keys of their own.
    """
    within = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    ends = rows.groupBy(*keys, block).agg(latest.alias("_end"))
    carried = ends.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(block).alias("_block"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried")).where("_carried IS NOT NULL")
    here = rows.withColumn("_here", F.last(value, ignorenulls=True).over(within))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(block) == F.col("_block")]
    found = here.join(carried, same, "left").withColumn(name, F.coalesce("_here", "_carried"))
    return found.select(*rows.columns, name)
