"""Row numbers within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.storage import staged

#: Rows that one range of a group holds, about.
ROWS_PER_RANGE = 500_000


def numbered(rows: DataFrame, group: list[str], order: str | list[str], out: str = "rank") -> DataFrame:
    """``rows`` with ``out``: the number of each row in its group by ``order``, from 0; rows of one order take any order among them.

    The rows are cut into ranges of (group, order); a window numbers each range of a group, and the sizes of the ranges
    before it, of which there are few, give its start.
    """
    order = [order] if isinstance(order, str) else order
    rows = staged(rows, "to-number")
    parts = max(1, -(-rows.count() // ROWS_PER_RANGE))
    cut = staged(rows.repartitionByRange(parts, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*group, "_range", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    placed = cut.withColumn("_at", inside).join(starts, [*group, "_range"])
    return placed.withColumn(out, (F.col("_start") + F.col("_at") - 1).cast("bigint")).drop("_start", "_at", "_range")
