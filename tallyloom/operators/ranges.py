"""Exact ranks and running sums of groups of any size: range-partitioned sorting with partition offsets.

A window over a whole group puts the group in one task. Here the rows are range-partitioned by
(group, order), so a group with a third of all rows spreads over many tasks; each task sums its own
slice, and the slices' totals (one row for each group in each partition) give the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut

PID = "__slice"


def ranged(df: DataFrame, group: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """df range-partitioned by group and order, with the slice number in PID, written out once."""
    keys = [F.col(c) for c in (*group, *order)]
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return cut(spread.withColumn(PID, F.spark_partition_id()))


def running_sums(
    df: DataFrame, group: list[str], order: list[str], sums: dict[str, str], partitions: int | None = None
) -> DataFrame:
    """Add, for each (column -> name) of sums, the inclusive running sum of column within group by order.

    order must be unique within a group for a defined result (end it with a key). Null groups form a
    group of their own, null order values come first, null values add nothing, an empty df stays empty.
    """
    base = ranged(df, group, order, partitions)
    inside = Window.partitionBy(PID, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy(PID, *group).agg(*(F.sum(c).alias(f"__t_{n}") for c, n in sums.items()))
    offsets = totals.select(
        F.col(PID).alias("__o_pid"),
        *(F.col(g).alias(f"__o_{g}") for g in group),
        *(F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums.values()),
    )
    out = base
    for c, n in sums.items():
        out = out.withColumn(f"__s_{n}", F.coalesce(F.sum(c).over(inside), F.lit(0)))
    on = [F.col(PID) == F.col("__o_pid"), *(F.col(g).eqNullSafe(F.col(f"__o_{g}")) for g in group)]
    joined = out.join(offsets, on, "left")
    return joined.select(
        *df.columns, *((F.col(f"__s_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums.values())
    )
