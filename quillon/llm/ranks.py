"""Places of rows inside their group, in DataFrame functions only and without a task that holds a group.

Rows are sorted into range partitions and written to the shared folder with a number that counts up inside each
partition; a group's rows stand in consecutive partitions, so a place is the number inside the partition, less the group's
first one there, plus the group's rows in earlier partitions. Those sums have one row for each partition and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.base import shuffle_partitions, stored

_BITS = 33


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ranked(df: DataFrame, group: list[str], order: list[str], folder: str, near: list[str | Column] | None = None) -> DataFrame:
    """df's columns and `rank`, from 0 in every group by `order` (nulls first); rows equal in both get places in any order.

    near: what range partitions are made of after the group, if not `order` itself: a coarser order where its values are long.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_partitions(spark), *group, *(order if near is None else near))
    at = stored(dealt.sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()), folder)
    part = F.shiftright("_at", _BITS)
    runs = at.groupBy(*group, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_part").alias("_p"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    on = part == F.col("_p")
    for k, g in enumerate(group):
        on = on & same(F.col(g), F.col(f"_g{k}"))
    return at.join(runs, on).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("rank"))
