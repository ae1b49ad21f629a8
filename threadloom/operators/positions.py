"""Positions inside groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def positions(rows: DataFrame, group: str, order: str, name: str = "position", block: int = 4096, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the rank, from 1, of each row in its group by the integer column ``order``.

    Groups are cut into blocks of ``order``; a row's rank is its rank in the block plus
    the rows of the blocks before. Only the block counts of a group meet in one task,
    one row per ``block`` values, so a group may hold a large share of all rows. Ties
    get consecutive ranks in the order of the columns ``ties``.
    """
    cut = rows.withColumn("_block", F.floor(F.col(order) / block))
    counts = cut.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("_group"), F.col("_block").alias("_b"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_block").orderBy(order, *ties))
    joined = cut.withColumn("_inside", inside).join(starts, F.col(group).eqNullSafe(F.col("_group")) & F.col("_block").eqNullSafe(F.col("_b")))
    return joined.withColumn(name, (F.col("_inside") + F.col("_before")).cast("int")).drop("_block", "_b", "_group", "_inside", "_before")


def running_sum(rows: DataFrame, group: str, order: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` over the rows up to each row, by the integer ``order``.

    Blocked like :func:`positions`; ``order`` must be unique in a group.
    """
    cut = rows.withColumn("_block", F.floor(F.col(order) / block))
    sums = cut.groupBy(group, "_block").agg(F.sum(value).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col(group).alias("_group"), F.col("_block").alias("_b"), before.alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = cut.withColumn("_inside", inside).join(starts, F.col(group).eqNullSafe(F.col("_group")) & F.col("_block").eqNullSafe(F.col("_b")))
    return joined.withColumn(name, F.col("_inside") + F.col("_before")).drop("_block", "_b", "_group", "_inside", "_before")
