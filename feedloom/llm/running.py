"""Ranks and running sums over a whole ordered table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import partitions_for, stored


def running(df: DataFrame, name: str, order: list[Column], sums: dict[str, Column], within: Column | None = None) -> DataFrame:
    """`df` stored in the given order, with `row_rank` (0, 1, ...) over the whole table and, for each of `sums`, the sum over all
    rows before, as a column of that name; with `within` (the first key of the order) these sums start anew for each of its values.

    Two levels: a range sort deals the rows to tasks, sums over each task (and value of `within`) are added up in a table that has a
    row per task and value that meet, and every row adds its own task's share to the base of its task. A value that holds many rows
    is spread over many tasks. The order should be total; rows that tie are alike or take any order among themselves. The columns
    `running_task`, `running_in`, `row_rank` and the names of `sums` must not be in `df`.
    """
    spark = df.sparkSession
    keyed = df.withColumns({**sums, "running_in": F.lit(0) if within is None else within})
    dealt = keyed.repartitionByRange(partitions_for(spark), *order).withColumn("running_task", F.spark_partition_id())
    # Which task a row went to is written down: a second evaluation may deal differently.
    placed = stored(dealt, f"{name}-ranges")
    totals = placed.groupBy("running_task", "running_in").agg(
        F.count("*").alias("rows_here"), *(F.sum(c).alias(f"{c}_here") for c in sums)
    )
    ahead = lambda *keys: Window.partitionBy(*keys).orderBy("running_task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = totals.groupBy("running_task").agg(F.sum("rows_here").alias("rows_here"))
    ranks = per_task.select("running_task", F.coalesce(F.sum("rows_here").over(ahead(F.lit(0))), F.lit(0)).alias("rank_base"))
    bases = totals.select(
        "running_task", "running_in",
        *(F.coalesce(F.sum(f"{c}_here").over(ahead("running_in")), F.lit(0)).alias(f"{c}_base") for c in sums),
    ).join(ranks, "running_task")
    in_task = Window.partitionBy("running_task").orderBy(*order)
    before = Window.partitionBy("running_task", "running_in").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        *df.columns, "running_task", "running_in", (F.row_number().over(in_task) - 1).cast("bigint").alias("row_here"),
        *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums),
    )
    return local.join(bases, ["running_task", "running_in"]).select(
        *df.columns, (F.col("row_here") + F.col("rank_base")).alias("row_rank"),
        *((F.col(c) + F.col(f"{c}_base")).cast("bigint").alias(c) for c in sums),
    )
