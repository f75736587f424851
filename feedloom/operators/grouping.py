"""Group-wise selection that stays spread out when one group holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def last_per_key(df: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """The row with the greatest `seq` per key.

    `max_by` is combined before the shuffle, so a hot key sends one row per task; a window would
    bring the whole group to one task.
    """
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r"))
    return last.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int, salt: list[str]) -> DataFrame:
    """First `n` rows per group with their `rank`.

    The group is first cut to `n` within each of a number of salted parts, so no task sees more
    than its part of a hot group, and the final ranking sees at most SALTS * n rows per group.
    """
    part = F.pmod(F.xxhash64(*salt), F.lit(SALTS))
    inner = Window.partitionBy(*groups, "part").orderBy(*order)
    outer = Window.partitionBy(*groups).orderBy(*order)
    cut = df.withColumn("part", part).withColumn("rank", F.row_number().over(inner)).filter(F.col("rank") <= n)
    best = cut.drop("part").withColumn("rank", F.row_number().over(outer)).filter(F.col("rank") <= n)
    return best.withColumn("rank", F.col("rank").cast("bigint"))


def duplicate_audit(df: DataFrame, key: str, digest: Column, seq: Column, chunk: list[Column]) -> DataFrame:
    """(identical, conflicting): duplicates of a key that equal, or differ from, the value held before.

    `chunk` is a coarse part of `seq` in the same order. Neighbours are compared inside each
    (key, chunk) first; only the first and last value of every chunk then meet per key.
    """
    names = [f"chunk_{i}" for i in range(len(chunk))]
    rows = df.select(F.col(key).alias("k"), digest.alias("d"), seq.alias("s"), *[c.alias(n) for c, n in zip(chunk, names)])
    inside = Window.partitionBy("k", *names).orderBy("s")
    rows = rows.withColumn("held", F.lag("d").over(inside))
    parts = rows.groupBy("k", *names).agg(
        F.count_if(F.col("held") == F.col("d")).alias("same"),
        F.count_if(F.col("held") != F.col("d")).alias("other"),
        F.min_by("d", "s").alias("first"),
        F.max_by("d", "s").alias("last"),
        F.min("s").alias("s"),
    )
    across = Window.partitionBy("k").orderBy("s")
    parts = parts.withColumn("held", F.lag("last").over(across))
    return parts.agg(
        F.coalesce(F.sum(F.col("same") + F.when(F.col("held") == F.col("first"), 1).otherwise(0)), F.lit(0)).alias("identical"),
        F.coalesce(F.sum(F.col("other") + F.when(F.col("held") != F.col("first"), 1).otherwise(0)), F.lit(0)).alias("conflicting"),
    )
