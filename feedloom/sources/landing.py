"""Snapshots and day series kept in buckets by key.

Rows with one key lie in one bucket of every table landed with the same number of buckets, so joins of such tables, and
groupings and windows by the key, read buckets side by side and move no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def land(df: DataFrame, table: str, buckets: int, key: str = "ip", mode: str = "error") -> DataFrame:
    """Keep `df` as the table `table` in `buckets` buckets by `key`, one sorted file each, and read it back.

    Tables that are to be joined need the same number of buckets; a bucket should hold some hundred megabytes. Rows without a key are
    kept, in one bucket. For snapshots and day series a key has few rows, so no bucket is hot.
    """
    if buckets < 1:
        raise ValueError("at least one bucket is needed")
    dealt = df.repartition(buckets, key)
    dealt.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return landed(df.sparkSession, table)


def landed(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
