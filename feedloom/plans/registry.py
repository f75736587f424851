"""Registry of the workload: named queries over the driver tables with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.session import configure
from feedloom.sources.feeds import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the Parquet tables of one directory."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def fanned(df: DataFrame) -> DataFrame:
    """A table spread over as many partitions as the session setting feedloom.partitions says.

    The tables of one row group are one split. Unset, a scan of fewer splits than the session has cores is spread over these; where the
    inputs have many splits nothing is shuffled.
    """
    session = df.sparkSession
    partitions = session.conf.get("feedloom.partitions", None)
    if partitions:
        return spread(df, int(partitions))
    cores = session.sparkContext.defaultParallelism
    return spread(df, cores if df.rdd.getNumPartitions() < cores else None)


def query(sql: str | None = None):
    """Register a function of `Tables` under its own name, with the SQL that gives the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(configure(spark), folder))

        run.__doc__ = build.__doc__
        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLE[build.__name__] = sql
        return build

    return register
