"""Session settings the record model depends on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings: keys `ip` and `IP` may sit in one record, days are UTC days, and a
# repeated JSON key keeps its last value.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Skew handling and partition sizing are left to adaptive execution. Work on nested records is heavy
# per byte, so small shuffles are not merged down to few tasks.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128kb",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; cluster sizing stays the caller's."""
    for key, value in {**RUNTIME_CONF, **ADAPTIVE_CONF}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "feedloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings applied. `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate that feeds several outputs once, as Parquet, and read it back.

    The folder is the one the cluster names in spark.checkpoint.dir, so that a lost executor does
    not lose it and later reads still prune columns. Without that setting the DataFrame is
    returned as it is and every output computes it again.
    """
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
