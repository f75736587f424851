"""Session settings and shared storage of the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A batch handed to Python holds at most this much text, however long the documents are.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the batches that reach Python workers; everything else stays as the session has it."""
    for key, value in BATCH_CONF.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="corpus-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. A session of one process may do without and gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own_folder()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete stored tables whose last reader is done. Folders outside the shared folder are left alone."""
    for table in tables:
        spark = table.sparkSession
        shared = urlparse(shared_folder(spark)).path
        for folder in {unquote(file.rsplit("/", 1)[0]) for file in table.inputFiles()}:
            if urlparse(folder).path.startswith(f"{shared}/"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; all other columns are left behind, so their names cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(column: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def broadcast_below(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """A stored table of a few numbers per row, marked for broadcast if it has at most `rows` rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df
