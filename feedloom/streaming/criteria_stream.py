"""The criteria filter over a directory that keeps receiving feed files.

The filter holds no state, so the batch Column runs unchanged on a stream.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from feedloom.functions.text import strip
from feedloom.operators.criteria import Criterion, compile_criteria, filter_feed
from feedloom.session import configure
from feedloom.sources.feeds import parsed


def _lines(spark: SparkSession, path: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).select(strip(F.col("value")).alias("raw"))


def stream_feed(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming twin of `read_feed`: (raw, v)."""
    lines = _lines(spark, path, max_files_per_trigger).filter(F.col("raw") != "")
    return parsed(lines).filter(F.col("v").isNotNull())


def stream_matches(spark: SparkSession, path: str, criteria: list[Criterion], overall: str = "AND") -> DataFrame:
    return filter_feed(stream_feed(spark, path), criteria, overall).select("raw")


def write_matches(matches: DataFrame, path: str, checkpoint: str):
    """Append matching lines as text, processing what is there and stopping."""
    return (
        matches.select(F.col("raw").alias("value"))
        .writeStream.format("text")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


class _Totals(StreamingQueryListener):
    """Sums of the observed counts of one query over all its batches."""

    def __init__(self, names: list[str]):
        self.names = names
        self.totals: dict[str, int] = {}
        self.query_id = None
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name in self.names:
            row = event.progress.observedMetrics.get(name)
            for key, value in (row.asDict() if row is not None else {}).items():
                self.totals[key] = self.totals.get(key, 0) + value
                self.query_id = event.progress.id

    def onQueryTerminated(self, event) -> None:
        if self.query_id is None or event.id == self.query_id:
            self.ended.set()


def filter_stream(
    spark: SparkSession, path: str, out: str, checkpoint: str, criteria: list[Criterion], overall: str = "AND",
    max_files_per_trigger: int | None = None, seconds: float = 60,
) -> dict[str, int]:
    """Write the matching lines of all new files of a folder and stop; returns lines_parsed and exported of this run.

    Blank lines count as parsed, as in the batch job. The counts are observed in each batch, so nothing is read twice. They arrive
    after the run has ended; `seconds` bounds the wait for them.
    """
    configure(spark)
    seen, kept = f"seen-{uuid.uuid4().hex}", f"kept-{uuid.uuid4().hex}"
    listener = _Totals([seen, kept])
    feed = parsed(_lines(spark, path, max_files_per_trigger)).observe(seen, F.count("*").alias("lines_parsed"))
    matches = feed.filter(compile_criteria(criteria, overall)) if criteria else feed.filter(F.col("v").isNotNull())
    spark.streams.addListener(listener)
    try:
        write_matches(matches.observe(kept, F.count("*").alias("exported")), out, checkpoint).awaitTermination()
        if not listener.ended.wait(seconds):
            raise TimeoutError("the counts of the run did not arrive")
    finally:
        spark.streams.removeListener(listener)
    return {"lines_parsed": 0, "exported": 0, **listener.totals}
