"""Second lookups for failed records: one planner for all ways to name the days to ask for.

Every source of days becomes an array of days per record, NULL standing for the current state. The arrays of all sources are
joined and opened once, so a day that several sources name is asked once, and no source is a pass of its own over the records.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.functions.dates import date_set, day_text
from feedloom.functions.sqltext import as_object
from feedloom.functions.text import request_key
from feedloom.operators import enrich, requests

_DAYS = "array<date>"


@dataclass(frozen=True)
class Current:
    """The current state, for every record."""


@dataclass(frozen=True)
class Days:
    """The same days for every record."""

    days: tuple[date, ...]


@dataclass(frozen=True)
class SheetDays:
    """For each ip the days that its last dated row of a sheet names; `seq` is the order of the rows."""

    sheet: DataFrame
    ip: str
    stamp: str
    seq: str


@dataclass(frozen=True)
class SheetRange:
    """All days from the first to the last that a sheet names, for every record."""

    sheet: DataFrame
    stamp: str


@dataclass(frozen=True)
class Around:
    """The days around the days that a record names itself."""

    buffer_days: int


Source = Current | Days | SheetDays | SheetRange | Around


def named_days(spark: SparkSession, cell: str) -> Days:
    """Days of one cell text, such as `[2026-02-06, 2026-02-08 to 2026-02-10]`; a text without any is an error."""
    days = spark.range(1).select(F.lit(cell).alias("cell")).select(date_set("cell").alias("days")).first()["days"]
    if not days:
        raise ValueError(f"no dates in {cell!r}")
    return Days(tuple(days))


def _source_days(rows: DataFrame, source: Source, name: str) -> DataFrame:
    """`rows` (IP, raw, v, ...) with the days of one source as column `name`."""
    if isinstance(source, Current):
        return rows.withColumn(name, F.array(F.lit(None).cast("date")))
    if isinstance(source, Days):
        return rows.withColumn(name, F.array(*map(F.lit, source.days)).cast(_DAYS))
    if isinstance(source, SheetRange):
        days = requests.range_days(requests.global_range(source.sheet, source.stamp))
        return rows.withColumn(name, F.coalesce(days, F.raise_error(F.lit("no dates in the sheet"))))
    if isinstance(source, SheetDays):
        own = requests.dates_per_ip(source.sheet, source.ip, source.stamp, F.col(source.seq))
        # One row per ip on the sheet's side; a hot ip is on the records' side, which adaptive execution may split.
        return rows.join(own.select(F.col("ip").alias("IP"), F.col("dates").alias(name)), "IP", "left")
    if source.buffer_days < 0:
        raise ValueError("buffer_days must not be negative")
    around = F.transform("_days", lambda d: F.sequence(F.date_sub(d, source.buffer_days), F.date_add(d, source.buffer_days)))
    return requests.record_dates(rows).withColumn(name, F.flatten(around)).drop("_days")


def plan(records: DataFrame, sources: list[Source], seen: Observation | None = None) -> DataFrame:
    """Requests (IP, raw, dt), one per failed record and day; `records` has raw and v.

    Records without an `IP` member, or with an empty one, are left out, as are those for which no source names a day. `seen` counts
    records, without_ip and undated.
    """
    if not sources:
        raise ValueError("at least one source of days is needed")
    rows = records.select("raw", "v", bound(IP=F.expr("try_variant_get(v, '$.IP', 'string')")))
    names = [f"_source_{i}" for i in range(len(sources))]
    for name, source in zip(names, sources):
        rows = _source_days(rows, source, name)
    empty = F.array().cast(_DAYS)
    days = F.array_distinct(F.flatten(F.array(*(F.coalesce(F.col(n), empty) for n in names))))
    rows = rows.select("IP", "raw", bound(_days=days))
    named = F.coalesce(F.col("IP") != "", F.lit(False))
    if seen is not None:
        rows = rows.observe(
            seen, F.count("*").alias("records"), F.count_if(~named).alias("without_ip"),
            F.count_if(named & (F.size("_days") == 0)).alias("undated"),
        )
    return rows.filter(named).select("IP", "raw", F.explode("_days").alias("dt"))


def retried_keys(*outputs: DataFrame) -> DataFrame:
    """Keys of the requests in earlier outputs of a retry, ok and failed ones: (v) with `IP` or `ip`, and `Queried_Date`."""
    day = F.nullif(F.expr("try_variant_get(v, '$.Queried_Date', 'string')"), F.lit("Current"))
    ip = F.coalesce(F.expr("try_variant_get(v, '$.IP', 'string')"), F.expr("try_variant_get(v, '$.ip', 'string')"))
    keys = [df.select(request_key(ip, day).alias("request_key")) for df in outputs]
    rows = keys[0]
    for more in keys[1:]:
        rows = rows.union(more)
    return rows.filter("request_key is not null").distinct()


def without_done(asked: DataFrame, done: DataFrame | None, seen: Observation | None = None) -> DataFrame:
    """Requests (IP, dt, ...) whose key is not among the done ones; `seen` counts skipped."""
    if done is None:
        return asked if seen is None else asked.observe(seen, F.lit(0).cast("bigint").alias("skipped"))
    key = request_key(F.col("IP"), day_text(F.col("dt")))
    marked = asked.withColumn("request_key", key).join(done.withColumn("_done", F.lit(True)), "request_key", "left")
    if seen is not None:
        marked = marked.observe(seen, F.count("_done").alias("skipped"))
    return marked.filter("_done is null").drop("request_key", "_done")


def retried_lines(found: DataFrame) -> DataFrame:
    """Output lines (status, value) of looked-up requests (raw, dt, v, status, Error_Reason).

    Each is the failed record with its Queried_Date; a hit has the context merged in, whose members win, and no Error_Reason; a miss
    has the new reason.
    """
    queried = requests.queried_date(F.col("dt"))
    rows = found.select("status", "v", bound(
        _record=F.map_concat(F.expr(as_object("parse_json(raw)")), F.create_map(F.lit("Queried_Date"), queried.cast("variant"))),
        _reason=F.create_map(F.lit("Error_Reason"), F.col("Error_Reason").cast("variant")),
    ))
    hit = F.to_json(enrich.merge_records("_record", as_object("v"), ["Error_Reason"]))
    miss = F.to_json(F.map_concat("_record", "_reason"))
    return rows.select("status", F.when(F.col("status") == enrich.OK, hit).otherwise(miss).alias("value"))
