"""The jobs end to end: files in, DataFrames or files out. Each is a composition of operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.dates import parse_span
from feedloom.operators import enrich, forensics, lines, profile, requests, retry, snapshots, tags, timeline
from feedloom.operators.criteria import Criterion, compile_criteria
from feedloom.session import configure, staged
from feedloom.sources import feeds, landing, sinks


def filter_feed_files(spark: SparkSession, path: str, out: str, criteria: list[Criterion], overall: str = "AND") -> dict[str, int]:
    """Write the matching lines of a feed as read; returns lines_parsed and exported, counted on the way."""
    configure(spark)
    seen, kept = Observation("seen"), Observation("kept")
    # Blank lines count as parsed.
    feed = feeds.parsed(feeds.read_lines(spark, path, keep_blank=True)).observe(seen, F.count("*").alias("lines_parsed"))
    matches = feed.filter(compile_criteria(criteria, overall)) if criteria else feed.filter(F.col("v").isNotNull())
    sinks.write_raw_lines(matches.observe(kept, F.count("*").alias("exported")), out)
    return {**seen.get, **kept.get}


def profile_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Top values of every key path of JSON files; options go to `profile`."""
    rows = profile.profile(feeds.read_documents(configure(spark), path).select("v"), **options)
    return rows.orderBy("path", "rank")


def summarise_files(spark: SparkSession, path: str, out: str, **options) -> None:
    """One JSON line per key path of JSON files, with its ranked values; options go to `profile`."""
    records = feeds.read_documents(configure(spark), path).select("v")
    sinks.write_json_lines(profile.summary_records(profile.profile(records, **options), records), out)


def count_lines(spark: SparkSession, path: str, patterns: dict[str, str]) -> dict[str, int]:
    """Number of lines of a feed, and of the lines that match each named pattern, in one pass."""
    return lines.match_counts(feeds.read_lines(configure(spark), path), patterns).first().asDict()


def flatten_files(spark: SparkSession, path: str, out: str) -> None:
    """JSON files to CSV with one column per flattened key."""
    sinks.write_wide_csv(feeds.read_documents(configure(spark), path, objects_only=True).select("v"), out)


def array_file_to_lines(spark: SparkSession, path: str, out: str) -> None:
    feeds.array_to_lines(configure(spark), path).write.text(out)


def list_tags(spark: SparkSession, path: str, out: str) -> None:
    """Tags of a metrics file, one per line."""
    sinks.write_tags(feeds.read_tags(configure(spark), path), out)


def tag_changes(spark: SparkSession, old: str, new: str) -> dict[str, DataFrame]:
    """diff, categories and details of the tags added between two metrics files."""
    configure(spark)
    sides = []
    for path in (old, new):
        feed = feeds.read_documents(spark, path, objects_only=True)
        sides.append(tags.tag_records(feed, feeds.position(feed)))
    added = tags.added_records(*sides)
    return {
        "diff": tags.tag_diff(*sides).orderBy("change", "tag"),
        "categories": tags.category_counts(added).orderBy(F.desc("count"), "category"),
        "details": tags.tag_details(added).orderBy("tag"),
    }


def _snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(ip, v) of a snapshot file, the last record per ip."""
    rows = feeds.keyed_records(feeds.read_documents(spark, path, objects_only=True))
    return snapshots.latest_records(rows, feeds.position(rows))


def land_snapshot(spark: SparkSession, path: str, table: str, buckets: int) -> DataFrame:
    """Keep a snapshot file, the last record per ip, as a table in buckets by ip."""
    return landing.land(_snapshot(configure(spark), path), table, buckets)


def landed_changes(spark: SparkSession, old: str, new: str, current_date: str) -> dict[str, DataFrame]:
    """rows, summary and attributes of the diff of two landed snapshots; the join moves no rows."""
    configure(spark)
    return _changes(landing.landed(spark, old), landing.landed(spark, new), current_date)


def snapshot_changes(spark: SparkSession, old: str, new: str, current_date: str) -> dict[str, DataFrame]:
    """rows, summary and attributes of the diff of two snapshot files."""
    configure(spark)
    return _changes(_snapshot(spark, old), _snapshot(spark, new), current_date)


def _changes(old: DataFrame, new: DataFrame, current_date: str) -> dict[str, DataFrame]:
    diff = staged(snapshots.diff_records(old, new), "snapshot-diff")
    return {
        "rows": snapshots.diff_rows(diff, current_date),
        "summary": snapshots.diff_summary(diff),
        "attributes": snapshots.attribute_counts(diff).orderBy(F.desc("changed"), "attribute"),
    }


def forensic_report(spark: SparkSession, history: str, current: str, current_date: str) -> dict[str, DataFrame]:
    """rows, nested lines, summary and attributes of a history file against a current snapshot."""
    configure(spark)
    feed = feeds.read_feed(spark, history)
    keyed = feeds.keyed_records(feed).withColumn("ts", feeds.stamp_text("unknown_date"))
    past = staged(forensics.history_records(keyed, feeds.position(keyed)), "history")
    now = staged(_snapshot(spark, current), "current")
    states = forensics.attribute_states(past, now)
    return {
        "rows": forensics.forensic_rows(past, now, current_date),
        "summary": forensics.forensic_summary(past, now),
        "lines": forensics.nested_history(forensics.forensic_rows(past, now, current_date)),
        "attributes": forensics.forensic_attribute_counts(states).orderBy(F.desc("aged_out"), F.desc("new_current"), "attribute"),
    }


def _look_up(requested: DataFrame, context: DataFrame, out: str) -> dict[str, int]:
    """Look requests (IP, Timestamp, ...) up and write them by status; returns success and failed, counted on the way."""
    keyed = requested.withColumn("_dt", F.to_date("Timestamp", "yyyyMMdd"))
    run = Observation("run")
    ok = F.col("status") == enrich.OK
    found = enrich.context_lookup(keyed, context, dt="_dt").drop("_dt")
    found = found.observe(run, F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))
    enrich.enriched_json(found).write.partitionBy("status").text(out)
    return run.get


def enrich_list(
    spark: SparkSession, path: str, context: DataFrame, out: str, day: date | None = None, max_expand: int = requests.MAX_EXPAND
) -> dict[str, int]:
    """Ips and CIDRs of a free-form list, expanded to distinct addresses, looked up for one day (or the current state)."""
    items = feeds.read_items(configure(spark), path)
    addresses = requests.expand_items(items, max_expand=max_expand).distinct()
    stamp = F.lit(day.strftime("%Y%m%d") if day else None).cast("string")
    counters = _look_up(addresses.select(F.col("ip").alias("IP"), stamp.alias("Timestamp")), context, out)
    return {**counters, "processed": sum(counters.values())}


def enrich_sheet(
    spark: SparkSession, sheet: str, context: DataFrame, out: str, cap: int | None = None,
    done: list[str] | None = None, columns: tuple[str, str | None, str | None] | None = None, multi_line: bool = False,
) -> tuple[dict[str, int], DataFrame | None]:
    """Sheet to requests per day, minus those done before, looked up and written by status.

    Returns the run counters, counted on the way, and the audit of the ranges cut by the cap. `multi_line` reads cells with line breaks.
    """
    configure(spark)
    rows = feeds.read_sheet(spark, sheet, multi_line)
    ip, start, end = columns or requests.map_columns(rows.columns)
    asked = requests.valid_requests(requests.expand_days(rows.withColumnRenamed(ip, "IP"), start, end, cap))
    left = Observation("left")
    if done:
        keys = requests.done_keys(*[feeds.read_feed(spark, p) for p in done])
        asked = requests.marked_done(asked, keys, "_done").observe(left, F.count_if("_done").alias("skipped"))
        asked = asked.filter("not _done").drop("_done")
    else:
        asked = asked.observe(left, F.lit(0).cast("bigint").alias("skipped"))
    # The lookup reads the requests twice: for the span of days and for the join.
    counters = {**_look_up(staged(asked, "sheet-requests"), context, out), **left.get}
    counters["processed"] = sum(counters.values())
    audit = requests.skipped_ranges(rows, ip, start, end or start, cap) if cap and start else None
    return counters, audit


def sheet_days(spark: SparkSession, path: str, multi_line: bool = False) -> retry.SheetDays:
    """Days per ip from a sheet whose ip and date columns are found by name."""
    sheet = feeds.read_sheet(configure(spark), path, multi_line, position="row_position")
    return retry.SheetDays(sheet, *requests.map_columns_loosely([c for c in sheet.columns if c != "row_position"]), "row_position")


def sheet_range(spark: SparkSession, path: str, multi_line: bool = False) -> retry.SheetRange:
    """All days between the first and the last of a sheet."""
    sheet = feeds.read_sheet(configure(spark), path, multi_line)
    return retry.SheetRange(sheet, requests.map_columns_loosely(sheet.columns)[1])


def retry_failed(
    spark: SparkSession, path: str, context: DataFrame, out: str, sources: list[retry.Source], done: list[str] | None = None
) -> dict[str, int]:
    """Look the failed records of an earlier run up again on the days that `sources` name, written by status.

    `done` are outputs of earlier retries: what they hold, found or not, is not asked again. Returns counters of records
    (records, without_ip, undated) and of requests (skipped, success, failed, processed), all counted on the way.
    """
    configure(spark)
    seen, left, run = Observation("records"), Observation("left"), Observation("run")
    asked = retry.plan(feeds.read_feed(spark, path), sources, seen)
    keys = retry.retried_keys(*[feeds.read_feed(spark, p) for p in done]) if done else None
    # The lookup reads the requests twice: for the span of days and for the join.
    todo = staged(retry.without_done(asked, keys, left), "retry-requests")
    found = enrich.context_lookup(todo, context, name_day=True)
    ok = F.col("status") == enrich.OK
    found = found.observe(run, F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"))
    retry.retried_lines(found).write.partitionBy("status").text(out)
    counters = {**seen.get, **left.get, **run.get}
    return {**counters, "processed": counters["success"] + counters["failed"]}


def timeline_report(
    context: DataFrame, ips: DataFrame, span: str, today: date | None = None, search_key: str | None = None, search_value: str | None = None
) -> dict[str, DataFrame]:
    """events of every listed ip within a span, and intervals of an attribute if one is searched.

    `context` is a table (ip, dt, v); today's row may be stored under a NULL dt.
    """
    bounds = parse_span(span, today)
    if bounds is None:
        raise ValueError(f"not a span: {span!r}")
    day = F.coalesce("dt", F.lit(today or date.today()))
    # The current state wins over a dated record of today.
    rows = context.select("ip", day.alias("dt"), "v", F.col("dt").isNull().alias("now"))
    rows = rows.filter(F.col("dt").between(*bounds)).join(ips.select("ip").distinct(), "ip", "left_semi")
    series = timeline.daily_series(rows, F.col("now"))
    out = {"events": timeline.timeline_events(series)}
    if search_key:
        out["intervals"] = timeline.presence_intervals(series, search_key, timeline.parse_target(search_value), ips)
    return out


def geo_by_prefix(spark: SparkSession, ips: DataFrame, registration: DataFrame, feed: str) -> DataFrame:
    """(ip, cidr, ipgeo_data) for the feed rows whose prefix is a network of a listed ip."""
    resolved = enrich.resolve_networks(registration.join(ips.select("ip").distinct(), "ip", "left_semi"))
    rows = feeds.read_feed(configure(spark), feed).withColumn("prefix", F.expr("try_variant_get(v, '$.prefix', 'string')"))
    return enrich.prefix_join(rows, resolved).select("ip", F.col("prefix").alias("cidr"), F.col("v").alias("ipgeo_data"))


def geo_records(spark: SparkSession, ips: DataFrame, registration: DataFrame, feed: str, out: str) -> None:
    """One JSON line per ip: its networks with their geo record. An ip has few networks, so the lists are short."""
    pair = F.struct("cidr", "ipgeo_data")
    rows = geo_by_prefix(spark, ips, registration, feed).withColumn("ipgeo_data", F.to_json("ipgeo_data"))
    grouped = rows.groupBy("ip").agg(F.array_sort(F.collect_list(pair)).alias("cidrs"))
    parsed = F.transform("cidrs", lambda c: F.struct(c["cidr"].alias("cidr"), F.parse_json(c["ipgeo_data"]).alias("ipgeo_data")))
    sinks.write_json_lines(grouped.select("ip", parsed.alias("cidrs")), out)


def latest_context(rows: DataFrame, seq: Column) -> DataFrame:
    """Context table (ip, dt, v) from dated records: one per ip and day, and the last one under a NULL dt."""
    daily = timeline.daily_series(rows.withColumn("seq", seq), F.col("seq"))
    now = snapshots.latest_records(rows.withColumn("seq", seq), F.struct("dt", "seq")).withColumn("dt", F.lit(None).cast("date"))
    return daily.unionByName(now)
