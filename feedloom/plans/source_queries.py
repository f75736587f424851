"""Workload: readers, sinks and file metadata over lines that the driver tables give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions.dates import day_text
from feedloom.operators import requests, timeline
from feedloom.operators.criteria import Criterion, filter_feed, parse_keywords
from feedloom.plans.feed_queries import event_feed, text_of
from feedloom.plans.registry import Tables, fanned, query
from feedloom.sources import catalog, feeds, sinks
from feedloom.sources.documents import array_members


@query("""
select p_partkey as k, 0 as item from part where p_size % 3 = 0
union all select p_partkey + i, i from part, (select unnest([0, 2]) as i) where p_size % 3 = 1
""")
def unwrapped_lines(t: Tables) -> DataFrame:
    """Lines that hold a record or a list: members that are objects, with their places."""
    key = F.col("p_partkey").cast("string")
    single = F.concat(F.lit('{"k":'), key, F.lit("}"))
    later = F.concat(F.lit('{"k":'), (F.col("p_partkey") + 2).cast("string"), F.lit("}"))
    raw = F.when(F.col("p_size") % 3 == 0, single).when(F.col("p_size") % 3 == 1, F.concat(F.lit("["), single, F.lit(', "x", '), later, F.lit("]")))
    lines = feeds.parsed(fanned(t.part).select(F.coalesce(raw, F.concat(F.lit("7 "), single)).alias("raw")))
    return feeds.unwrapped(lines, objects_only=True).select(text_of("k", "bigint"), "item")


@query("""
select cast(c_nationkey as varchar) as file, count(*) + 1 as members, sum(c_custkey)::bigint as ids, count(*) as last_member from customer group by 1
""")
def array_documents(t: Tables) -> DataFrame:
    """One array per nation over many lines and splits, its strings full of signs, cut into members by many tasks."""
    rows = fanned(t.customer).select("c_nationkey", "c_custkey", F.posexplode(F.array(
        F.lit("{"), F.concat(F.lit('"id":'), F.col("c_custkey").cast("string"), F.lit(', "tags": [1,')),
        F.lit('"a],{\\"b", {"c": []}'), F.lit("] },"),
    )).alias("at", "raw"))
    body = rows.select("raw", "c_nationkey", F.expr("c_custkey div 100").alias("block"), (F.col("c_custkey") * 4 + F.col("at")).alias("line"))
    frame = t.customer.select("c_nationkey").distinct().select("c_nationkey", F.inline(F.array(
        F.struct(F.lit("[").alias("raw"), F.lit(-1).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("line")),
        F.struct(F.lit("null ]").alias("raw"), F.lit(2**62).alias("block"), F.lit(0).cast("bigint").alias("line")),
    )))
    lines = body.unionByName(frame.select("raw", "c_nationkey", "block", "line")).withColumn("file", F.col("c_nationkey").cast("string"))
    members = array_members(lines.drop("c_nationkey"))
    return members.groupBy("file").agg(
        F.count_if(F.col("v").isNotNull()).alias("members"), F.sum(F.expr("try_variant_get(v, '$.id', 'bigint')")).alias("ids"),
        F.max("member").alias("last_member"),
    )


@query("""
select '{"c_custkey":' || c_custkey || ',"name":"' || c_name || '","segment":' ||
  case when c_mktsegment = 'BUILDING' then 'null' else '"' || c_mktsegment || '"' end || '}' as value from customer
""")
def json_lines(t: Tables) -> DataFrame:
    """Records as JSON lines, members that are missing written as null."""
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return t.customer.select(sinks.json_line("c_custkey", F.col("c_name").alias("name"), segment.alias("segment")).alias("value"))


_FILES = """
with f as (
  select event_id, event_type, ts, strftime(ts, '%Y%m%d') as d, case event_type when 'view' then strftime(ts, '%Y%m%d') || '101500AnonResRT.json.gz'
    when 'click' then strftime(ts, '%Y%m%d') || 'IPSummary.json' when 'error' then strftime(ts, '%Y%m%d') || 'AnonResX.json'
    else 'export.json' end as name from events
)
"""


def _files(t: Tables) -> DataFrame:
    kind, day = F.col("event_type"), F.date_format("ts", "yyyyMMdd")
    name = (
        F.when(kind == "view", F.concat(day, F.lit("101500AnonResRT.json.gz"))).when(kind == "click", F.concat(day, F.lit("IPSummary.json")))
        .when(kind == "error", F.concat(day, F.lit("AnonResX.json"))).otherwise("export.json")
    )
    return fanned(t.events).select("event_id", "ts", F.concat(F.lit("/lake/"), name).alias("file"))


@query(_FILES + """
select event_id, case when event_type in ('view', 'click') then d end as snapshot_date, case when event_type = 'view' then '101500' end as snapshot_time,
  case event_type when 'view' then 'AnonResRT' when 'click' then 'IPSummary' when 'error' then 'AnonymousResidentialX' else 'export' end as dataset
from f
""")
def snapshot_files(t: Tables) -> DataFrame:
    """Date, time and data set read off feed file names, known or not."""
    info = catalog.snapshot_info(F.col("file"))
    return _files(t).select("event_id", *(column.alias(name) for name, column in info.items()))


@query(_FILES + "select event_id, strftime(ts + interval 1 day - interval 1 day, '%Y%m%d') as day from f")
def file_dates(t: Tables) -> DataFrame:
    """Day of a file by its name, else by its time of change."""
    return _files(t).select("event_id", catalog.file_date(F.col("file"), F.col("ts")).alias("day"))


@query("""
select event_id from events where contains(event_type, 'err') or contains(event_type, 'sign')
""")
def keyword_criteria(t: Tables) -> DataFrame:
    """Keywords as a user writes them: letter case, blanks and empty parts do not matter."""
    hits = filter_feed(event_feed(t), [Criterion("event_type", parse_keywords(" ERR ,, Sign,"), "OR")])
    return hits.select(text_of("event_id", "bigint"))


@query("""
select event_id, cast(json_extract_string(props, '$.k') as bigint) = 7 as number, event_type = 'error' as text, true as present,
  false as quoted_number from events
""")
def searched_values(t: Tables) -> DataFrame:
    """Search literals: a number, a bare word, nothing (any value), and an absent member."""
    found = {
        "number": timeline.matches(timeline.value_at("v", "props.k"), timeline.parse_target("7")),
        "text": timeline.matches(timeline.value_at("v", "event_type"), timeline.parse_target("error")),
        "present": timeline.matches(timeline.value_at("v", "user_id"), timeline.parse_target(" none".strip())),
        "quoted_number": timeline.matches(timeline.value_at("v", "no_such"), timeline.parse_target("")),
    }
    return event_feed(t).select(text_of("event_id", "bigint"), *(column.alias(name) for name, column in found.items()))


@query("""
select strftime(d, '%Y%m%d') as day, count(*) as n, count(distinct o_custkey) as ips
from (select o_custkey, o_orderdate::date + cast(unnest([0, 1, 2]) as int) as d from orders) group by 1
""")
def mapped_sheet(t: Tables) -> DataFrame:
    """A sheet whose ip and date columns are found by their names, expanded to days."""
    day = F.to_date("o_orderdate")
    sheet = fanned(t.orders).select(
        F.col("o_orderkey").alias("ticket"), F.col("o_custkey").cast("string").alias(" Client IP Address"),
        F.date_format(day, "M/d/yyyy").alias("First Seen"), F.date_format(F.date_add(day, 2), "yyyy-MM-dd").alias("last date"),
    )
    ip, start, end = requests.map_columns(sheet.columns)
    rows = requests.expand_days(sheet.withColumnRenamed(ip, "IP"), start, end)
    return rows.groupBy(F.col("Timestamp").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("IP").alias("ips"))


@query("""
select cast(o_custkey as varchar) as ip, strftime(max(o_orderdate), '%Y%m%d') as last_day from orders group by 1
""")
def loosely_mapped_sheet(t: Tables) -> DataFrame:
    """A sheet whose columns are found by looser names: the last day per ip."""
    sheet = fanned(t.orders).select(
        F.col("o_custkey").cast("string").alias("Source_IP"), F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("When (time)")
    )
    ip, stamp = requests.map_columns_loosely(sheet.columns)
    rows = sheet.select(F.col(ip).alias("ip"), F.to_date(F.col(stamp)).alias("d")).groupBy("ip").agg(F.max("d").alias("d"))
    return rows.select("ip", day_text(F.col("d")).alias("last_day"))


@query("select sum(len(string_split(text, chr(10))))::bigint as lines from documents")
def line_totals(t: Tables) -> DataFrame:
    """Number of lines of all documents."""
    return sinks.line_count(fanned(t.documents).select(F.explode(F.split("text", "\n")).alias("line")))
