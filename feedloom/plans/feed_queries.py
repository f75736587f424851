"""Workload: criteria filters, line filters, profiles and flattening over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.operators import lines, paths, profile
from feedloom.operators.criteria import Criterion, compile_criteria, filter_feed
from feedloom.plans.registry import Tables, fanned, query
from feedloom.sources import sinks
from feedloom.sources.feeds import parsed, tag_text


def as_feed(df: DataFrame, record: Column, *keep: str) -> DataFrame:
    """Parsed feed whose lines are the records as JSON; the text is built once."""
    lines = fanned(df).select(*keep, bound(raw=F.to_json(record)))
    return parsed(lines)


def event_feed(t: Tables) -> DataFrame:
    """Events as feed lines: props become a nested object, `note` is null, blank, `none` or text."""
    note = (
        F.when(F.col("event_type") == "click", F.lit("  "))
        .when(F.col("event_type") == "signup", F.lit("none"))
        .when(F.col("event_type") != "view", F.concat(F.lit("n-"), F.col("event_type")))
    )
    record = F.struct("event_id", "user_id", "event_type", "value", F.try_parse_json("props").alias("props"), note.alias("note"))
    return as_feed(t.events, record)


def line_feed(t: Tables) -> DataFrame:
    """Lineitems as feed lines with a list of two objects."""
    entries = F.array(
        F.struct(F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("n")),
        F.struct(F.col("l_linestatus").alias("type"), F.col("l_linenumber").cast("double").alias("n")),
    )
    record = F.struct("l_orderkey", "l_linenumber", entries.alias("tunnels"))
    return as_feed(t.lineitem, record, "l_returnflag", "l_linestatus")


def text_of(name: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(v, '$.{name}', '{kind}')").alias(name)


_K = "cast(json_extract_string(props, '$.k') as bigint)"


@query(f"""
select user_id, count(*) as n from events
where {_K} > 50 and contains(event_type, 'err') group by user_id
""")
def criteria_filter(t: Tables) -> DataFrame:
    """Feed lines whose nested number passes a bound and whose type holds a keyword, counted per user."""
    hits = filter_feed(event_feed(t), [Criterion("props_k", [">50"]), Criterion("event_type", ["err"])])
    return hits.select(text_of("user_id", "bigint")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
select event_type, count(*) as n, max(event_id) as last_event from events
where value >= 10 and value < 50 group by event_type
""")
def criteria_numeric(t: Tables) -> DataFrame:
    hits = filter_feed(event_feed(t), [Criterion("value", [">=10", "<50"])])
    rows = hits.select(text_of("event_type"), text_of("event_id", "bigint"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query("""
select event_type, count(*) as n from events
where event_type in ('view', 'click', 'signup') and not contains(event_type, 'sign') group by event_type
""")
def criteria_empty_negation(t: Tables) -> DataFrame:
    """`note` is missing, blank or the text none on three types; one of them is negated away."""
    hits = filter_feed(event_feed(t), [Criterion("note", ["=empty"]), Criterion("event_type", ["!sign"])])
    return hits.select(text_of("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""
select event_type, count(*) as n from events
where event_type = 'purchase' or {_K} <= 3 or {_K} = 97 group by event_type
""")
def criteria_or(t: Tables) -> DataFrame:
    """Whole-line search or either of two numeric keywords."""
    criteria = [Criterion(None, ['"event_type":"purchase"']), Criterion("props_k", ["<=3", "97"], "OR")]
    hits = filter_feed(event_feed(t), criteria, "OR")
    return hits.select(text_of("event_type")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""
select l_returnflag, l_linestatus, count(*) as n from lineitem
where (l_returnflag = 'R' or l_linestatus = 'R') and (l_quantity > 45 or l_linenumber > 45)
group by all
""")
def criteria_array_wildcard(t: Tables) -> DataFrame:
    """Keyword over the joined members of a list, and a number over its members one by one."""
    criteria = [Criterion("tunnels_type", ["r"]), Criterion("tunnels_n", [">45"], any_element=True)]
    hits = filter_feed(line_feed(t), criteria)
    return hits.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query(f"""
select count(*) as lines_parsed, count(*) filter (where {_K} > 50) as exported from events
""")
def filter_counters(t: Tables) -> DataFrame:
    return lines.filter_counters(event_feed(t), compile_criteria([Criterion("props_k", [">50"])]))


@query(r"""
select lang, count(*) as lines,
  count(*) filter (where regexp_matches(line, '(?i)malicious|malware|trojan')) as malicious,
  count(*) filter (where regexp_matches(line, '(?i)license|copyright')) as license
from (select lang, unnest(string_split(text, chr(10))) as line from documents) group by lang
""")
def line_regex_count(t: Tables) -> DataFrame:
    """Lines of all documents that match fixed patterns, letter case ignored."""
    rows = fanned(t.documents.select("lang", "text")).select("lang", F.explode(F.split("text", "\n")).alias("raw"))
    hit = {"malicious": lines.MALICIOUS, "license": "license|copyright"}
    counts = [F.count_if(F.col("raw").rlike(f"(?i){p}")).alias(n) for n, p in hit.items()]
    return rows.groupBy("lang").agg(F.count("*").alias("lines"), *counts)


@query(r"""
select doc_id, length(line) as chars from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
where regexp_matches(line, '(?i)license|copyright')
""")
def line_regex_filter(t: Tables) -> DataFrame:
    rows = fanned(t.documents.select("doc_id", "text")).select("doc_id", F.explode(F.split("text", "\n")).alias("raw"))
    hits = lines.line_filter(rows, "license|copyright")
    return hits.select("doc_id", F.length("raw").cast("bigint").alias("chars"))


@query("""
select count(*) filter (where n_name like 'NATION_1%') as country_raw,
  count(*) filter (where n_name like 'NATION_1%') as country_keyed,
  count(*) filter (where c_mktsegment = 'MACHINERY') as service_raw,
  count(*) filter (where c_mktsegment = 'MACHINERY') as service_keyed
from customer join nation on c_nationkey = n_nationkey
""")
def fixed_line_queries(t: Tables) -> DataFrame:
    """Text patterns on compact JSON and their structured twins agree."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    record = F.struct(F.col("n_name").alias("country"), F.array("c_mktsegment").alias("services"))
    feed = parsed(rows.select(bound(raw=F.to_json(record))))
    return feed.agg(
        F.count_if(F.col("raw").rlike('(?i)country":"NATION_1')).alias("country_raw"),
        F.count_if(lines.country_starts("NATION_1")).alias("country_keyed"),
        F.count_if(F.col("raw").rlike(r'(?i)"services":\["MACHINERY"\]')).alias("service_raw"),
        F.count_if(lines.only_service("MACHINERY")).alias("service_keyed"),
    )


# Values of every path of the event feed, as the profile sees them.
_PROFILE = rf"""
with seen as (
  select 'event_id' as path, 'number' as type, cast(event_id as varchar) as value from events
  union all select 'user_id', 'number', cast(user_id as varchar) from events
  union all select 'event_type', 'string', event_type from events
  union all select 'value', 'number', regexp_replace(cast(value as varchar), '\.0$', '') from events
  union all select 'props.k', 'number', cast({_K} as varchar) from events
  union all select 'note', 'string', case event_type when 'click' then '  ' when 'signup' then 'none' else 'n-' || event_type end
    from events where event_type <> 'view'
), counts as (select path, type, value, count(*) as cnt from seen group by all),
totals as (select path, cast(sum(cnt) as bigint) as observations, count(*) as unique_values from counts group by path),
ranked as (
  select path, type, value, cnt, row_number() over (partition by path order by cnt desc, value, type) as rank from counts
)
"""


def _profile_sql(percent: str) -> str:
    return _PROFILE + f"""
select r.path, observations, unique_values, rank, type, value, cnt as count, {percent} as percent
from ranked r join totals using (path) where rank <= 5
"""


@query(_profile_sql("cnt::double / (select count(*) from events) * 100"))
def json_profile_percent_obj(t: Tables) -> DataFrame:
    """Top five values per key path with their share of all records."""
    return profile.profile(event_feed(t), top=5)


@query(_profile_sql("cnt::double / observations * 100"))
def json_profile_percent_obs(t: Tables) -> DataFrame:
    """Top five values per key path with their share of the path's observations."""
    return profile.profile(event_feed(t), top=5, percent_of=profile.OBSERVATIONS)


@query(_PROFILE + "select path, observations, unique_values from totals")
def json_profile_totals(t: Tables) -> DataFrame:
    return profile.key_totals(profile.value_counts(event_feed(t)))


@query("""
with seen as (
  select 'tunnels.type' as path, 'string' as type, unnest([l_returnflag, l_linestatus]) as value from lineitem
  union all select 'tunnels.n', 'number', unnest([cast(cast(l_quantity as bigint) as varchar), cast(l_linenumber as varchar)]) from lineitem
)
select path, type, value, count(*) as count from seen group by all
""")
def json_profile_values(t: Tables) -> DataFrame:
    """Value counts below a list of objects; the objects themselves are not reported."""
    counts = profile.value_counts(line_feed(t))
    return counts.filter(F.col("path").startswith("tunnels"))


@query("""
select distinct unnest(['event_id', 'user_id', 'event_type', 'value', 'props.k', 'note']) as path from events
""")
def json_key_paths(t: Tables) -> DataFrame:
    return profile.key_paths(event_feed(t))


@query("select distinct unnest(['l_orderkey', 'l_linenumber', 'tunnels_type', 'tunnels_n']) as key from lineitem")
def key_suggestions(t: Tables) -> DataFrame:
    return paths.key_suggestions(line_feed(t))


@query("select distinct unnest([l_returnflag, l_linestatus]) as value from lineitem")
def value_samples(t: Tables) -> DataFrame:
    return paths.value_samples(line_feed(t), "tunnels_type")


@query("""
select cast(l_linenumber as varchar) as l_linenumber, cast(l_orderkey as varchar) as l_orderkey,
  cast(cast(l_quantity as bigint) as varchar) as tunnels_0_n, l_returnflag as tunnels_0_type,
  cast(l_linenumber as varchar) as tunnels_1_n, l_linestatus as tunnels_1_type
from lineitem
""")
def flatten_wide(t: Tables) -> DataFrame:
    """Flat text columns of every record, the key set discovered from the data."""
    return sinks.wide(line_feed(t).select("v"))


@query("""
select distinct unnest(['l_linenumber', 'l_orderkey', 'tunnels_0_n', 'tunnels_0_type', 'tunnels_1_n', 'tunnels_1_type']) as path from lineitem
""")
def flatten_paths(t: Tables) -> DataFrame:
    return paths.distinct_paths(line_feed(t))


@query(f"""
select path, count(*) as n, min(value) as least from (
  select 'props.k' as path, cast({_K} as varchar) as value from events
  union all select 'event_type', '"' || event_type || '"' from events
  union all select 'user_id', cast(user_id as varchar) from events
  union all select 'event_id', cast(event_id as varchar) from events
  union all select 'value', regexp_replace(cast(value as varchar), '\\.0$', '') from events
  union all select 'note', case event_type when 'click' then '"  "' when 'signup' then '"none"' else '"n-' || event_type || '"' end
    from events where event_type <> 'view'
) group by path
""")
def flatten_objects(t: Tables) -> DataFrame:
    """Dotted paths through objects, with counts and least value text."""
    rows = paths.leaves(event_feed(t).select("v"), paths.OBJECTS)
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.min(F.to_json("v")).alias("least"))


@query("""
select doc_id, lang from documents order by ('0x' || md5('7|' || doc_id)[1:15])::bigint, doc_id limit 100
""")
def random_sample(t: Tables) -> DataFrame:
    """A repeatable draw of 100 documents."""
    return lines.random_lines(t.documents.select("doc_id", "lang"), 100, seed=7, key=["doc_id"])


@query("""
select doc_id, n, md5(line) as digest
from (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as n, unnest(string_split(text, chr(10))) as line from documents)
order by doc_id, n limit 500
""")
def first_lines(t: Tables) -> DataFrame:
    """The first lines in document order, by their content."""
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    rows = rows.select("doc_id", (F.col("n") + 1).cast("bigint").alias("n"), "raw")
    return lines.first_lines(rows, 500, ["doc_id", "n"]).select("doc_id", "n", F.md5("raw").alias("digest"))


def _broken(record: str, n: str) -> str:
    """SQL text: a line that is whole for a remainder of 0 and has something beside one JSON value for all others."""
    return (
        f"case {n} % 6 when 0 then {record} when 1 then {record} || ' xyz' when 2 then {record} || {record} "
        f"when 3 then {record} || ',' when 4 then cast({n} as string) || ' monkeys' else 'true ' || {record} end"
    )


@query("""
select event_type, count(*) as lines, count(*) filter (where event_id % 6 = 0) as records, count(*) filter (where event_id % 6 <> 0) as malformed
from events group by event_type
""")
def malformed_line_counts(t: Tables) -> DataFrame:
    """Lines with something before, after or instead of their one JSON value are no records."""
    raw = F.expr(_broken("to_json(struct(event_id, event_type))", "event_id"))
    rows = parsed(fanned(t.events).select("event_type", raw.alias("raw")))
    return rows.groupBy("event_type").agg(
        F.count("*").alias("lines"), F.count_if(F.expr("try_variant_get(v, '$.event_id', 'bigint') is not null")).alias("records"),
        F.count_if(F.col("v").isNull()).alias("malformed"),
    )


@query(r"""
select o_orderkey, case o_orderkey % 5 when 0 then o_orderpriority when 1 then o_custkey || ' monkeys' when 2 then 'true ' || o_orderpriority
  when 3 then '"' || o_orderpriority || '" x' else o_orderpriority end as tag from orders
""")
def tag_texts(t: Tables) -> DataFrame:
    """Tags of quoted lines, objects, and raw lines that begin like JSON and go on."""
    raw = F.expr("""case o_orderkey % 5 when 0 then to_json(struct(o_orderpriority as tag)) when 1 then concat(o_custkey, ' monkeys')
        when 2 then concat('true ', o_orderpriority) when 3 then concat('"', o_orderpriority, '" x') else concat('"', o_orderpriority, '"') end""")
    rows = parsed(fanned(t.orders).select("o_orderkey", raw.alias("raw")))
    return rows.select("o_orderkey", tag_text("v", "raw").alias("tag"))


_COLLIDING = "concat('{\"a\":{\"b\":', l_linenumber, '},\"a_b\":', l_orderkey, '}')"


@query("select l_orderkey, l_linenumber, cast(l_orderkey as varchar) as a_b from lineitem")
def flatten_collisions(t: Tables) -> DataFrame:
    """Two members with one flattened name: the last in member order counts."""
    rows = parsed(fanned(t.lineitem).select("l_orderkey", "l_linenumber", F.expr(_COLLIDING).alias("raw"))).drop("raw")
    return sinks.wide(rows, ["a_b"])


@query("select l_linenumber, count(*) as n from lineitem where l_orderkey < 1000 group by l_linenumber")
def criteria_collisions(t: Tables) -> DataFrame:
    rows = parsed(fanned(t.lineitem).select("l_linenumber", F.expr(_COLLIDING).alias("raw")))
    return filter_feed(rows, [Criterion("a_b", ["<1000"])]).groupBy("l_linenumber").agg(F.count("*").alias("n"))


@query(_PROFILE + """
select path, observations, unique_values, rank, type, value, cnt as count, cnt::double / (select count(*) from events) * 100 as percent
from ranked join totals using (path) where rank <= 3 and path in ('event_type', 'props.k', 'user_id')
""")
def json_profile_selected(t: Tables) -> DataFrame:
    """Profile of the paths chosen by their position in the sorted path list."""
    feed = event_feed(t)
    return profile.profile(feed, top=3, paths=profile.pick_paths(feed, "2,4-5"))


@query(_PROFILE + """
select path as key, observations as total_occurrences, unique_values as unique_count, (select count(*) from events) as total_input_objects,
  string_agg(value || '=' || cnt, ';' order by rank) as top_values
from ranked join totals using (path) where rank <= 4 group by all
""")
def json_profile_summary(t: Tables) -> DataFrame:
    """One summary record per path, its ranked values printed as one text."""
    feed = event_feed(t)
    records = profile.summary_records(profile.profile(feed, top=4), feed)
    shown = F.transform("unique_values", lambda x: F.concat(x["value"], F.lit("="), x["count"]))
    return records.select("key", "total_occurrences", "unique_count", "total_input_objects", F.array_join(shown, ";").alias("top_values"))


@query("""
with seen as (select 'text' as path, text as value from documents union all select 'lang', lang from documents union all select 'source', source from documents),
counts as (select path, value, count(*) as cnt, case when length(value) > 30 then substr(value, 1, 30) || '...(truncated)' else value end as shown from seen group by all),
ranked as (select *, row_number() over (partition by path order by cnt desc, shown, value) as rank from counts)
select path, rank, shown as value, cnt as count, md5(value) as digest from ranked where rank <= 20
""")
def json_profile_truncated(t: Tables) -> DataFrame:
    """Whole document texts counted, and shown cut to thirty characters."""
    feed = as_feed(t.documents, F.struct("text", "lang", "source"))
    full = profile.profile(feed, top=20, truncate=30, keep_full=True)
    return full.select("path", "rank", "value", "count", F.md5("full_value").alias("digest"))
