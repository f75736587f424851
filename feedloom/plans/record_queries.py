"""Workload: last records, snapshot diffs, forensics, tags and timelines over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.operators import forensics, snapshots, tags, timeline
from feedloom.operators.grouping import last_per_key
from feedloom.plans.registry import Tables, fanned, query
from feedloom.sources import feeds

# Snapshot day between the historic and the current half of the events, as in a feed kept by date.
CUT = "2024-01-16"
# The forensic snapshot: the last two days are current, all days before are history.
NOW = "2024-01-29"

_K = "cast(json_extract_string(props, '$.k') as bigint)"
_TEXT = "regexp_replace(cast(value as varchar), '\\.0$', '')"


def _k() -> Column:
    return F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")


def _v(*columns: Column) -> Column:
    """Record as VARIANT; NULL members are left out."""
    return bound(v=F.parse_json(F.to_json(F.struct(*columns))))


def _ip(second: Column) -> Column:
    """A network-like key from two numbers."""
    parts = [F.lit("10"), F.floor(F.col("user_id") / 256).cast("string"), F.pmod("user_id", F.lit(256)).cast("string"), second.cast("string")]
    return F.concat_ws(".", *parts)


_IP = "'10.' || (user_id // 256) || '.' || (user_id % 256) || '.' || "


def _note() -> Column:
    """Missing for views, null for clicks, text otherwise."""
    text = F.concat(F.lit('"n-'), F.col("event_type"), F.lit('"'))
    return F.try_parse_json(F.when(F.col("event_type") == "click", F.lit("null")).when(F.col("event_type") != "view", text)).alias("note")


def _records(t: Tables, key: Column) -> DataFrame:
    """One record per event: (ip, day, event_id, v)."""
    high = (F.col("value") > 50).alias("high")
    stamp = F.date_format("ts", "yyyyMMdd")
    record = _v(key.alias("ip"), "event_type", "value", high, _note(), stamp.alias("Timestamp"))
    return fanned(t.events).select(key.alias("ip"), F.to_date("ts").alias("day"), "event_id", record)


@query("""
select user_id, event_id, event_type, value from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events
) where rn = 1
""")
def latest_per_key(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type", "value", "ts")
    return last_per_key(rows, ["user_id"], F.struct("ts", "event_id")).drop("ts")


@query("""
with rec as (select user_id, event_id, event_type || '|' || (value > 50) || '|' || json_extract_string(props, '$.k')::bigint % 3 as r from events),
held as (select r, lag(r) over (partition by user_id order by event_id) as before from rec)
select count(*) filter (where before = r) as identical, count(*) filter (where before <> r) as conflicting from held
""")
def dup_audit(t: Tables) -> DataFrame:
    """Repeated keys that equal, or differ from, the record held before them in feed order."""
    step = F.expr("try_variant_get(parse_json(props), '$.k', 'bigint') % 3")
    rows = t.events.select(F.col("user_id").alias("ip"), "event_id", _v("event_type", (F.col("value") > 50).alias("high"), step.alias("step")))
    return snapshots.audit_duplicates(rows, F.col("event_id"), [F.shiftright("event_id", 8)])


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = _records(t, _ip(_k()))
    old = snapshots.latest_records(rows.filter(F.col("day") < CUT), F.col("event_id"))
    new = snapshots.latest_records(rows.filter(F.col("day") >= CUT), F.col("event_id"))
    return old, new


_HALVES = f"""
with rec as (
  select {_IP} {_K} as ip, ts::date < date '{CUT}' as past, event_id, strftime(ts, '%Y%m%d') as day,
    '"' || event_type || '"' as event_type, {_TEXT} as value, case when value > 50 then 'true' else 'false' end as high,
    case event_type when 'view' then null when 'click' then 'null' else '"n-' || event_type || '"' end as note
  from events
), last as (
  select * from (select *, row_number() over (partition by ip, past order by event_id desc) as rn from rec) where rn = 1
), pair as (
  select coalesce(o.ip, n.ip) as ip, o.ip is not null as in_old, n.ip is not null as in_new, o.day as old_day, n.day as new_day,
    o.event_type as o1, n.event_type as n1, o.value as o2, n.value as n2, o.high as o3, n.high as n3, o.note as o4, n.note as n4
  from (select * from last where past) o full join (select * from last where not past) n on o.ip = n.ip
), attr as (
  select ip, 'event_type' as attribute, o1 as old, n1 as new from pair where in_old and in_new
  union all select ip, 'value', o2, n2 from pair where in_old and in_new
  union all select ip, 'high', o3, n3 from pair where in_old and in_new
  union all select ip, 'note', o4, n4 from pair where in_old and in_new
), changed as (
  select *, old is not null and old not in ('null', 'false', '0') as has_old, new is not null and new not in ('null', 'false', '0') as has_new
  from attr where coalesce(old, 'null') <> coalesce(new, 'null')
), status as (
  select ip, case when not in_new then 'REMOVED' when not in_old then 'ADDED'
    when ip in (select ip from changed) then 'MODIFIED' else 'UNCHANGED' end as status, pair.* exclude (ip) from pair
)
"""


def _record_json(side: str, day: str) -> str:
    return (
        f"""'{{"Timestamp":"' || {day} || '","event_type":' || {side}1 || ',"high":' || {side}3 || ',"ip":"' || ip || '"'"""
        f""" || case when {side}4 is null then '' else ',"note":' || {side}4 end || ',"value":' || {side}2 || '}}'"""
    )


def _changes_json() -> str:
    cell = "coalesce({o}, 'null')"
    parts = []
    for n, name in ((1, "event_type"), (3, "high"), (4, "note"), (2, "value")):
        old, new = cell.format(o=f"o{n}"), cell.format(o=f"n{n}")
        parts.append(f"""case when {old} <> {new} then '"{name}":{{"old":' || {old} || ',"new":' || {new} || '}}' end""")
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


def _unchanged_json() -> str:
    """Members that agree, a missing one with a null; what both records lack is left out."""
    parts = []
    for n, name in ((1, "event_type"), (3, "high"), (4, "note"), (2, "value")):
        same = f"coalesce(o{n}, 'null') = coalesce(n{n}, 'null') and coalesce(o{n}, n{n}) is not null"
        parts.append(f"""case when {same} then '"{name}":' || coalesce(o{n}, 'null') end""")
    return "'{' || concat_ws(',', " + ", ".join(parts) + ") || '}'"


@query(_HALVES + f"""
select ip, status, case when status = 'MODIFIED' then old_day end as historic_date,
  case when status = 'MODIFIED' then {_changes_json()} end as changes,
  case when status = 'MODIFIED' then {_unchanged_json()} end as unchanged,
  case status when 'REMOVED' then {_record_json('o', 'old_day')} when 'ADDED' then {_record_json('n', 'new_day')} end as data
from status where status <> 'UNCHANGED'
""")
def snapshot_diff_rows(t: Tables) -> DataFrame:
    """Exported rows of a snapshot diff."""
    diff = snapshots.diff_records(*_halves(t))
    return snapshots.diff_rows(diff, "20240130")


@query(_HALVES + "select ip, attribute, old, new from changed")
def snapshot_changed_attributes(t: Tables) -> DataFrame:
    return snapshots.changed_attributes(snapshots.diff_records(*_halves(t)))


@query(_HALVES + """
, counts as (
  select count(*) filter (where status <> 'ADDED') as historic, count(*) filter (where status <> 'REMOVED') as current,
    count(*) filter (where status = 'UNCHANGED') as unchanged, count(*) filter (where status = 'MODIFIED') as modified,
    count(*) filter (where status = 'REMOVED') as removed, count(*) filter (where status = 'ADDED') as added,
    count(*) filter (where ip in (select ip from changed where has_new and not has_old)) as current_richer,
    count(*) filter (where ip in (select ip from changed where has_old and not has_new)) as historic_richer
  from status
)
select *, unchanged::double / historic * 100 as unchanged_pct_historic, modified::double / historic * 100 as modified_pct_historic,
  removed::double / historic * 100 as removed_pct_historic, current_richer::double / historic * 100 as current_richer_pct_historic,
  unchanged::double / current * 100 as unchanged_pct_current, modified::double / current * 100 as modified_pct_current,
  added::double / current * 100 as added_pct_current, historic_richer::double / current * 100 as historic_richer_pct_current
from counts
""")
def snapshot_diff_summary(t: Tables) -> DataFrame:
    return snapshots.diff_summary(snapshots.diff_records(*_halves(t)))


@query(_HALVES + """
select attribute, count(*) as changed, count(*) filter (where has_new and not has_old) as gained,
  count(*) filter (where has_old and not has_new) as lost from changed group by attribute
""")
def attr_change_counts(t: Tables) -> DataFrame:
    return snapshots.attribute_counts(snapshots.diff_records(*_halves(t)))


def _forensic_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = _records(t, _ip(F.floor(_k() / 5)))
    past = rows.filter(F.col("day") < NOW).withColumn("ts", F.date_format("day", "yyyyMMdd"))
    history = forensics.history_records(past, F.col("event_id"))
    current = snapshots.latest_records(rows.filter(F.col("day") >= NOW), F.col("event_id"))
    return history, current


_FORENSIC = f"""
with rec as (
  select {_IP} ({_K} // 5) as ip, case when ts::date < date '{NOW}' then strftime(ts, '%Y%m%d') end as ts, event_id, strftime(ts, '%Y%m%d') as day,
    '"' || event_type || '"' as event_type, {_TEXT} as value, case when value > 50 then 'true' else 'false' end as high,
    case event_type when 'view' then null when 'click' then 'null' else '"n-' || event_type || '"' end as note
  from events
), last as (
  select * from (select *, row_number() over (partition by ip, ts order by event_id desc) as rn from rec) where rn = 1
), pool as (
  select ip, count(ts) as dates, case when count(ts) = 0 then 'EMERGING' when count(*) = count(ts) then 'AGED_OUT' else 'CONTINUOUS' end as status
  from last group by ip
), cells as (
  select ip, ts, 'event_type' as attribute, event_type as value from last
  union all select ip, ts, 'value', value from last
  union all select ip, ts, 'high', high from last
  union all select ip, ts, 'note', note from last where note is not null
), keyed as (
  select distinct ip, attribute, status from cells join pool using (ip) where status = 'CONTINUOUS'
), grid as (
  select k.ip, k.attribute, l.ts, coalesce(c.value, 'null') as value
  from keyed k join last l on k.ip = l.ip left join cells c on c.ip = k.ip and c.attribute = k.attribute and c.ts is not distinct from l.ts
), flags as (
  select ip, attribute, max(value) filter (where ts is null) as current_value, count(distinct value) > 1 as changed,
    count(distinct value) filter (where ts is not null) > 1 as multi,
    bool_or(ts is not null and value not in ('null', 'false', '0')) as past_data,
    bool_or(ts is null and value not in ('null', 'false', '0')) as now_data
  from grid group by ip, attribute
), states as (
  select ip, attribute, current_value, changed, changed and multi as multi_stage, changed and past_data and not now_data as transient,
    changed and now_data and not past_data as escalating from flags
)
"""

_WHOLE = (
    """'{"Timestamp":"' || day || '","event_type":' || event_type || ',"high":' || high || ',"ip":"' || ip || '"'"""
    """ || case when note is null then '' else ',"note":' || note end || ',"value":' || value || '}'"""
)


@query(_FORENSIC + "select ip, status, dates from pool")
def forensic_status(t: Tables) -> DataFrame:
    return forensics.key_status(*_forensic_sides(t))


@query(_FORENSIC + "select * from states")
def forensic_attr_states(t: Tables) -> DataFrame:
    return forensics.attribute_states(*_forensic_sides(t))


@query(_FORENSIC + f"""
select ip, 'CONTINUOUS' as status, 'timeline' as section, attribute, ts, value from grid join states using (ip, attribute) where changed and ts is not null
union all select ip, 'CONTINUOUS', case when changed then 'current' else 'unchanged' end, attribute,
  case when changed then '20240130' end, current_value from states
union all select ip, status, 'history', null, ts, {_WHOLE} from last join pool using (ip) where status = 'AGED_OUT'
union all select ip, status, 'data', null, '20240130', {_WHOLE} from last join pool using (ip) where status = 'EMERGING'
""")
def forensic_rows(t: Tables) -> DataFrame:
    """Long export of the history-versus-current classification."""
    return forensics.forensic_rows(*_forensic_sides(t), "20240130")


@query(_FORENSIC + """
, p as (select count(*) as pool, count(*) filter (where status = 'CONTINUOUS') as continuous, count(*) filter (where status = 'AGED_OUT') as aged_out,
    count(*) filter (where status = 'EMERGING') as emerging from pool),
k as (select count(distinct ip) filter (where transient) as transient, count(distinct ip) filter (where multi_stage) as multi_stage,
    count(distinct ip) filter (where escalating) as escalating from states)
select *, continuous::double / pool * 100 as continuous_pct, aged_out::double / pool * 100 as aged_out_pct, emerging::double / pool * 100 as emerging_pct,
  transient::double / continuous * 100 as transient_pct, multi_stage::double / continuous * 100 as multi_stage_pct,
  escalating::double / continuous * 100 as escalating_pct from p, k
""")
def forensic_summary(t: Tables) -> DataFrame:
    return forensics.forensic_summary(*_forensic_sides(t))


@query(_FORENSIC + """
select attribute, count(*) filter (where transient) as aged_out, count(*) filter (where escalating) as new_current
from states group by attribute having count(*) filter (where transient or escalating) > 0
""")
def forensic_attr_counts(t: Tables) -> DataFrame:
    return forensics.forensic_attribute_counts(forensics.attribute_states(*_forensic_sides(t)))


def _tag_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Tag snapshots before and after the cut: views carry no categories, clicks no description."""
    kinds = F.when(F.col("event_type") != "view", F.array(F.upper("event_type"), F.when(F.col("value") > 50, F.lit("HIGH")).otherwise(F.lit("LOW"))))
    words = F.when(F.col("event_type") != "click", F.concat(F.lit("seen as "), F.col("event_type")))
    tag = F.concat_ws("-", F.concat(F.lit("U"), F.col("user_id")), _k()).alias("tag")
    rows = fanned(t.events).select("event_id", F.to_date("ts").alias("day"), _v(tag, kinds.alias("categories"), words.alias("description")))
    old = tags.tag_records(rows.filter(F.col("day") < CUT), F.col("event_id"))
    new = tags.tag_records(rows.filter(F.col("day") >= CUT), F.col("event_id"))
    return old, new


_TAGS = f"""
with rec as (
  select 'U' || user_id || '-' || {_K} as tag, ts::date < date '{CUT}' as past, event_id, event_type, value from events
), last as (
  select * from (select *, row_number() over (partition by tag, past order by event_id desc) as rn from rec) where rn = 1
), added as (select * from last where not past and tag not in (select tag from last where past))
"""


@query(_TAGS + """
select tag, case when bool_or(past) then 'removed' else 'added' end as change from last group by tag having count(*) = 1
""")
def tag_diff(t: Tables) -> DataFrame:
    return tags.tag_diff(*_tag_sides(t))


@query(_TAGS + """
select category, count(*) as count from (
  select unnest(case when event_type = 'view' then ['Uncategorized'] else [upper(event_type), case when value > 50 then 'HIGH' else 'LOW' end] end) as category
  from added) group by category
""")
def tag_category_counts(t: Tables) -> DataFrame:
    return tags.category_counts(tags.added_records(*_tag_sides(t)))


@query(_TAGS + """
select tag, case when event_type = 'view' then 'None' else upper(event_type) || ', ' || case when value > 50 then 'HIGH' else 'LOW' end end as categories,
  case when event_type = 'click' then 'No description provided.' else 'seen as ' || event_type end as description from added
""")
def tag_details(t: Tables) -> DataFrame:
    return tags.tag_details(tags.added_records(*_tag_sides(t)))


@query(_TAGS + """
, meta as (select 'U' || c_custkey || '-' || c_nationkey as tag, c_name as name from customer)
select tag, name from added join meta using (tag)
""")
def tag_metadata(t: Tables) -> DataFrame:
    """Metadata of the added tags, read from a table in place of a lookup service."""
    tag = F.concat_ws("-", F.concat(F.lit("U"), F.col("c_custkey")), F.col("c_nationkey"))
    meta = t.customer.select(tag.alias("tag"), F.col("c_name").alias("name"))
    return tags.tag_metadata(tags.added_records(*_tag_sides(t)), meta)


def _daily(t: Tables) -> DataFrame:
    """(ip, dt, v): last event per user and day, nested."""
    client = F.struct(_k().alias("count"), F.struct(F.col("event_type").alias("kind")).alias("seen")).alias("client")
    rows = fanned(t.events).select(
        F.col("user_id").alias("ip"), F.to_date("ts").alias("dt"), "event_id", _v("event_type", "value", client, _note())
    )
    return timeline.daily_series(rows, F.col("event_id"))


_DAILY = f"""
with rec as (
  select user_id as ip, ts::date as dt, event_id, '"' || event_type || '"' as event_type, {_TEXT} as value, cast({_K} as varchar) as k,
    case event_type when 'view' then null when 'click' then 'null' else '"n-' || event_type || '"' end as note from events
), day as (
  select * from (select *, row_number() over (partition by ip, dt order by event_id desc) as rn from rec) where rn = 1
), step as (
  select *, lag(dt) over w is not null as later, lag(event_type) over w as p1, lag(value) over w as p2, lag(k) over w as p3, lag(note) over w as p4,
    min(dt) over (partition by ip) as first_dt, max(dt) over (partition by ip) as last_dt
  from day window w as (partition by ip order by dt)
), diff as (
  select ip, dt, 'event_type' as path, p1 as old_value, event_type as new_value from step where later
  union all select ip, dt, 'client.seen.kind', p1, event_type from step where later
  union all select ip, dt, 'value', p2, value from step where later
  union all select ip, dt, 'client.count', p3, k from step where later
  union all select ip, dt, 'note', p4, note from step where later
), changes as (
  select ip, dt, path, case when old_value is null then 'added' when new_value is null then 'removed' else 'changed' end as change, old_value, new_value
  from diff where old_value is distinct from new_value
)
"""

_DAY_JSON = (
    """'{"client":{"count":' || k || ',"seen":{"kind":' || event_type || '}},"event_type":' || event_type"""
    """ || case when note is null then '' else ',"note":' || note end || ',"value":' || value || '}'"""
)


@query(_DAILY + "select * from changes")
def daily_deep_diff(t: Tables) -> DataFrame:
    """Differences between consecutive days of every key, nested members by dotted path."""
    return timeline.daily_changes(_daily(t))


@query(_DAILY + f"""
select ip, dt, 'Change' as event, path, change, old_value, new_value from changes
union all select ip, dt, 'Initial Context', null, null, null, {_DAY_JSON} from step where dt = first_dt
union all select ip, dt, 'Final Context', null, null, null, {_DAY_JSON} from step where dt = last_dt and first_dt < last_dt
""")
def timeline_events(t: Tables) -> DataFrame:
    return timeline.timeline_events(_daily(t))


@query(_DAILY + """
select ip, dt, new_value::bigint - old_value::bigint as delta, case when new_value::bigint > old_value::bigint then 'up' else 'down' end as direction
from changes where path = 'client.count'
""")
def count_delta(t: Tables) -> DataFrame:
    rows = timeline.daily_changes(_daily(t))
    delta = timeline.count_delta(F.col("path"), F.col("old_value"), F.col("new_value"))
    return rows.withColumns(delta).filter(F.col("delta").isNotNull()).select("ip", "dt", "delta", "direction")


def _daily_types(t: Tables) -> DataFrame:
    """(ip, dt, v): event types seen per user and day, as a list below `client`."""
    seen = t.events.groupBy(F.col("user_id").alias("ip"), F.to_date("ts").alias("dt")).agg(F.sort_array(F.collect_set("event_type")).alias("types"))
    return seen.select("ip", "dt", _v(F.struct("types").alias("client")))


_TYPES = """
with day as (select user_id as ip, ts::date as dt, list_sort(list(distinct event_type)) as types from events group by all)
"""


@query(_TYPES + """
, step as (select ip, dt, types, lag(types) over (partition by ip order by dt) as before from day)
select ip, dt, array_to_string(list_filter(types, lambda x: not list_contains(before, x)), ',') as added,
  array_to_string(list_filter(before, lambda x: not list_contains(types, x)), ',') as removed
from step where before is not null and before <> types
""")
def list_delta(t: Tables) -> DataFrame:
    """Members a daily list gained and lost."""
    rows = timeline.daily_changes(_daily_types(t)).filter(F.col("path") == "client.types")
    delta = timeline.list_delta("old_value", "new_value")
    plain = {n: F.regexp_replace(F.array_join(c, ","), '"', "") for n, c in delta.items()}
    return rows.withColumns(plain).select("ip", "dt", "added", "removed")


_ISLANDS = _TYPES + """
, hit as (select ip, dt, list_contains(types, 'error') as hit, max(dt) over (partition by ip) as last_dt,
    row_number() over (partition by ip order by dt) as n from day),
runs as (select ip, min(dt) as s, max(dt) as e, any_value(last_dt) as last_dt
  from (select *, n - row_number() over (partition by ip order by dt) as run from hit where hit) group by ip, run)
"""


@query(_ISLANDS + """
select ip, strftime(s, '%Y%m%d') as start, case when e = last_dt then 'Present' else strftime(e, '%Y%m%d') end as "end" from runs
""")
def presence_intervals(t: Tables) -> DataFrame:
    """Runs of days on which a list holds a value."""
    return timeline.presence_intervals(_daily_types(t), "client.types", "error")


@query(_ISLANDS + """
select c_custkey as ip, strftime(s, '%Y%m%d') as start, case when e = last_dt then 'Present' else strftime(e, '%Y%m%d') end as "end"
from customer left join runs on ip = c_custkey
""")
def presence_of_listed(t: Tables) -> DataFrame:
    """The same for a given list of keys, those without any match included."""
    listed = t.customer.select(F.col("c_custkey").alias("ip"))
    return timeline.presence_intervals(_daily_types(t), "client.types", "error", listed)


@query(_HALVES + """
select count(*) as pool, count(*) filter (where in_old and in_new) as shared, count(*) filter (where not in_new) as removed,
  count(*) filter (where not in_old) as added from pair
""")
def key_sets(t: Tables) -> DataFrame:
    """Union, intersection and both differences of the keys of two snapshots."""
    rows = snapshots.matched(*_halves(t))
    return rows.agg(
        F.count("*").alias("pool"),
        F.count_if(F.col("in_old") & F.col("in_new")).alias("shared"),
        F.count_if(F.col("in_new").isNull()).alias("removed"),
        F.count_if(F.col("in_old").isNull()).alias("added"),
    )


@query("""
select l_returnflag, count(*) as n from lineitem where l_discount > 0.05 and l_quantity <> l_linenumber group by l_returnflag
""")
def unordered_list_diff(t: Tables) -> DataFrame:
    """Lists of objects compared without order, at both levels; only a changed member counts."""
    other = F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(F.col("l_linenumber").cast("double"))

    def member(kind: str, n: Column, reverse: bool) -> Column:
        pair = [F.lit(kind), F.lit("x")]
        return F.struct(n.alias("n"), F.array(*(reversed(pair) if reverse else pair)).alias("tags"))

    line = F.col("l_linenumber").cast("double")
    old = F.array(member("a", line, False), member("b", F.lit(1.0), False))
    new = F.array(member("b", F.lit(1.0), True), member("a", other, True))
    rows = fanned(t.lineitem).select(
        "l_returnflag", bound(old_v=F.parse_json(F.to_json(F.struct(old.alias("l")))), new_v=F.parse_json(F.to_json(F.struct(new.alias("l")))))
    )
    return timeline.deep_diff(rows).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("""
select cast(c_custkey as varchar) as ip, c_mktsegment from customer where c_mktsegment <> 'FURNITURE'
""")
def keyed_records(t: Tables) -> DataFrame:
    """Records keyed by their ip member in any spelling; those without one are dropped."""
    ip = F.concat(F.lit(" "), F.col("c_custkey"))
    segment = F.col("c_mktsegment")
    record = F.struct(
        F.when(segment == "BUILDING", ip).alias("ip"), F.when(segment == "MACHINERY", ip).alias("IP_Address"),
        F.when(~segment.isin("BUILDING", "MACHINERY", "FURNITURE"), ip).alias("IpAddress"), "c_mktsegment",
    )
    rows = t.customer.select("c_mktsegment", bound(v=F.parse_json(F.to_json(record))))
    return feeds.keyed_records(rows).select("ip", "c_mktsegment")
