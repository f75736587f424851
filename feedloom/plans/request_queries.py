"""Workload: dates, request expansion, resume, lookups and networks over the driver tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.functions.dates import date_set, day_of, instant, parse_span, span_column
from feedloom.functions.ips import v4_text
from feedloom.operators import enrich, requests, retry, snapshots
from feedloom.plans.registry import Tables, fanned, query
from feedloom.sources.feeds import split_items

# The first of ten-dot-zero, as a number.
_TEN = 167_772_160


def _day(column: str, pattern: str = "yyyyMMdd") -> Column:
    return F.date_format(column, pattern)


def _ranges(t: Tables) -> DataFrame:
    """Orders as sheet rows: a date, a second date by priority, reversed for status F, missing for P."""
    later = F.date_add(F.to_date("o_orderdate"), F.substring("o_orderpriority", 1, 1).cast("int") * 3)
    first, second = _day("o_orderdate"), F.date_format(later, "yyyy-MM-dd")
    return fanned(t.orders).select(
        F.col("o_orderkey"), F.col("o_custkey").cast("string").alias("ip"),
        F.when(F.col("o_orderstatus") == "F", second).otherwise(first).alias("start"),
        F.when(F.col("o_orderstatus") == "F", first).when(F.col("o_orderstatus") == "O", second).alias("end"),
    )


_RANGES = """
with r as (
  select o_orderkey, cast(o_custkey as varchar) as ip, o_orderdate::date as s,
    case when o_orderstatus = 'P' then 1 else cast(o_orderpriority[1] as int) * 3 + 1 end as days from orders
)
"""


@query(_RANGES + """
select strftime(d, '%Y%m%d') as "Timestamp", count(*) as n, count(distinct ip) as ips
from (select ip, s + cast(unnest(range(days)) as int) as d from r) group by 1
""")
def expand_days(t: Tables) -> DataFrame:
    """One request per row and day, counted per day."""
    rows = requests.expand_days(_ranges(t), "start", "end")
    return rows.groupBy("Timestamp").agg(F.count("*").alias("n"), F.countDistinct("ip").alias("ips"))


@query(_RANGES + """
select o_orderkey, count(*) as n, max(strftime(d, '%Y%m%d')) as last_day
from (select o_orderkey, s + cast(unnest(range(least(days, 7))) as int) as d from r) group by 1
""")
def expand_days_capped(t: Tables) -> DataFrame:
    rows = requests.expand_days(_ranges(t), "start", "end", cap=7)
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.max("Timestamp").alias("last_day"))


@query(_RANGES + """
select ip as "IP", strftime(s, '%Y%m%d') || ' to ' || strftime(s + 6, '%Y%m%d') as "Processed_Range",
  strftime(s + 7, '%Y%m%d') || ' to ' || strftime(s + days - 1, '%Y%m%d') as "Skipped_Range",
  'Exceeded 7-day cap. (Total span: ' || days || ' days)' as "Reason"
from r where days > 7
""")
def skipped_ranges(t: Tables) -> DataFrame:
    """Audit of the days cut by the cap."""
    return requests.skipped_ranges(_ranges(t), "ip", "start", "end", 7)


@query(_RANGES + "select cast(max(case when days > 1 then days else 0 end) as bigint) as max_days from r")
def max_span(t: Tables) -> DataFrame:
    return requests.max_span(_ranges(t), "start", "end")


@query("""
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || case cast(o_orderpriority[1] as int) when 2 then ' 13:45:00' when 5 then ' 07:08:09' else ' 00:00:00' end as instant
from orders
""")
def normalise_dates(t: Tables) -> DataFrame:
    """The order date written in five spellings, read back by one expression."""
    kind = F.substring("o_orderpriority", 1, 1)
    text = (
        F.when(kind == "1", _day("o_orderdate", "M/d/yyyy"))
        .when(kind == "2", _day("o_orderdate", "MM/dd/yy' 13:45'"))
        .when(kind == "3", F.unix_timestamp("o_orderdate").cast("string"))
        .when(kind == "4", _day("o_orderdate", "M-d-yyyy"))
        .otherwise(_day("o_orderdate", "yyyy-MM-dd'T07:08:09Z'"))
    )
    rows = fanned(t.orders).select("o_orderkey", text.alias("cell"))
    return rows.select("o_orderkey", F.date_format(instant("cell"), "yyyy-MM-dd HH:mm:ss").alias("instant"))


def _cells(t: Tables) -> DataFrame:
    """Orders as a sheet: per status a list with a range, a reversed range, or no date at all."""
    day = F.to_date("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "O", F.concat(
            F.lit("["), _day("o_orderdate", "yyyy-MM-dd"), F.lit(", '"), F.date_format(F.date_add(day, 3), "M/d/yyyy"),
            F.lit("' to "), F.date_format(F.date_add(day, 5), "yyyyMMdd"), F.lit("]")))
        .when(F.col("o_orderstatus") == "F", F.concat(F.date_format(F.date_add(day, 2), "yyyyMMdd"), F.lit("-"), _day("o_orderdate")))
        .otherwise(F.lit("n/a"))
    )
    return fanned(t.orders).select("o_orderkey", F.col("o_custkey").cast("string").alias("ip"), text.alias("date"))


_CELLS = """
with cells as (
  select o_orderkey, cast(o_custkey as varchar) as ip,
    o_orderdate::date + cast(unnest(case o_orderstatus when 'O' then [0, 3, 4, 5] when 'F' then [0, 1, 2] else [] end) as int) as d from orders
)
"""


@query(_CELLS + "select o_orderkey, strftime(d, '%Y%m%d') as day from cells")
def date_sets(t: Tables) -> DataFrame:
    """Distinct days of cells that hold lists and ranges."""
    rows = _cells(t).select("o_orderkey", F.explode(date_set("date")).alias("d"))
    return rows.select("o_orderkey", F.date_format("d", "yyyyMMdd").alias("day"))


@query("""
select event_id, strftime(ts::date + cast(unnest([-2, -1, 0, 1, 2]) as int), '%Y%m%d') as day from events where event_type <> 'view'
""")
def proximity_dates(t: Tables) -> DataFrame:
    """Days around the recorded date; the first date member is unusable on some records, missing on others."""
    bad = F.when(F.col("event_type") == "click", F.lit("none")).when(F.col("event_type") == "error", F.lit("soon"))
    good = F.when(F.col("event_type") != "view", _day("ts"))
    record = F.struct(bad.alias("Timestamp"), good.alias("Queried_Date"))
    rows = fanned(t.events).select("event_id", F.parse_json(F.to_json(record)).alias("v"))
    near = requests.proximity_dates(rows, 2)
    return near.select("event_id", F.date_format("dt", "yyyyMMdd").alias("day"))


@query(_CELLS + """
select strftime(min(d), '%Y%m%d') as first_day, strftime(max(d), '%Y%m%d') as last_day, datediff('day', min(d), max(d)) + 1 as days from cells
""")
def global_range(t: Tables) -> DataFrame:
    bounds = requests.global_range(_cells(t), "date")
    return bounds.select(
        F.date_format("first_day", "yyyyMMdd").alias("first_day"), F.date_format("last_day", "yyyyMMdd").alias("last_day"),
        F.col("days").cast("bigint").alias("days"),
    )


@query(_CELLS + """
select strftime(d, '%Y%m%d') as day, (select count(*) from customer) as n
from (select min(d) + cast(unnest(range(datediff('day', min(d), max(d)) + 1)) as int) as d from cells)
""")
def global_range_requests(t: Tables) -> DataFrame:
    """Every day of the range found in a sheet, asked for every customer."""
    days = requests.range_days(requests.global_range(_cells(t), "date"))
    rows = requests.with_dates(fanned(t.customer.select("c_custkey")), days)
    # Counted by date, so that a day is written once and not for every request.
    counts = rows.groupBy("dt").agg(F.count("*").alias("n"))
    return counts.select(F.date_format("dt", "yyyyMMdd").alias("day"), "n")


@query(_CELLS + """
, failed as (select o_orderkey, cast(o_custkey as varchar) as ip, o_orderdate::date as day, o_orderstatus as s from orders),
last as (select ip, max(o_orderkey) as o_orderkey from cells group by ip),
asked as (
  select o_orderkey, ip, day + cast(unnest([-1, 0, 1]) as int) as d from failed where s <> 'P'
  union select failed.o_orderkey, failed.ip, cells.d from failed join last on last.ip = failed.ip
    join cells on cells.ip = last.ip and cells.o_orderkey = last.o_orderkey
  union select o_orderkey, ip, unnest([date '1995-03-01', date '1995-03-02']) from failed
  union select o_orderkey, ip, null from failed
)
select coalesce(strftime(d, '%Y%m%d'), 'Current') as queried, count(*) as n, count(distinct ip) as ips from asked
where not exists (select 1 from customer where cast(c_custkey as varchar) = asked.ip
  and (c_nationkey = 3 and asked.d = date '1995-03-01' or c_nationkey = 4 and asked.d is null))
group by 1
""")
def retry_requests(t: Tables) -> DataFrame:
    """Requests for failed records on the days around their own, on the sheet's days of their ip, on named days and for the current
    state, each once, minus those that earlier outputs hold."""
    record = F.struct(F.col("o_custkey").cast("string").alias("IP"), F.when(F.col("o_orderstatus") != "P", _day("o_orderdate")).alias("Timestamp"))
    # Members that are null are left out; the key tells the records apart.
    raw = F.to_json(F.struct(record["IP"].alias("IP"), record["Timestamp"].alias("Timestamp"), F.col("o_orderkey").alias("id")))
    failed = fanned(t.orders).select(raw.alias("raw")).select("raw", bound(v=F.parse_json("raw")))
    sources = [
        retry.Around(1), retry.SheetDays(_cells(t), "ip", "date", "o_orderkey"),
        retry.Days((date(1995, 3, 1), date(1995, 3, 2))), retry.Current(),
    ]

    def output(nation: int, name: str, queried: str) -> DataFrame:
        line = F.struct(F.col("c_custkey").cast("string").alias(name), F.lit(queried).alias("Queried_Date"))
        return t.customer.filter(F.col("c_nationkey") == nation).select(F.parse_json(F.to_json(line)).alias("v"))

    done = retry.retried_keys(output(3, "IP", "19950301"), output(4, "ip", "Current"))
    asked = retry.without_done(retry.plan(failed, sources), done)
    return asked.groupBy(requests.queried_date(F.col("dt")).alias("queried")).agg(F.count("*").alias("n"), F.countDistinct("IP").alias("ips"))


@query("""
with keys as (
  select o_orderkey, o_orderstatus, cast(o_custkey as varchar) || '|' || case when o_orderpriority[1] = '5' then 'none' else strftime(o_orderdate, '%Y%m%d') end as k
  from orders
)
select o_orderkey from keys where o_orderstatus = 'O' and k not in (select k from keys where o_orderstatus <> 'O')
""")
def resume_antijoin(t: Tables) -> DataFrame:
    """Open requests minus those in the earlier ok and failed outputs."""
    day = F.when(~F.col("o_orderpriority").startswith("5"), _day("o_orderdate"))
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.concat(F.lit(" "), F.col("o_custkey")).alias("IP"), day.alias("Timestamp"))

    def output(status: str, name: str) -> DataFrame:
        record = F.struct(F.trim("IP").alias(name), "Timestamp")
        return rows.filter(F.col("o_orderstatus") == status).select(F.parse_json(F.to_json(record)).alias("v"))

    done = requests.done_keys(output("F", "ip"), output("P", "IP"))
    return requests.resume(rows.filter(F.col("o_orderstatus") == "O"), done).select("o_orderkey")


@query(_CELLS + """
, last as (select ip, max(o_orderkey) as o_orderkey from cells group by ip)
select c_custkey, strftime(d, '%Y%m%d') as day from customer join last on ip = cast(c_custkey as varchar) join cells using (ip, o_orderkey)
""")
def per_key_dates(t: Tables) -> DataFrame:
    """Each customer with the dates of the last sheet row that names any for it."""
    dates = requests.dates_per_ip(_cells(t), "ip", "date", F.col("o_orderkey"))
    records = t.customer.select("c_custkey", F.col("c_custkey").cast("string").alias("IP"))
    rows = requests.with_own_dates(records, dates)
    return rows.select("c_custkey", F.date_format("dt", "yyyyMMdd").alias("day"))


@query("""
select strftime(d, '%Y%m%d') as queried, c_mktsegment, count(*) as n
from customer, (select date '2024-01-01' + cast(unnest(range(7)) as int) as d) group by all
union all select 'Current', c_mktsegment, count(*) from customer group by all
""")
def cross_dates(t: Tables) -> DataFrame:
    """One span of days, and the current state, asked for every record."""
    records = t.customer.select("c_custkey", "c_mktsegment")
    spans = requests.with_dates(records, span_column(parse_span("20240101-20240107")))
    rows = spans.unionByName(requests.with_dates(records))
    return rows.groupBy(requests.queried_date(F.col("dt")).alias("queried"), "c_mktsegment").agg(F.count("*").alias("n"))


def _context(t: Tables) -> DataFrame:
    """Context table: last event per user and day, and the last event per user as current state."""
    record = bound(v=F.parse_json(F.to_json(F.struct("event_id", "event_type", F.col("user_id").alias("ip")))))
    rows = fanned(t.events).select(F.col("user_id").cast("string").alias("ip"), F.to_date("ts").alias("dt"), "event_id", record)
    daily = requests.last_per_key(rows, ["ip", "dt"], F.col("event_id")).drop("event_id")
    now = snapshots.latest_records(rows, F.col("event_id")).withColumn("dt", F.lit(None).cast("date"))
    return daily.unionByName(now)


def _lookups(t: Tables) -> DataFrame:
    """Requests from orders: status P asks for the current state, the market day is the day of the month."""
    day = F.make_date(F.lit(2024), F.lit(1), F.dayofmonth("o_orderdate"))
    ip = F.when(~F.col("o_orderpriority").startswith("5") | (F.col("o_orderstatus") != "P"), F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", ip.alias("IP"), F.when(F.col("o_orderstatus") != "P", day).alias("dt"))


_LOOKUP = """
with ctx as (
  select cast(user_id as varchar) as ip, ts::date as dt, max(event_id) as event_id from events group by all
  union all select cast(user_id as varchar), null, max(event_id) from events group by all
), req as (
  select o_orderkey, case when o_orderpriority[1] <> '5' or o_orderstatus <> 'P' then cast(o_custkey as varchar) end as "IP",
    case when o_orderstatus <> 'P' then make_date(2024, 1, day(o_orderdate)) end as dt from orders
), hit as (
  select req.*, ctx.event_id, event_type, user_id from req left join ctx on req."IP" = ctx.ip and req.dt is not distinct from ctx.dt
    left join events on ctx.event_id = events.event_id
)
"""


@query(_LOOKUP + """
select o_orderkey, event_id, case when event_id is null then 'failed' else 'ok' end as status,
  case when "IP" is null then 'Missing or Invalid IP' when event_id is null then '404 Not Found (No Data)' end as "Error_Reason" from hit
""")
def context_lookup(t: Tables) -> DataFrame:
    """Left join of (ip, day) requests to the context table, with the reason of each miss."""
    rows = enrich.context_lookup(_lookups(t), _context(t))
    return rows.select("o_orderkey", F.expr("try_variant_get(v, '$.event_id', 'bigint')").alias("event_id"), "status", "Error_Reason")


@query(_LOOKUP + """
select case when event_id is null then 'failed' else 'ok' end as status,
  case when event_id is not null then '{"o_orderkey":' || o_orderkey || ',"event_id":' || event_id || ',"event_type":"' || event_type || '","ip":' || user_id || '}'
  else '{"o_orderkey":' || o_orderkey || ',"IP":' || case when "IP" is null then 'null' else '"' || "IP" || '"' end || ',"Error_Reason":"'
    || case when "IP" is null then 'Missing or Invalid IP' else '404 Not Found (No Data)' end || '"}' end as value
from hit
""")
def enriched_lines(t: Tables) -> DataFrame:
    """Output lines of the lookup: request members, then context members for hits; requests with their reason for misses."""
    return enrich.enriched_json(enrich.context_lookup(_lookups(t), _context(t)).drop("dt"))


@query(_LOOKUP + """
select count(*) + (select count(*) from customer) as processed, count(event_id) as success, count(*) - count(event_id) as failed,
  (select count(*) from customer) as skipped, count(event_id)::double / (count(*) + (select count(*) from customer)) * 100 as success_pct
from hit
""")
def lookup_summary(t: Tables) -> DataFrame:
    """Run counters; the customers stand for requests skipped on resume."""
    return enrich.lookup_summary(enrich.context_lookup(_lookups(t), _context(t)), t.customer)


@query("""
select c_custkey, case when c_mktsegment = 'BUILDING' then r_name else n_name end as geo
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
""")
def geo_switch(t: Tables) -> DataFrame:
    """Geo source chosen per row."""
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    base = rows.select("c_custkey", F.col("c_nationkey").alias("ip"), F.col("n_name").alias("geo"), "c_mktsegment")
    other = nation.select(F.col("n_nationkey").alias("ip"), F.col("r_name").alias("geo"))
    return enrich.with_geo(base, other, F.col("c_mktsegment") == "BUILDING").select("c_custkey", "geo")


def _address(key: str, factor: int) -> Column:
    return v4_text((F.lit(_TEN) + F.col(key) * factor).cast("bigint"))


def _dotted(n: str) -> str:
    return f"(({n}) >> 24) || '.' || ((({n}) >> 16) & 255) || '.' || ((({n}) >> 8) & 255) || '.' || (({n}) & 255)"


def _registrations(t: Tables) -> DataFrame:
    """Registration records of the customers' addresses: two networks, only a fallback, or neither."""
    net = F.concat(_address("c_custkey", 256), F.lit("/24"))
    wide = F.concat(_address("c_nationkey", 65536), F.lit("/16"))
    value = lambda c: F.struct(c.alias("value"))
    listed = F.when(F.col("c_mktsegment") == "BUILDING", F.array(value(net), value(wide))).when(
        F.col("c_mktsegment") == "MACHINERY", F.array().cast("array<struct<value:string>>")
    )
    asn = F.when(F.col("c_mktsegment") != "FURNITURE", wide)
    record = F.struct(F.struct(listed.alias("cidr")).alias("network"), asn.alias("asn_cidr"))
    return t.customer.select(_address("c_custkey", 256).alias("ip"), F.parse_json(F.to_json(record)).alias("v"))


_REG = f"""
with reg as (
  select {_dotted(f'{_TEN} + c_custkey * 256')} as ip, unnest(case c_mktsegment
    when 'BUILDING' then [{_dotted(f'{_TEN} + c_custkey * 256')} || '/24', {_dotted(f'{_TEN} + c_nationkey * 65536')} || '/16']
    when 'FURNITURE' then [null] else [{_dotted(f'{_TEN} + c_nationkey * 65536')} || '/16'] end) as cidr
  from customer
)
"""


@query(_REG + "select * from reg")
def resolve_networks(t: Tables) -> DataFrame:
    """Networks of each address, with the fallback where none is listed."""
    return enrich.resolve_networks(_registrations(t))


@query(_REG + f"""
, feed as (select {_dotted(f'{_TEN} + n_nationkey * 65536')} || '/16' as prefix, n_name from nation),
first as (select cidr, min(ip) as ip from reg where cidr is not null group by cidr)
select prefix, n_name, ip from feed join first on prefix = cidr
""")
def prefix_join(t: Tables) -> DataFrame:
    """Feed rows whose prefix equals a resolved network, with the least address behind it."""
    feed = t.nation.select(F.concat(_address("n_nationkey", 65536), F.lit("/16")).alias("prefix"), "n_name")
    return enrich.prefix_join(feed, enrich.resolve_networks(_registrations(t)))


@query(_REG + f"""
, feed as (select {_dotted(f'{_TEN} + n_nationkey * 65536')} || '/16' as prefix, n_name from nation)
select prefix, n_name, ip from feed join (select distinct ip, cidr from reg) on prefix = cidr
""")
def prefix_join_all(t: Tables) -> DataFrame:
    feed = t.nation.select(F.concat(_address("n_nationkey", 65536), F.lit("/16")).alias("prefix"), "n_name")
    return enrich.prefix_join(feed, enrich.resolve_networks(_registrations(t)), first_only=False)


@query(f"""
with pre as (
  select p_partkey, case when p_size > 25 then 26 else 20 end as len, {_TEN} + p_partkey * 64 as n from part
), net as (select p_partkey, len, n - n % (1 << (32 - len)) as lo from pre),
one as (select lo, len, min(p_partkey) as p_partkey from net group by all),
hit as (
  select c_custkey, {_TEN} + c_custkey * 37 as n, len, p_partkey from customer
  join one on lo = ({_TEN} + c_custkey * 37) - ({_TEN} + c_custkey * 37) % (1 << (32 - len))
)
select {_dotted('n')} as ip, max_by(p_partkey, len) as p_partkey, max(len) as length from hit group by c_custkey, n
""")
def longest_prefix(t: Tables) -> DataFrame:
    """The most specific prefix that covers each address."""
    length = F.when(F.col("p_size") > 25, 26).otherwise(20)
    number = F.lit(_TEN) + F.col("p_partkey") * 64
    network = number - F.pmod(number, F.when(F.col("p_size") > 25, 64).otherwise(4096))
    pre = t.part.select(F.concat_ws("/", v4_text(network), length).alias("prefix"), "p_partkey", length.alias("length"))
    one = pre.groupBy("prefix", "length").agg(F.min("p_partkey").alias("p_partkey"))
    ips = t.customer.select(_address("c_custkey", 37).alias("ip"))
    return enrich.longest_prefix(ips, one).select("ip", "p_partkey", "length")


def _ip_lists(t: Tables) -> DataFrame:
    """One text per customer: an address, a block with host bits, and an item that is neither."""
    text = F.concat(
        _address("c_custkey", 37), F.lit(", "), _address("c_custkey", 53), F.lit("/30\n"), F.lit("x"), F.col("c_nationkey")
    )
    return split_items(t.customer.select(text.alias("cell")), "cell")


@query(f"""
with n as (
  select {_TEN} + c_custkey * 37 as n from customer
  union select {_TEN} + c_custkey * 53 - (c_custkey * 53) % 4 + unnest([0, 1, 2, 3]) from customer
)
select {_dotted('n')} as ip from n
""")
def ip_normalise(t: Tables) -> DataFrame:
    """Distinct addresses of free-form lists, blocks expanded."""
    return requests.normalise_ips(_ip_lists(t))


@query("select distinct 'x' || c_nationkey as item from customer")
def ip_rejects(t: Tables) -> DataFrame:
    return requests.rejected_ips(_ip_lists(t))


@query(f"""
with n as (select distinct {_TEN} + p_partkey * 64 + unnest(range(64)) as n from part)
select count(*) as addresses, min({_dotted('n')}) as least, max({_dotted('n')}) as greatest from n
""")
def cidr_expand(t: Tables) -> DataFrame:
    """Every address of one block per part."""
    items = t.part.select(F.concat(_address("p_partkey", 64), F.lit("/26")).alias("item"))
    ips = requests.normalise_ips(items)
    return ips.agg(F.count("*").alias("addresses"), F.min("ip").alias("least"), F.max("ip").alias("greatest"))


@query("""
with n as (select distinct p_partkey % 65536 // 4 * 4 + unnest(range(4)) as n from part)
select case when n = 0 then '2001:db8::' else '2001:db8::' || printf('%x', n) end as ip from n
union all select case when c_custkey % 7 = 0 then '::' else '1:0:0:2::' || printf('%x', c_custkey % 7) end from customer group by 1
""")
def ipv6_normalise(t: Tables) -> DataFrame:
    """Distinct canonical IPv6 addresses of networks in several spellings; what is none is left out."""
    low = F.hex(F.col("p_partkey") % 65536)
    blocks = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("2001:DB8::"), low, F.lit("/126"))).otherwise(
        F.concat(F.lit("2001:0db8:0:0:0000:0:0:"), low, F.lit("/0126"))
    )
    last = F.hex(F.col("c_custkey") % 7)
    single = F.when(F.col("c_custkey") % 7 == 0, F.lit("0::0.0.0.0%eth0")).otherwise(F.concat(F.lit("1:0:0:2:0:0:0:"), last))
    bad = F.concat(F.lit("2001:db8::1::"), F.col("c_custkey").cast("string"))
    items = t.part.select(blocks.alias("item")).unionByName(t.customer.select(F.explode(F.array(single, bad)).alias("item")))
    return requests.normalise_ips(items)


@query("""
select strftime(o_orderdate, '%Y%m') as month, count(*) as rows, count(*) filter (where o_orderstatus <> 'P') as valid from orders group by 1
""")
def valid_days(t: Tables) -> DataFrame:
    """YYYYMMDD texts that are real days; status P is written with day 32."""
    text = F.when(F.col("o_orderstatus") == "P", F.concat(_day("o_orderdate", "yyyyMM"), F.lit("32"))).otherwise(_day("o_orderdate"))
    rows = t.orders.select(_day("o_orderdate", "yyyyMM").alias("month"), text.alias("day"))
    return rows.groupBy("month").agg(F.count("*").alias("rows"), F.count_if(day_of(F.col("day")).isNotNull()).alias("valid"))


@query("""
select o_orderkey from orders where o_orderpriority[1] not in ('1', '2', '3')
""")
def valid_requests(t: Tables) -> DataFrame:
    """Requests with an ip: missing, blank and `nan` cells are dropped."""
    kind = F.substring("o_orderpriority", 1, 1)
    ip = F.when(kind == "2", F.lit(" ")).when(kind == "3", F.lit("NaN")).when(kind != "1", F.col("o_custkey").cast("string"))
    return requests.valid_requests(t.orders.select("o_orderkey", ip.alias("IP"))).select("o_orderkey")


@query("""
select count(*) filter (where event_type in ('view', 'error')) as undated from events
""")
def undated(t: Tables) -> DataFrame:
    """Records that name no date that parses."""
    stamp = F.when(F.col("event_type") == "error", F.lit("soon")).when(F.col("event_type") != "view", _day("ts"))
    rows = fanned(t.events).select("event_id", bound(v=F.parse_json(F.to_json(F.struct(stamp.alias("Timestamp"))))))
    return requests.undated(rows)
