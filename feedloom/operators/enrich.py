"""Lookups as joins: context by (ip, day), geo by network prefix, networks by ip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.functions.dates import day_text
from feedloom.functions.ips import v4_cidr, v4_network, v4_number
from feedloom.functions.sqltext import as_array, as_object
from feedloom.functions.text import has_ip, percent

OK, FAILED = "ok", "failed"
CURRENT = "current"

# Reasons written to failed rows.
NO_DATA = "404 Not Found (No Data)"
BAD_IP = "Missing or Invalid IP"


def merge_records(left: str, right: str, drop: list[str] | None = None) -> Column:
    """Two map<key, VARIANT> expressions as one: the right side wins, `drop` leaves members out."""
    merged = f"map_concat({left}, coalesce({right}, map()))"
    if drop:
        names = ", ".join(f"'{d}'" for d in drop)
        merged = f"map_filter({merged}, (k, x) -> k not in ({names}))"
    return F.expr(merged)


def context_lookup(
    requests: DataFrame, context: DataFrame, today: Column | None = None, ip: str = "IP", dt: str = "dt", name_day: bool = False
) -> DataFrame:
    """Left join of requests to the context table (ip, dt, v): adds v, status and Error_Reason.

    The table holds the current state under a NULL dt; a request without a day, or for `today`,
    reads it. A hot (ip, day) sits on the request side only, the table has one row per key, so
    adaptive execution may split it. name_day adds the day to the reason of a miss.
    """
    day = F.col(dt) if today is None else F.when(F.col(dt) != today, F.col(dt))
    asked = requests.withColumn("_day", F.coalesce(day_text(day), F.lit(CURRENT)))
    # Only the days asked for are read: on a table partitioned by dt this prunes folders.
    span = requests.agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi"))).scalar()
    known = context.filter(F.col("dt").isNull() | F.col("dt").between(span["lo"], span["hi"])).select(
        F.col("ip").alias("_ip"), F.coalesce(day_text(F.col("dt")), F.lit(CURRENT)).alias("_known_day"), F.col("v"), F.lit(True).alias("_hit")
    )
    valid = F.coalesce(has_ip(F.col(ip)), F.lit(False))
    # Requests without an ip match nothing; a key of their own keeps them from meeting in one task.
    apart = F.concat(F.lit("\u0000"), F.xxhash64(*requests.columns).cast("string"))
    asked = asked.withColumn("_asked", F.when(valid, F.col(ip)).otherwise(apart))
    joined = asked.join(known, (F.col("_asked") == F.col("_ip")) & (F.col("_day") == F.col("_known_day")), "left")
    miss = F.lit(NO_DATA)
    if name_day:
        shown = F.coalesce(day_text(F.col(dt)), F.lit("Current"))
        miss = F.concat(F.lit("404 Not Found (No Data for "), shown, F.lit(")"))
    hit = F.col("_hit").isNotNull()
    reason = F.when(~valid, F.lit(BAD_IP)).when(~hit, miss)
    out = joined.withColumns({"Error_Reason": reason, "status": F.when(hit, F.lit(OK)).otherwise(F.lit(FAILED))})
    return out.drop("_day", "_asked", "_ip", "_known_day", "_hit")


def enriched_json(df: DataFrame, ip: str = "IP") -> DataFrame:
    """Output lines of a lookup: (status, value).

    A hit is the request merged with the context, context members winning and `IP` dropped; a miss
    is the request with its Error_Reason.
    """
    inner = [c for c in df.columns if c not in ("v", "status", "Error_Reason")]
    # A map keeps the order of the request columns, a parsed record would sort them.
    cells = [x for c in inner for x in (F.lit(c), F.coalesce(F.col(c).cast("variant"), F.parse_json(F.lit("null"))))]
    failed = F.to_json(F.struct(*inner, "Error_Reason"), {"ignoreNullFields": "false"})
    rows = df.select("status", F.create_map(*cells).alias("r"), "v", failed.alias("failed"))
    merged = F.to_json(merge_records("r", as_object("v"), [ip, "Error_Reason"]))
    return rows.select("status", F.when(F.col("status") == OK, merged).otherwise(F.col("failed")).alias("value"))


def lookup_summary(df: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row of run counters; requests skipped on resume count as processed."""
    counts = df.agg(
        F.count_if(F.col("status") == OK).alias("success"), F.count_if(F.col("status") == FAILED).alias("failed")
    )
    n = F.lit(0).cast("bigint") if skipped is None else skipped.agg(F.count("*")).scalar()
    counts = counts.withColumn("skipped", n)
    total = F.col("success") + F.col("failed") + F.col("skipped")
    return counts.select(total.alias("processed"), "success", "failed", "skipped", percent(F.col("success"), total).alias("success_pct"))


def with_geo(df: DataFrame, alternative: DataFrame, use_alternative: Column, ip: str = "ip") -> DataFrame:
    """Choose the geo source per row: `geo` of the alternative table (ip, geo) where asked for and known."""
    alt = alternative.select(F.col("ip").alias("_ip"), F.col("geo").alias("_alt"))
    joined = df.join(alt, use_alternative & (F.col(ip) == F.col("_ip")), "left")
    return joined.withColumn("geo", F.coalesce("_alt", "geo")).drop("_ip", "_alt")


def resolve_networks(registration: DataFrame, v: str = "v", ip: str = "ip") -> DataFrame:
    """(ip, cidr) of registration records: the values of `network.cidr`, else `asn_cidr`, else a NULL cidr."""
    listed = as_array(f"try_variant_get({v}, '$.network.cidr', 'variant')")
    values = f"filter(transform({listed}, c -> try_variant_get(c, '$.value', 'string')), c -> c is not null)"
    asn = f"nullif(try_variant_get({v}, '$.asn_cidr', 'string'), '')"
    cidrs = F.expr(f"if(size({listed}) > 0, {values}, array({asn}))")
    return registration.select(ip, F.explode(cidrs).alias("cidr"))


def prefix_join(feed: DataFrame, resolved: DataFrame, first_only: bool = True, prefix: str = "prefix") -> DataFrame:
    """Feed rows whose prefix text equals a resolved CIDR, with the ip it was resolved from.

    first_only keeps the least ip per CIDR, one output row per feed row; otherwise every ip is given.
    """
    known = resolved.filter(F.col("cidr").isNotNull() & (F.col("cidr") != "") & ~F.contains("cidr", F.lit("Error")))
    if first_only:
        known = known.groupBy("cidr").agg(F.min("ip").alias("ip"))
    else:
        known = known.select("cidr", "ip").distinct()
    return feed.join(known, F.col(prefix) == F.col("cidr")).drop("cidr")


def longest_prefix(ips: DataFrame, prefixes: DataFrame, ip: str = "ip", prefix: str = "prefix") -> DataFrame:
    """Every distinct IPv4 address with the longest prefix that covers it, and that row's other columns.

    Each address is tried only at the prefix lengths that occur (33 at most), by equality on
    (network, length): no range join. Addresses without a match are left out.
    """
    cidr = v4_cidr(F.col(prefix))
    table = prefixes.select("*", bound(_network=cidr["network"], _length=cidr["length"])).filter(F.col("_length").isNotNull())
    lengths = table.agg(F.collect_set("_length")).scalar()
    tried = ips.select(ip).distinct().select(ip, bound(_n=v4_number(F.col(ip)))).filter(F.col("_n").isNotNull())
    tried = tried.withColumn("_length", F.explode(lengths)).withColumn("_network", v4_network(F.col("_n"), F.col("_length")))
    rest = [c for c in prefixes.columns if c != ip]
    hits = tried.join(table, ["_network", "_length"])
    # Rows with the same prefix are told apart by their own values; the least counts.
    best = hits.groupBy(ip).agg(F.min(F.struct((-F.col("_length")).alias("_rank"), *rest)).alias("r"))
    return best.select(ip, *[F.col("r")[c].alias(c) for c in rest])
