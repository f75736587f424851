"""Lookup requests: column discovery, day expansion, date sets, resume, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.functions.dates import date_set, day_text, instant, span_days
from feedloom.functions.ips import v4_cidr, v4_number, v4_text, v6_parts, v6_text
from feedloom.functions.sqltext import as_object
from feedloom.functions.text import has_ip, request_key, strip
from feedloom.operators.grouping import last_per_key

# Members that may hold the date of a failed record, in order.
DATE_FIELDS = ["Timestamp", "Queried_Date", "date", "time"]

MAX_EXPAND = 1_000_000
_BLOCK = 65_536


def map_columns(columns: list[str]) -> tuple[str, str | None, str | None]:
    """(ip, start, end) columns found by name; a single date column serves as both ends.

    Each name is tested for ip, start, end, timestamp in this order and fills the first role it
    fits that is still open. Pass columns explicitly where a name such as `vendor` would mislead.
    """
    roles: dict[str, str] = {}
    tests = [
        ("ip", lambda n: "ip address" in n or "ips" in n or n == "ip"),
        ("start", lambda n: "first" in n or "start" in n),
        ("end", lambda n: "last" in n or "end" in n),
        ("stamp", lambda n: "timestamp" in n or "date" in n),
    ]
    for column in columns:
        name = column.lower().strip()
        role = next((r for r, fits in tests if fits(name) and r not in roles), None)
        if role:
            roles[role] = column
    if "ip" not in roles:
        raise ValueError("no ip column found (for example `IP Address` or `IP`)")
    start, end, stamp = roles.get("start"), roles.get("end"), roles.get("stamp")
    if not start and not end:
        return roles["ip"], stamp, stamp
    return roles["ip"], start or end, end or start


def map_columns_loosely(columns: list[str]) -> tuple[str, str]:
    """(ip, date) columns: the first name containing `ip`, and the first with `timestamp`, `date` or `time`."""
    names = [(c, c.lower().strip()) for c in columns]
    ip = next((c for c, n in names if "ip" in n), None)
    stamp = next((c for c, n in names if any(w in n for w in ("timestamp", "date", "time"))), None)
    if ip is None or stamp is None:
        raise ValueError("the sheet needs an ip column and a date or timestamp column")
    return ip, stamp


def _spans(df: DataFrame, start: str, end: str) -> DataFrame:
    """Add _lo, _hi (ordered instants, one-sided dates filled in) and _days."""
    s, e = instant(start), instant(end)
    rows = df.select("*", bound(_s=s, _e=e))
    rows = rows.withColumns({"_lo": F.least("_s", "_e"), "_hi": F.greatest("_s", "_e")})
    return rows.withColumn("_days", span_days(F.col("_lo"), F.col("_hi")))


def expand_days(df: DataFrame, start: str | None, end: str | None = None, cap: int | None = None, historic: bool = True) -> DataFrame:
    """One row per day from start to end with `Timestamp` YYYYMMDD; the date columns are dropped.

    Rows without a parsable date, and all rows when `historic` is off, stay one row with no day.
    With a cap only the first `cap` days are kept; `skipped_ranges` reports the rest.
    """
    end = end or start
    keep = [c for c in df.columns if c not in (start, end)]
    if not historic or not start:
        return df.select(*keep, F.lit(None).cast("string").alias("Timestamp"))
    rows = _spans(df, start, end)
    days = F.when(F.col("_days") > cap, F.lit(cap)).otherwise(F.col("_days")) if cap else F.col("_days")
    offsets = F.sequence(F.lit(0), (days - 1).cast("int"))
    rows = rows.select(*keep, "_lo", F.explode_outer(offsets).alias("_offset"))
    return rows.select(*keep, day_text(F.date_add(F.to_date("_lo"), F.col("_offset"))).alias("Timestamp"))


def skipped_ranges(df: DataFrame, ip: str, start: str, end: str, cap: int) -> DataFrame:
    """Audit rows (IP, Processed_Range, Skipped_Range, Reason) of the spans longer than the cap."""
    rows = _spans(df, start, end).filter(F.col("_days") > cap)
    first, last = F.to_date("_lo"), F.to_date("_hi")

    def span(a: Column, b: Column) -> Column:
        return F.concat(day_text(a), F.lit(" to "), day_text(b))

    reason = F.concat(F.lit(f"Exceeded {cap}-day cap. (Total span: "), F.col("_days").cast("string"), F.lit(" days)"))
    return rows.select(
        F.col(ip).alias("IP"),
        span(first, F.date_add(first, cap - 1)).alias("Processed_Range"),
        span(F.date_add(first, cap), last).alias("Skipped_Range"),
        reason.alias("Reason"),
    )


def max_span(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row: the longest span in days over rows that have both dates, else 0."""
    days = F.when(F.col("_s").isNotNull() & F.col("_e").isNotNull(), F.col("_days"))
    return _spans(df, start, end).agg(F.coalesce(F.max(days), F.lit(0)).cast("bigint").alias("max_days"))


def valid_requests(df: DataFrame, ip: str = "IP") -> DataFrame:
    return df.filter(has_ip(F.col(ip)))


def done_keys(*outputs: DataFrame) -> DataFrame:
    """Keys of earlier outputs (ok and failed): records with `ip` or `IP` and an optional `Timestamp`."""
    keys = []
    for df in outputs:
        ip = F.coalesce(F.expr("try_variant_get(v, '$.ip', 'string')"), F.expr("try_variant_get(v, '$.IP', 'string')"))
        day = F.expr("try_variant_get(v, '$.Timestamp', 'string')")
        keys.append(df.select(ip.alias("ip"), day.alias("day")))
    rows = keys[0]
    for more in keys[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.filter(has_ip(F.col("ip"))).select(request_key(F.col("ip"), F.col("day")).alias("request_key")).distinct()


def _by_key(df: DataFrame, done: DataFrame, how: str, ip: str, day: str) -> DataFrame:
    keyed = df.withColumn("request_key", request_key(F.col(ip), F.col(day)))
    return keyed.join(done, "request_key", how).drop("request_key")


def resume(df: DataFrame, done: DataFrame, ip: str = "IP", day: str = "Timestamp") -> DataFrame:
    """Requests whose key is not among the done keys."""
    return _by_key(df, done, "left_anti", ip, day)


def skipped(df: DataFrame, done: DataFrame, ip: str = "IP", day: str = "Timestamp") -> DataFrame:
    """Requests whose key is among the done keys."""
    return _by_key(df, done, "left_semi", ip, day)


def marked_done(df: DataFrame, done: DataFrame, name: str, ip: str = "IP", day: str = "Timestamp") -> DataFrame:
    """All requests, with the column `name`: whether the key is among the (distinct) done keys."""
    known = done.withColumn(name, F.lit(True))
    return _by_key(df, known, "left", ip, day).withColumn(name, F.coalesce(name, F.lit(False)))


def dates_per_ip(sheet: DataFrame, ip: str, stamp: str, seq: Column) -> DataFrame:
    """(ip, dates): date set of the last row per ip that names any date."""
    rows = sheet.select(strip(F.col(ip).cast("string")).alias("ip"), seq.alias("seq"), bound(dates=date_set(stamp)))
    return last_per_key(rows.filter(F.size("dates") > 0), ["ip"], F.col("seq")).drop("seq")


def with_own_dates(records: DataFrame, dates: DataFrame, ip: str = "IP") -> DataFrame:
    """Records times the dates of their own ip (exact match); `dt` is a DATE."""
    own = dates.withColumnRenamed("ip", ip) if ip != "ip" else dates
    return records.join(own, ip).withColumn("dt", F.explode("dates")).drop("dates")


def with_dates(records: DataFrame, dates: Column | None = None) -> DataFrame:
    """Records times one set of dates (an array Column); no set means the current state, `dt` NULL."""
    if dates is None:
        return records.withColumn("dt", F.lit(None).cast("date"))
    return records.withColumn("dt", F.explode(dates))


def global_range(sheet: DataFrame, stamp: str) -> DataFrame:
    """One row: first and last date named in the sheet, and the days between, both ends included."""
    days = sheet.select(F.explode(date_set(stamp)).alias("d"))
    return days.agg(
        F.min("d").alias("first_day"), F.max("d").alias("last_day"), (F.datediff(F.max("d"), F.min("d")) + 1).alias("days")
    )


def range_days(bounds: DataFrame) -> Column:
    """All days of a `global_range`, as a scalar subquery."""
    return bounds.select(F.sequence("first_day", "last_day")).scalar()


def record_dates(df: DataFrame, v: str = "v") -> DataFrame:
    """Add `_days`: the days of a failed record, NULL if it names none.

    Of the date members, in their fixed order, the first that parses counts. A member is found by
    part of its name, letter case ignored.
    """
    names = [f"_stamp_{i}" for i in range(len(DATE_FIELDS))]
    members = f"transform_keys({as_object(v)}, (k, x) -> lower(k))"
    rows = df.select("*", bound(_members=F.expr(members)))
    for name, member in zip(names, DATE_FIELDS):
        found = f"map_values(map_filter(_members, (k, x) -> contains(k, '{member.lower()}')))"
        rows = rows.withColumn(name, F.expr(f"try_cast(try_element_at({found}, 1) as string)"))
    rows = rows.select("*", bound(**{f"{n}_set": date_set(n) for n in names}))
    usable = [F.when(F.size(f"{n}_set") > 0, F.col(f"{n}_set")) for n in names]
    return rows.withColumn("_days", F.coalesce(*usable)).drop("_members", *names, *[f"{n}_set" for n in names])


def proximity_dates(df: DataFrame, buffer_days: int, v: str = "v") -> DataFrame:
    """Rows times every day within `buffer_days` of a day of the record; records without one are left out."""
    if buffer_days < 0:
        raise ValueError("buffer_days must not be negative")
    around = F.transform("_days", lambda d: F.sequence(F.date_sub(d, buffer_days), F.date_add(d, buffer_days)))
    return record_dates(df, v).withColumn("dt", F.explode(F.array_distinct(F.flatten(around)))).drop("_days")


def undated(df: DataFrame, v: str = "v") -> DataFrame:
    """One row: records that name no parsable date."""
    return record_dates(df, v).agg(F.count_if(F.col("_days").isNull()).alias("undated"))


def queried_date(dt: Column) -> Column:
    """Display text of a request's day."""
    return F.coalesce(day_text(dt), F.lit("Current"))


def _networks(items: DataFrame, max_expand: int, on_large: str, distinct: bool) -> DataFrame:
    """Addresses of the items that are CIDRs or ips; all other items are left out."""
    if on_large not in ("raise", "skip", "expand"):
        raise ValueError("on_large must be raise, skip or expand")
    item = F.col("item")
    cidr = v4_cidr(item)
    lo, length = F.coalesce(cidr["network"], v4_number(item)), F.coalesce(cidr["length"], F.lit(32))
    v4 = items.filter(~F.contains("item", F.lit(":"))).select("item", bound(lo=lo, length=length))
    v4 = v4.filter(F.col("lo").isNotNull())
    v6 = items.filter(F.contains("item", F.lit(":"))).select("item", bound(p=v6_parts("item")))
    v6 = v6.filter("p.length is not null").select("item", "p.hi", "p.lo", F.col("p.length").alias("length"))
    v4, v6 = _sized(v4, 32, max_expand, on_large), _sized(v6, 128, max_expand, on_large)
    v4, v6 = _addresses(v4, [], on_large), _addresses(v6, ["hi"], on_large)
    if distinct:
        # On numbers, which shuffle smaller than text.
        v4, v6 = v4.distinct(), v6.distinct()
    return v4.select(v4_text(F.col("lo")).alias("ip")).unionByName(v6.select(v6_text("hi", "lo").alias("ip")))


def normalise_ips(df: DataFrame, item: str = "item", max_expand: int = MAX_EXPAND, on_large: str = "raise") -> DataFrame:
    """Distinct canonical ips of a list of addresses and CIDRs; what is neither is left out.

    Host bits are allowed, network and broadcast addresses are included. on_large decides about
    CIDRs of more than `max_expand` addresses: raise, skip or expand.
    """
    items = df.select(F.col(item).alias("item")).distinct()
    return _networks(items, max_expand, on_large, distinct=True)


def expand_items(df: DataFrame, item: str = "item", max_expand: int = MAX_EXPAND, on_large: str = "raise") -> DataFrame:
    """Items with their CIDRs replaced by addresses; all other items, malformed CIDRs too, stay as they are."""
    items = df.select(F.col(item).alias("item"))
    text = F.col("item")
    v6 = v6_parts(F.when(F.contains("item", F.lit(":")) & F.contains("item", F.lit("/")), text))
    marked = items.select("item", (v4_cidr(text)["network"].isNotNull() | v6["length"].isNotNull()).alias("is_cidr"))
    expanded = _networks(marked.filter("is_cidr").select("item"), max_expand, on_large, distinct=False)
    return marked.filter("not is_cidr").select(text.alias("ip")).unionByName(expanded)


def _sized(df: DataFrame, bits: int, max_expand: int, on_large: str) -> DataFrame:
    size = F.pow(F.lit(2.0), F.lit(bits) - F.col("length"))
    df = df.withColumn("size", size)
    if on_large == "skip":
        return df.filter(F.col("size") <= max_expand)
    limit = max_expand if on_large == "raise" else 2**62
    message = F.concat(F.lit("too many addresses in "), F.col("item"))
    return df.withColumn("size", F.when(F.col("size") <= limit, F.col("size")).otherwise(F.raise_error(message)))


def _addresses(df: DataFrame, keep: list[str], on_large: str) -> DataFrame:
    """One row per address, in two steps so that a large range becomes many blocks of bounded size."""
    last = F.col("lo") + F.col("size").cast("bigint") - 1
    blocks = df.select(*keep, last.alias("last"), F.explode(F.sequence("lo", last, F.lit(_BLOCK).cast("bigint"))).alias("block"))
    if on_large == "expand":
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.repartition(parts, "block")
    end = F.least(F.col("last"), F.col("block") + (_BLOCK - 1))
    return blocks.select(*keep, F.explode(F.sequence("block", end)).alias("lo"))


def rejected_ips(df: DataFrame, item: str = "item") -> DataFrame:
    """Distinct items that are neither an ip nor a CIDR."""
    items = df.select(F.col(item).alias("item")).distinct()
    cidr = v4_cidr(F.col("item"))
    v4_bad = v4_number(F.col("item")).isNull() & cidr["network"].isNull()
    checked = items.select("item", bound(p=v6_parts(F.when(F.contains("item", F.lit(":")), F.col("item")))))
    return checked.filter(v4_bad & F.col("p.length").isNull()).select("item")
