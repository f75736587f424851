"""Diff of two keyed snapshots, record by record and attribute by attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.functions.sqltext import as_object
from feedloom.functions.text import percent
from feedloom.functions.values import equality_key, has_data
from feedloom.operators.grouping import duplicate_audit, last_per_key
from feedloom.sources.feeds import IP_KEYS, stamp_text

# Members that never count as a change.
IGNORED = ["Queried_Date", "Timestamp", "timestamp"]

MODIFIED, UNCHANGED, REMOVED, ADDED = "MODIFIED", "UNCHANGED", "REMOVED", "ADDED"


def latest_records(df: DataFrame, seq: Column, key: str = "ip") -> DataFrame:
    """(key, v): the last record per key."""
    return last_per_key(df.select(key, "v", seq.alias("seq")), [key], F.col("seq")).drop("seq")


def audit_duplicates(df: DataFrame, seq: Column, chunk: list[Column], key: str = "ip") -> DataFrame:
    """(identical, conflicting) duplicates of a snapshot, comparing digests of the canonical records."""
    return duplicate_audit(df, key, F.sha2(F.to_json("v"), 256), seq, chunk)


def members(v: str, ignore: list[str]) -> str:
    """SQL text: compared members of a record as map<key, canonical text>; ip spellings are left out."""
    dropped = ", ".join(f"'{k}'" for k in ignore)
    ips = ", ".join(f"'{k}'" for k in IP_KEYS)
    kept = f"map_filter({as_object(v)}, (k, x) -> k not in ({dropped}) and lower(k) not in ({ips}))"
    return f"transform_values({kept}, (k, x) -> to_json(x))"


def matched(old: DataFrame, new: DataFrame, key: str = "ip") -> DataFrame:
    """Full outer join of two snapshots: (key, old_v, new_v), NULL where a side lacks the key."""
    o = old.select(key, F.col("v").alias("old_v"), F.lit(True).alias("in_old"))
    n = new.select(key, F.col("v").alias("new_v"), F.lit(True).alias("in_new"))
    return o.join(n, key, "full_outer")


def diff_records(old: DataFrame, new: DataFrame, key: str = "ip", ignore: list[str] | None = None) -> DataFrame:
    """One row per key: status, `changes` map<attribute, {old, new}>, `unchanged` map<attribute, text>, both records.

    Members of both sides are paired on the joined row, so attributes need no second shuffle.
    Missing equals null, list order counts, numbers and booleans compare by value.
    """
    ignore = IGNORED if ignore is None else ignore
    pair = F.expr(
        f"map_zip_with({members('old_v', ignore)}, {members('new_v', ignore)}, "
        "(k, a, b) -> struct(a as old, b as new))"
    )
    rows = matched(old, new, key).select("*", bound(pair=pair))
    both = F.col("in_old") & F.col("in_new")
    differs = F.map_filter("pair", lambda k, p: equality_key(p["old"]) != equality_key(p["new"]))
    equal = F.map_filter("pair", lambda k, p: equality_key(p["old"]) == equality_key(p["new"]))
    rows = rows.withColumns({
        "changes": F.when(both, differs),
        "unchanged": F.when(both, F.transform_values(equal, lambda k, p: p["old"])),
    })
    status = (
        F.when(F.col("in_new").isNull(), F.lit(REMOVED))
        .when(F.col("in_old").isNull(), F.lit(ADDED))
        .when(F.size("changes") > 0, F.lit(MODIFIED))
        .otherwise(F.lit(UNCHANGED))
    )
    return rows.select(key, status.alias("status"), "changes", "unchanged", "old_v", "new_v")


def _richer(side: str, other: str) -> Column:
    return F.exists(F.map_values("changes"), lambda p: has_data(p[side]) & ~has_data(p[other]))


def _as_json(text: Column) -> Column:
    """Canonical text back to a JSON value, a missing one to null."""
    return F.try_parse_json(F.coalesce(text, F.lit("null")))


def _by_key(column: str) -> Column:
    """Map in key order, so that the exported text is canonical."""
    return F.map_from_entries(F.array_sort(F.map_entries(column)))


def _as_json_pair(key: Column, pair: Column) -> Column:
    return F.struct(_as_json(pair["old"]).alias("old"), _as_json(pair["new"]).alias("new"))


def diff_rows(diff: DataFrame, current_date: str, key: str = "ip") -> DataFrame:
    """Exported rows, unchanged keys left out: key, status, historic_date, changes, unchanged, data (JSON text).

    An added record is stamped with the current date unless it carries its own `Timestamp`.
    """
    stamp = f"map_concat(map('Timestamp', parse_json('\"{current_date}\"')), {as_object('new_v')})"
    changed = F.col("status") == MODIFIED
    data = F.when(F.col("status") == REMOVED, F.to_json("old_v")).when(F.col("status") == ADDED, F.to_json(F.expr(stamp)))
    return diff.filter(F.col("status") != UNCHANGED).select(
        key,
        "status",
        F.when(changed, stamp_text("historic_value", "old_v")).alias("historic_date"),
        F.when(changed, F.to_json(F.transform_values(_by_key("changes"), _as_json_pair))).alias("changes"),
        F.when(changed, F.to_json(F.transform_values(_by_key("unchanged"), lambda k, t: _as_json(t)))).alias("unchanged"),
        data.alias("data"),
    )


def changed_attributes(diff: DataFrame, key: str = "ip") -> DataFrame:
    """(key, attribute, old, new) of every changed attribute; a missing side is NULL."""
    rows = diff.filter(F.col("status") == MODIFIED).select(key, F.explode("changes").alias("attribute", "pair"))
    return rows.select(key, "attribute", F.col("pair.old").alias("old"), F.col("pair.new").alias("new"))


def attribute_counts(diff: DataFrame, key: str = "ip") -> DataFrame:
    """Per attribute: keys it changed on, keys where it was gained, keys where it was lost."""
    rows = changed_attributes(diff, key)
    old, new = has_data(F.col("old")), has_data(F.col("new"))
    return rows.groupBy("attribute").agg(
        F.count("*").alias("changed"),
        F.count_if(new & ~old).alias("gained"),
        F.count_if(old & ~new).alias("lost"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row of counts and of shares of the historic and of the current snapshot."""
    status = F.col("status")
    counts = diff.agg(
        F.count_if(status != ADDED).alias("historic"),
        F.count_if(status != REMOVED).alias("current"),
        F.count_if(status == UNCHANGED).alias("unchanged"),
        F.count_if(status == MODIFIED).alias("modified"),
        F.count_if(status == REMOVED).alias("removed"),
        F.count_if(status == ADDED).alias("added"),
        F.count_if((status == MODIFIED) & _richer("new", "old")).alias("current_richer"),
        F.count_if((status == MODIFIED) & _richer("old", "new")).alias("historic_richer"),
    )
    of_historic = ["unchanged", "modified", "removed", "current_richer"]
    of_current = ["unchanged", "modified", "added", "historic_richer"]
    return counts.select(
        "*",
        *[percent(F.col(c), F.col("historic")).alias(f"{c}_pct_historic") for c in of_historic],
        *[percent(F.col(c), F.col("current")).alias(f"{c}_pct_current") for c in of_current],
    )
