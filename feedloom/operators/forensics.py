"""History-versus-current classification of keys, down to single attributes.

A history is (ip, ts, v) with one record per ip and timestamp, the current snapshot is (ip, v).
Timelines stay in long form, one row per ip, attribute and date, so an ip with a long history is
never gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.sqltext import as_object
from feedloom.functions.text import percent
from feedloom.functions.values import has_data
from feedloom.operators.grouping import last_per_key
from feedloom.operators.snapshots import IGNORED, members

CONTINUOUS, AGED_OUT, EMERGING = "CONTINUOUS", "AGED_OUT", "EMERGING"


def history_records(df: DataFrame, seq: Column, key: str = "ip") -> DataFrame:
    """(key, ts, v): the last record per key and timestamp."""
    return last_per_key(df.select(key, "ts", "v", seq.alias("seq")), [key, "ts"], F.col("seq")).drop("seq")


def key_status(history: DataFrame, current: DataFrame, key: str = "ip") -> DataFrame:
    """(key, status, dates): seen in both, in history only, or in the current snapshot only."""
    sides = history.select(key, F.lit(1).alias("h"), F.lit(0).alias("c")).unionByName(
        current.select(key, F.lit(0).alias("h"), F.lit(1).alias("c"))
    )
    seen = sides.groupBy(key).agg(F.sum("h").alias("dates"), F.max("c").alias("c"))
    status = F.when(F.col("dates") == 0, F.lit(EMERGING)).when(F.col("c") == 0, F.lit(AGED_OUT)).otherwise(F.lit(CONTINUOUS))
    return seen.select(key, status.alias("status"), "dates")


def _attributes(df: DataFrame, key: str, ignore: list[str], side: str) -> DataFrame:
    rows = df.select(key, F.expr(f"explode({members('v', ignore)})").alias("attribute", "value"))
    return rows.withColumn("current", F.lit(side == "current"))


def attribute_states(history: DataFrame, current: DataFrame, key: str = "ip", ignore: list[str] | None = None) -> DataFrame:
    """Per (key, attribute) of the continuous keys: current value and change flags.

    changed: more than one value over history and current, a day without the attribute counting as
    null; multi_stage: more than one historical value; transient: history had data, current has
    none; escalating: current has data, history never had. Values compare as canonical text.
    """
    ignore = IGNORED if ignore is None else ignore
    rows = _attributes(history, key, ignore, "history").unionByName(_attributes(current, key, ignore, "current"))
    past, now, value = ~F.col("current"), F.col("current"), F.col("value")
    # All of these combine before the shuffle; least and greatest text replace a distinct count.
    agg = rows.groupBy(key, "attribute").agg(
        F.count_if(past).alias("present"),
        F.min(F.when(past, value)).alias("least"),
        F.max(F.when(past, value)).alias("greatest"),
        F.coalesce(F.bool_or(past & has_data(value)), F.lit(False)).alias("past_data"),
        F.max(F.when(now, value)).alias("now_text"),
    )
    status = key_status(history, current, key).filter(F.col("status") == CONTINUOUS)
    states = agg.join(status.select(key, "dates"), key)
    null = F.lit("null")
    absent = F.col("present") < F.col("dates")
    least = F.coalesce("least", null)
    now_text = F.coalesce("now_text", null)
    multi = (F.col("least") != F.col("greatest")) | (absent & (least != "null"))
    multi = F.coalesce(multi, F.lit(False))
    now_data = has_data(now_text)
    changed = multi | (least != now_text)
    return states.select(
        key,
        "attribute",
        now_text.alias("current_value"),
        changed.alias("changed"),
        (changed & multi).alias("multi_stage"),
        (changed & F.col("past_data") & ~now_data).alias("transient"),
        (changed & now_data & ~F.col("past_data")).alias("escalating"),
    )


def timeline_values(history: DataFrame, states: DataFrame, key: str = "ip") -> DataFrame:
    """(key, attribute, ts, value) of every changed attribute on every historical date, null where absent."""
    wanted = states.filter("changed").groupBy(key).agg(F.collect_list("attribute").alias("attributes"))
    rows = history.join(wanted, key).select(
        key, "ts", F.expr(f"explode(map_from_arrays(attributes, transform(attributes, a -> element_at({as_object('v')}, a))))").alias("attribute", "x")
    )
    return rows.select(key, "attribute", "ts", F.coalesce(F.to_json("x"), F.lit("null")).alias("value"))


def forensic_rows(history: DataFrame, current: DataFrame, current_date: str, key: str = "ip", ignore: list[str] | None = None) -> DataFrame:
    """Export in long form: (key, status, section, attribute, ts, value).

    CONTINUOUS keys give `timeline` rows (every historical date of a changed attribute), `current`
    rows (its current value) and `unchanged` rows; AGED_OUT keys give their whole records as
    `history`; EMERGING keys give their stamped record as `data`.
    """
    states = attribute_states(history, current, key, ignore)
    text = F.lit(None).cast("string")

    def rows(df: DataFrame, status: str, section: Column, attribute, ts, value) -> DataFrame:
        return df.select(
            key, F.lit(status).alias("status"), section.alias("section"),
            attribute.alias("attribute"), ts.alias("ts"), value.alias("value"),
        )

    timeline = rows(
        timeline_values(history, states, key), CONTINUOUS, F.lit("timeline"), F.col("attribute"), F.col("ts"), F.col("value")
    )
    now = rows(
        states, CONTINUOUS, F.when(F.col("changed"), F.lit("current")).otherwise(F.lit("unchanged")),
        F.col("attribute"), F.when(F.col("changed"), F.lit(current_date)), F.col("current_value"),
    )
    aged = rows(
        history.join(current.select(key), key, "left_anti"), AGED_OUT, F.lit("history"), text, F.col("ts"), F.to_json("v")
    )
    stamp = f"to_json(map_concat(map('Timestamp', parse_json('\"{current_date}\"')), {as_object('v')}))"
    fresh = rows(
        current.join(history.select(key).distinct(), key, "left_anti"), EMERGING, F.lit("data"), text, F.lit(current_date), F.expr(stamp)
    )
    return timeline.unionByName(now).unionByName(aged).unionByName(fresh)


def nested_history(rows: DataFrame, rows_per_line: int = 1000, key: str = "ip") -> DataFrame:
    """Long export rows gathered to JSON lines per key and section: (key, part, line).

    A key with more rows than `rows_per_line` is written as several parts, so no group grows with
    the data; together the parts hold every row.
    """
    sizes = rows.groupBy(key, "section").agg(F.ceil(F.count("*") / F.lit(rows_per_line)).alias("parts"))
    spread = F.pmod(F.xxhash64("attribute", "ts"), F.col("parts")).alias("part")
    parts = rows.join(sizes, [key, "section"]).select(*rows.columns, spread)
    cell = F.struct("attribute", "ts", "value")
    grouped = parts.groupBy(key, "status", "section", "part").agg(F.array_sort(F.collect_list(cell)).alias("rows"))
    return grouped.select(key, "part", F.to_json(F.struct(key, "status", "section", "part", "rows")).alias("line"))


def forensic_summary(history: DataFrame, current: DataFrame, key: str = "ip", ignore: list[str] | None = None) -> DataFrame:
    """One row: keys per status with their share of the pool, continuous keys per kind of change with their share."""
    status = F.col("status")
    pool = key_status(history, current, key).agg(
        F.count("*").alias("pool"),
        F.count_if(status == CONTINUOUS).alias("continuous"),
        F.count_if(status == AGED_OUT).alias("aged_out"),
        F.count_if(status == EMERGING).alias("emerging"),
    )
    kinds = ["transient", "multi_stage", "escalating"]
    per_key = attribute_states(history, current, key, ignore).groupBy(key).agg(*[F.bool_or(k).alias(k) for k in kinds])
    flags = per_key.agg(*[F.count_if(k).alias(k) for k in kinds])
    both = pool.withColumn("flags", flags.select(F.struct(*kinds)).scalar())
    both = both.select(*pool.columns, *[F.col("flags")[k].alias(k) for k in kinds])
    return both.select(
        "*",
        *[percent(F.col(c), F.col("pool")).alias(f"{c}_pct") for c in ("continuous", "aged_out", "emerging")],
        *[percent(F.col(c), F.col("continuous")).alias(f"{c}_pct") for c in kinds],
    )


def forensic_attribute_counts(states: DataFrame) -> DataFrame:
    """(attribute, aged_out, new_current): keys on which an attribute lost or first got its data."""
    counts = states.groupBy("attribute").agg(
        F.count_if("transient").alias("aged_out"), F.count_if("escalating").alias("new_current")
    )
    return counts.filter((F.col("aged_out") > 0) | (F.col("new_current") > 0))
