"""Day-by-day change timelines and attribute-presence intervals per ip.

Every window here runs over a daily series: one record per ip and day. A window partition is
therefore bounded by the number of calendar days, however hot an ip is in the raw feed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.functions.dates import day_text
from feedloom.functions.sqltext import as_array, as_object, field
from feedloom.functions.values import bag_differs, equality_key, list_members
from feedloom.operators.grouping import last_per_key
from feedloom.operators.paths import MAX_DEPTH

INITIAL, CHANGE, FINAL = "Initial Context", "Change", "Final Context"
ADDED, CHANGED, REMOVED = "added", "changed", "removed"
PRESENT = "Present"
ANY = None


def daily_series(df: DataFrame, seq: Column, key: str = "ip") -> DataFrame:
    """(key, dt, v): the last record per key and day; days with an empty record do not count."""
    rows = df.select(key, "dt", "v", seq.alias("seq"))
    rows = rows.filter(F.col("dt").isNotNull() & (F.size(F.col("v").try_cast("map<string,variant>")) > 0))
    return last_per_key(rows, [key, "dt"], F.col("seq")).drop("seq")


# Levels opened by generators; deeper pairs are finished by a row-local loop.
PAIR_LEVELS = 3

_CHILD_PATH = "if({p} = '', {k}, concat({p}, '.', {k}))"


def _differing(o: str, n: str) -> str:
    """SQL text: members of two objects whose text differs, as map<key, {o, n}>; NULL unless both are objects."""
    zipped = f"map_zip_with({as_object(o)}, {as_object(n)}, (k, a, b) -> struct(a as o, b as n))"
    return f"map_filter({zipped}, (k, p) -> not (to_json(p.o) <=> to_json(p.n)))"


def _deeper_pairs(max_depth: int) -> str:
    """SQL text: the leaves below an open pair as array<struct<path, o, n, state>>, at any depth."""
    path = _CHILD_PATH.format(p="e.path", k="c.key")
    child = f"struct({path} as path, c.value.o as o, c.value.n as n, 'open' as state)"
    leaf = "struct(e.path as path, e.o as o, e.n as n, 'leaf' as state)"
    opened = f"coalesce(transform(map_entries({_differing('e.o', 'e.n')}), c -> {child}), array({leaf}))"
    step = (
        f"transform(array(flatten(transform(acc.es, e -> if(e.state = 'leaf', array(e), {opened})))), "
        "n -> struct(n as es, exists(n, x -> x.state <> 'leaf') as more))[0]"
    )
    finish = f"r -> if(r.more, raise_error('records nested deeper than {max_depth} levels; pass a larger max_depth'), r.es)"
    start = "array(struct(_path as path, _o as o, _n as n, 'open' as state))"
    return (
        f"aggregate(sequence(1, {max_depth}), struct({start} as es, true as more), "
        f"(acc, i) -> if(acc.more, {step}, acc), {finish})"
    )


def deep_diff(pairs: DataFrame, old: str = "old_v", new: str = "new_v", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Differences of two records per row: other columns, path, change, old_value, new_value (JSON text).

    Objects on both sides are opened level by level, equal members are dropped before that, and a
    subtree on one side only stays whole. Lists compare without order, those in their members too, at
    any depth; numbers and booleans by value; a missing member differs from null.
    """
    keep = [c for c in pairs.columns if c not in (old, new)]
    rows = pairs.filter(F.col(old).isNotNull() & F.col(new).isNotNull())
    rows = rows.select(*keep, F.lit("").alias("_path"), F.col(old).alias("_o"), F.col(new).alias("_n"))
    for _ in range(PAIR_LEVELS):
        rows = rows.withColumn("_w", F.expr(_differing("_o", "_n"))).withColumn("_opens", F.expr("_w is not null"))
        rows = rows.select(
            *keep, "_path", "_opens", F.expr("if(_opens, null, _o)").alias("_o"), F.expr("if(_opens, null, _n)").alias("_n"),
            F.explode_outer("_w").alias("_k", "_p"),
        ).filter("_k is not null or not _opens")
        rows = rows.select(
            *keep,
            F.expr(f"if(_k is null, _path, {_CHILD_PATH.format(p='_path', k='_k')})").alias("_path"),
            F.expr("if(_k is null, _o, _p.o)").alias("_o"),
            F.expr("if(_k is null, _n, _p.n)").alias("_n"),
        )
    both_objects = f"{as_object('_o')} is not null and {as_object('_n')} is not null"
    # Only pairs that are still open meet the loop.
    rows = rows.withColumn("_deeper", F.expr(f"if({both_objects}, {_deeper_pairs(max_depth)}, null)"))
    rows = rows.select("*", F.expr("_deeper is not null").alias("_opens"), F.explode_outer("_deeper").alias("_e"))
    rows = rows.filter("_e is not null or not _opens").select(
        *keep, F.expr("if(_opens, _e.path, _path)").alias("path"), F.expr("if(_opens, _e.o, _o)").alias("o"),
        F.expr("if(_opens, _e.n, _n)").alias("n"),
    )
    # Texts and settled lists are bound, or the filter on them would compute them for each of its references.
    rows = rows.select(*keep, "path", bound(old_value=F.to_json("o"), new_value=F.to_json("n")))
    o, n = F.col("old_value"), F.col("new_value")
    both_lists = o.startswith("[") & n.startswith("[")
    differs = (
        F.when(o.isNull() | n.isNull(), F.lit(True))
        .when(both_lists & bag_differs("old_value", "new_value"), F.lit(True))
        .when(both_lists, F.sort_array(list_members("old_value")) != F.sort_array(list_members("new_value")))
        .otherwise(equality_key(o) != equality_key(n))
    )
    change = F.when(o.isNull(), F.lit(ADDED)).when(n.isNull(), F.lit(REMOVED)).otherwise(F.lit(CHANGED))
    return rows.filter(differs).select(*keep, "path", change.alias("change"), "old_value", "new_value")


def _with_previous(series: DataFrame, key: str) -> DataFrame:
    days = Window.partitionBy(key).orderBy("dt")
    whole = Window.partitionBy(key)
    return series.select(
        key, "dt",
        F.lag("v").over(days).alias("old_v"),
        F.col("v").alias("new_v"),
        F.min("dt").over(whole).alias("first_dt"),
        F.max("dt").over(whole).alias("last_dt"),
    )


def daily_changes(series: DataFrame, key: str = "ip", max_depth: int = MAX_DEPTH) -> DataFrame:
    """(key, dt, path, change, old_value, new_value) between consecutive available days."""
    days = Window.partitionBy(key).orderBy("dt")
    pairs = series.select(key, "dt", F.lag("v").over(days).alias("old_v"), F.col("v").alias("new_v"))
    return deep_diff(pairs, max_depth=max_depth)


def timeline_events(series: DataFrame, key: str = "ip", max_depth: int = MAX_DEPTH) -> DataFrame:
    """(key, dt, event, path, change, old_value, new_value).

    Initial and Final Context rows carry the whole record in new_value; the final one is left out
    for a single day. Change rows give one changed path each.
    """
    rows = _with_previous(series, key)
    none = F.lit(None).cast("string")

    def context(df: DataFrame, event: str) -> DataFrame:
        return df.select(
            key, "dt", F.lit(event).alias("event"), none.alias("path"), none.alias("change"),
            none.alias("old_value"), F.to_json("new_v").alias("new_value"),
        )

    first = context(rows.filter(F.col("dt") == F.col("first_dt")), INITIAL)
    last = context(rows.filter((F.col("dt") == F.col("last_dt")) & (F.col("first_dt") < F.col("last_dt"))), FINAL)
    changes = deep_diff(rows.drop("first_dt", "last_dt"), max_depth=max_depth)
    changes = changes.select(key, "dt", F.lit(CHANGE).alias("event"), "path", "change", "old_value", "new_value")
    return first.unionByName(changes).unionByName(last)


def list_delta(old: str, new: str) -> dict[str, Column]:
    """added and removed members of the JSON lists in two columns, as sorted canonical texts.

    A change of multiplicity alone gives two empty lists.
    """
    o, n = list_members(old), list_members(new)
    shown = lambda m: F.regexp_replace(m, r'^"|"$', "")
    by_text = lambda a, b: F.when(shown(a) < shown(b), -1).when(shown(a) > shown(b), 1).otherwise(0)
    return {
        "added": F.array_sort(F.array_except(n, o), by_text),
        "removed": F.array_sort(F.array_except(o, n), by_text),
    }


def count_delta(path: Column, old: Column, new: Column) -> dict[str, Column]:
    """Signed difference and direction for whole-number paths that end `.count`; NULL elsewhere."""
    whole = r"^-?\d+$"
    applies = path.endswith(".count") & old.rlike(whole) & new.rlike(whole)
    delta = F.when(applies, new.try_cast("bigint") - old.try_cast("bigint"))
    return {"delta": delta, "direction": F.when(delta > 0, F.lit("up")).when(delta.isNotNull(), F.lit("down"))}


def parse_target(text: str | None):
    """Search literal: blank, null or none search for any value; otherwise JSON, else the text itself."""
    if not text or not text.strip() or text.lower() in ("null", "none"):
        return ANY
    try:
        return json.loads(text)
    except ValueError:
        return text


def value_at(v: str, path: str) -> Column:
    """Value (VARIANT) of a dotted path; a step through a list fans out over its objects.

    List values found on the way are joined one level; nothing found is NULL.
    """
    current = f"array({v})"
    for key in path.split("."):
        step = field("x", key)
        found = field("m", key)
        fanned = (
            f"flatten(transform(filter({as_array('x')}, m -> {found} is not null), "
            f"m -> coalesce({as_array(found)}, array({found}))))"
        )
        fanned = f"transform(array({fanned}), f -> if(size(f) > 0, cast(f as variant), null))[0]"
        one = f"case when {as_object('x')} is not null then {step} when {as_array('x')} is not null then {fanned} end"
        # One-element arrays bind the value of a step, so that the expression stays linear in the path.
        current = f"transform({current}, x -> {one})"
    return F.expr(f"{current}[0]")


def _target_key(target) -> Column:
    return equality_key(F.lit(json.dumps(target, sort_keys=True, separators=(",", ":"), ensure_ascii=False)))


def _plain(text: Column) -> Column:
    """Text of a scalar as it prints: no quotes, booleans in title case."""
    return F.when(text.isin("true", "false"), F.initcap(text)).when(text.startswith('"'), F.try_parse_json(text).try_cast("string")).otherwise(text)


def matches(value: Column, target) -> Column:
    """True where a value is present and fits the target: list membership, else equal text."""
    text = F.to_json(value)
    present = value.isNotNull() & (text != "null")
    if target is ANY:
        return present
    items = F.transform(value.try_cast("array<variant>"), lambda m: equality_key(F.to_json(m)))
    wanted = F.lit(json.dumps(target, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    scalar = _plain(text) == _plain(wanted)
    return present & F.coalesce(F.when(text.startswith("["), F.array_contains(items, _target_key(target))).otherwise(scalar), F.lit(False))


def presence_intervals(series: DataFrame, path: str, target=ANY, ips: DataFrame | None = None, key: str = "ip") -> DataFrame:
    """(key, start, end): runs of available days on which the attribute matches, as YYYYMMDD.

    A run that reaches the last available day ends `Present`. With `ips`, every ip of that list
    appears, with NULL bounds where nothing matched.
    """
    days = Window.partitionBy(key).orderBy("dt")
    rows = series.select(key, "dt", matches(value_at("v", path), target).alias("hit"))
    rows = rows.select("*", F.max("dt").over(Window.partitionBy(key)).alias("last_dt"), F.lag("hit", 1, False).over(days).alias("was"))
    rows = rows.withColumn("run", F.sum(F.when(F.col("hit") & ~F.col("was"), 1).otherwise(0)).over(days))
    runs = rows.filter("hit").groupBy(key, "run").agg(
        F.min("dt").alias("start"), F.max("dt").alias("end"), F.first("last_dt").alias("last_dt")
    )
    end = F.when(F.col("end") == F.col("last_dt"), F.lit(PRESENT)).otherwise(day_text(F.col("end")))
    runs = runs.select(key, day_text(F.col("start")).alias("start"), end.alias("end"))
    return runs if ips is None else ips.select(key).distinct().join(runs, key, "left")
