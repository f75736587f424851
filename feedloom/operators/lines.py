"""Line filters by fixed patterns, first-lines samples and random samples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ready-made line patterns, matched without case.
MALICIOUS = "malicious|malware|trojan"
RESIDENTIAL = "residential"
COUNTRY_KP = 'country":"KP'
ONLY_TROJAN = r'"services":\["TROJAN"\]'


def line_filter(df: DataFrame, pattern: str, column: str = "raw") -> DataFrame:
    """Lines that contain a match of the pattern, letter case ignored."""
    return df.filter(F.col(column).rlike(f"(?i){pattern}"))


def match_counts(df: DataFrame, patterns: dict[str, str], column: str = "raw") -> DataFrame:
    """One pass: number of lines, and number of matching lines per named pattern."""
    hits = [F.count_if(F.col(column).rlike(f"(?i){p}")).alias(name) for name, p in patterns.items()]
    return df.agg(F.count("*").alias("lines"), *hits)


def country_starts(prefix: str, v: str = "v") -> Column:
    """Structured twin of the country line pattern, for a top-level `country`."""
    return F.upper(F.expr(f"try_variant_get({v}, '$.country', 'string')")).startswith(prefix.upper())


def only_service(name: str, v: str = "v") -> Column:
    """Structured twin of the services line pattern: exactly this one service."""
    services = F.expr(f"try_variant_get({v}, '$.services', 'array<string>')")
    return (F.size(services) == 1) & (F.upper(F.get(services, 0)) == name.upper())


def first_lines(df: DataFrame, n: int = 500_000, order: list[str] | None = None) -> DataFrame:
    """First `n` lines by file position (or by the given columns), the sample used to discover keys and values.

    By position the lines of each split are counted; the splits that are needed whole are kept as they are, wherever they were read,
    and only the one in which the sample ends is ordered. With given columns each task keeps at most `n` lines before they meet.
    """
    if order:
        return df.orderBy(*order).limit(n)
    ahead = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = df.groupBy("file", "block").agg(F.count("*").alias("lines"))  # one row per split
    before = splits.withColumn("before", F.coalesce(F.sum("lines").over(ahead), F.lit(0)))
    last = before.filter(F.col("before") < n).orderBy(F.desc("before"), F.desc("lines")).first()
    if last is None:
        return df.limit(0)
    inside = (F.col("file") == last["file"]) & (F.col("block") == last["block"])
    whole = df.filter((F.col("file") <= last["file"]) & ~inside)
    whole = whole.filter((F.col("file") < last["file"]) | (F.col("block") < last["block"]))
    return whole.union(df.filter(inside).orderBy("line").limit(n - last["before"]))


# Ranges that the draws of a sample are counted in.
DRAW_RANGES = 1 << 16
_DRAW_BITS = 60


def draw(seed: int, *key: Column) -> Column:
    """A number below 2^60 that depends on the seed and the key of a row alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in key))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def random_lines(df: DataFrame, n: int = 10_000, seed: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Uniform sample of `n` rows without replacement: those with the smallest draws by (seed, key), the key of a line being its position.

    The same seed draws the same rows, however they are dealt to tasks. Draws are counted in ranges; all rows of the ranges below the
    one in which the sample ends are taken where they are, and only that range is ordered. Rows with equal keys tie.
    """
    seed = random.SystemRandom().getrandbits(32) if seed is None else seed
    key = key or ["file", "block", "line"]
    drawn = df.withColumn("_draw", draw(seed, *map(F.col, key)))
    span = F.shiftright("_draw", _DRAW_BITS - DRAW_RANGES.bit_length() + 1)
    ranges = drawn.groupBy(span.alias("span")).agg(F.count("*").alias("rows"))  # at most DRAW_RANGES rows
    before = ranges.withColumn("before", F.coalesce(F.sum("rows").over(
        Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ), F.lit(0)))
    last = before.filter(F.col("before") < n).orderBy(F.desc("span")).first()
    if last is None:
        return df.limit(0)
    rest = drawn.filter(span == last["span"]).orderBy("_draw", *key).limit(n - last["before"])
    return drawn.filter(span < last["span"]).union(rest).drop("_draw")


def filter_counters(df: DataFrame, matches: Column) -> DataFrame:
    """(lines_parsed, exported) of a filter run in one pass."""
    return df.agg(F.count("*").alias("lines_parsed"), F.count_if(matches).alias("exported"))
