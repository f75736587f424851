"""Dates in mixed spellings, date sets in one cell, day spans."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.sqltext import literal, name, stripped

# Accepted spellings, as (shape, pattern). A value is parsed by the first shape it
# has; two-digit years up to 68 lie in this century, the others in the last.
FORMATS = [
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", "M/d/yyyy H:m"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4} \d{1,2}:\d{2} (AM|PM)$", "MMM d, yyyy h:mm a"),
    (r"^\d{8}T\d{6}$", "yyyyMMdd'T'HHmmss"),
]
# Numbers above the first bound are epoch seconds; the second is the end of year 9999.
EPOCH_FROM, EPOCH_TO = 100_000_000, 253_402_300_799

_DAY_MICROS = 86_400_000_000

# Text clean-up before the shapes are tested, as (pattern, replacement).
_CLEAN = [
    (r"\.0$", ""),
    # Weekday and zone name around "Jan 05, 2024 03:04 PM".
    (r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), ([A-Za-z]{3} \d{1,2}, \d{4} \d{1,2}:\d{2} (?:AM|PM)) (?:UTC|GMT)$", "$1"),
    # `$1` stops before the century digits, as there are only three groups.
    (r"^(\d{1,2}/\d{1,2}/)(69|[7-9]\d)( .*|)$", "$119$2$3"),
    (r"^(\d{1,2}/\d{1,2}/)(\d{2})( .*|)$", "$120$2$3"),
]
_ISO = r"^\d{4}-\d{2}-\d{2}[T :]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
_ISO_PARTS = r"^(\d{4}-\d{2}-\d{2})[T :](\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?).*$"


def instant_sql(x: str) -> str:
    """SQL text: timestamp of one cell text, NULL if no spelling fits. Epochs are read as UTC.

    Each spelling is chosen by shape, so a parse is only tried where it can succeed. An offset is
    dropped: the wall-clock time of the text counts.
    """
    text = stripped(x)
    for pattern, to in _CLEAN:
        text = f"regexp_replace({text}, {literal(pattern)}, {literal(to)})"
    epoch = f"try_cast({x} as double)"
    number = f"{stripped(x)} rlike {literal(r'^[+]?[0-9]+([.][0-9]*)?$')}"
    cases = [
        f"when {number} and {epoch} > {EPOCH_FROM} and {epoch} <= {EPOCH_TO} "
        f"then timestamp_micros(cast({epoch} * 1000000 as bigint))"
    ]
    for shape, pattern in FORMATS:
        cases.append(f"when t rlike {literal(shape)} then try_to_timestamp(t, {literal(pattern)})")
    parts = f"regexp_extract(t, {literal(_ISO_PARTS)}, %d)"
    clock = parts % 2
    iso = (
        f"try_cast(concat({parts % 1}, 'T', replace(if(length({clock}) = 2, concat({clock}, ':00'), {clock}), ',', '.'))"
        " as timestamp)"
    )
    cases.append(f"when t rlike {literal(_ISO)} then {iso}")
    return f"transform(array({text}), t -> case {' '.join(cases)} end)[0]"


def instant(column: str) -> Column:
    """Timestamp of a text column in any accepted spelling."""
    return F.expr(instant_sql(f"cast({name(column)} as string)"))


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def day_of(text: Column) -> Column:
    """DATE of YYYYMMDD text, NULL if it is not a real day."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def span_days(start: Column, end: Column) -> Column:
    """Days of a span: full 24-hour steps from start to end, plus one."""
    return (F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(_DAY_MICROS)) + 1).cast("bigint")


def date_set(column: str) -> Column:
    """Distinct sorted days named in one cell: `[a, b to c]`, quotes and brackets optional.

    Each comma-separated part is tried as a range split at ` to `, ` - ` and `-`, in this order and
    only where both ends parse, and as a single date otherwise. Reversed ranges are turned around.
    """
    cell = stripped(f"cast({name(column)} as string)")
    body = f"if(startswith({cell}, '[') and endswith({cell}, ']'), substring({cell}, 2, length({cell}) - 2), {cell})"
    parts = f"transform(split({body}, ','), p -> regexp_replace({stripped('p')}, '[\"\\']', ''))"
    ends = ", ".join(
        f"if(contains(p, {literal(d)}), array(substring_index(p, {literal(d)}, 1), "
        f"substring(p, instr(p, {literal(d)}) + {len(d)})), null)"
        for d in (" to ", " - ", "-")
    )
    candidates = f"filter(array({ends}, array(p, p)), a -> a is not null)"
    parsed = f"transform({candidates}, a -> transform(a, x -> {instant_sql('x')}))"
    chosen = f"slice(filter({parsed}, r -> r[0] is not null and r[1] is not null), 1, 1)"
    first = "to_date(least(r[0], r[1]))"
    steps = f"cast(floor((unix_micros(greatest(r[0], r[1])) - unix_micros(least(r[0], r[1]))) / {_DAY_MICROS}) as int)"
    days = f"flatten(transform({chosen}, r -> sequence({first}, date_add({first}, {steps}))))"
    whole = f"flatten(transform(filter({parts}, p -> p <> ''), p -> {days}))"
    empty = "cast(array() as array<date>)"
    return F.expr(f"if({name(column)} is null or lower({cell}) = 'nan', {empty}, array_sort(array_distinct({whole})))")


def parse_span(text: str, today: date | None = None) -> tuple[date, date] | None:
    """First and last day of span text: `YYYYMMDD-YYYYMMDD`, `30 days` or `4 weeks` up to today.

    None if the text does not parse; both ends are inclusive.
    """
    text = text.strip().lower()
    if "-" in text:
        ends = [p.strip() for p in text.split("-")]
        try:
            first, last = (datetime.strptime(p, "%Y%m%d").date() for p in ends[:2])
        except ValueError:
            return None
        return (first, last)
    found = re.fullmatch(r"(\d+)\s+(day|week)s?", text)
    if not found:
        return None
    last = today or date.today()
    return (last - timedelta(days=int(found[1]) * (7 if found[2] == "week" else 1)), last)


def span_column(span: tuple[date, date]) -> Column:
    """Array of all days of a span; empty where it ends before it starts."""
    if span[0] > span[1]:
        return F.expr("cast(array() as array<date>)")
    return F.sequence(F.lit(span[0]), F.lit(span[1]))
