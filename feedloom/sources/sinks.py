"""Writers: JSON lines, raw lines, status-split output, wide CSV, tag lists, profile summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.functions.sqltext import as_object
from feedloom.operators.paths import (
    MAX_DEPTH, candidate_paths, checked_text, direct_leaf, entries_sql, entry_text, leaves, reading_order, shapes,
)


def json_line(*columns: str | Column) -> Column:
    """One JSON object per row from the given columns; NULL members are written as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str, mode: str = "error", keep_nulls: bool = True) -> None:
    """One JSON object per line; several part files, one per task."""
    line = json_line(*df.columns) if keep_nulls else F.to_json(F.struct(*df.columns))
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_raw_lines(df: DataFrame, path: str, mode: str = "error", column: str = "raw") -> None:
    """Lines exactly as read; order is not kept."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_by_status(df: DataFrame, path: str, mode: str = "error", status: str = "status") -> None:
    """JSON lines split into one folder per status (ok / failed)."""
    body = [c for c in df.columns if c != status]
    df.select(json_line(*body).alias("value"), status).write.mode(mode).partitionBy(status).text(path)


_PLACE = re.compile(r'\$(\["[A-Za-z0-9_\- ]+"\]|\[\d+\])+')


def wide_columns(
    df: DataFrame, v: str = "v", max_columns: int = 10_000, max_depth: int = MAX_DEPTH
) -> dict[str, list[str] | None]:
    """All flattened keys in order, each with the VARIANT paths it was seen at (None if not all are readable).

    Keys are data, so more than `max_columns` is an error.
    """
    seen = leaves(shapes(df, v), v=v, max_depth=max_depth, places=True)
    seen = seen.groupBy("path").agg(F.collect_set(F.coalesce("place", F.lit(""))).alias("places")).limit(max_columns + 1).collect()
    if len(seen) > max_columns:
        raise ValueError(f"more than {max_columns} flattened keys; filter the input or raise max_columns")
    found: dict[str, list[str] | None] = {}
    for path, place in sorted(((r.path, p) for r in seen for p in r.places), key=lambda x: (x[0], reading_order(x[1]))):
        if not _PLACE.fullmatch(place):
            found[path] = None
        elif found.setdefault(path, []) is not None:
            found[path].append(place)
    return found


def wide(df: DataFrame, columns: list[str] | None = None, v: str = "v", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Flat text columns, one row per record, missing keys NULL; records that are not objects are left out.

    Row-local, without pivot or shuffle: every column is read at the places it was found at, or,
    for given columns, at those its name may stand for.
    """
    if columns is None:
        places = wide_columns(df, v, max_depth=max_depth)
    else:
        places = {c: candidate_paths(c) for c in columns}
    columns = list(places)
    keep = [c for c in df.columns if c != v]
    rows = df.filter(F.expr(f"{as_object(v)} is not null"))
    read, text = [], {}
    for i, (column, found) in enumerate(places.items()):
        parts = []
        for j, path in enumerate(found or []):
            value, parent = direct_leaf(v, path)
            name, list_name = f"_v{i}_{j}", f"_l{i}_{j}"
            member = parent != "null"
            read.append(F.expr(value).alias(name))
            if member:
                read.append(F.expr(parent).alias(list_name))
            parts.append(checked_text(name, list_name, member))
        if parts:
            # Of several readings in one record the last in member order counts.
            text[column] = F.expr(f"coalesce({', '.join(reversed(parts))})")
    # Names with too many readings come from the flattened record, bound once.
    if any(found is None for found in places.values()):
        pairs = f"transform({entries_sql(v, max_depth)}, e -> struct(e.path, {entry_text('e')}))"
        read.append(bound(_flat=F.expr(f"map_from_entries({pairs})")))
        text |= {c: F.try_element_at("_flat", F.lit(c)) for c, found in places.items() if found is None}
    # The reads form their own projection, so that each is done once per record.
    return rows.select(*keep, *read).select(*keep, *[text[c].alias(c) for c in columns])


def write_wide_csv(
    df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "error", bom: bool = False, max_depth: int = MAX_DEPTH
) -> None:
    """CSV with a header of all flattened keys; missing values are empty.

    Quotes are doubled and outer blanks kept. `bom` starts each file with a byte order mark, which spreadsheets look for.
    """
    out = wide(df.select("v"), columns, max_depth=max_depth)
    if bom and out.columns:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    writer = out.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "")
    writer = writer.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path)


def write_tags(df: DataFrame, path: str, mode: str = "error") -> None:
    """Tag list, one tag per line."""
    df.select(F.col("tag").alias("value")).write.mode(mode).text(path)


def line_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("lines"))
