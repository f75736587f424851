"""Members of JSON arrays that run over many lines, cut in parallel.

A JSON text has no line feed inside a string, so every line can be measured by itself: brackets outside strings open or close a
level. Sums of these per split and then within the split give the depth at which each line begins. Commas at depth 1 end a member;
only lines that can reach that depth are looked at more closely. Numbers of cuts, summed in the same two levels, name the members,
and the pieces of a member meet by that name. Each member is parsed strictly: if all are values, the text was one array, for
nothing but the bracket ahead of the first, the commas and the bracket behind the last is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.functions.sqltext import BLANKS, strict_json
from feedloom.session import staged

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# Every character of a line is in one token: a bracket, a comma, or all between them.
_TOKEN = r'[\[\]{},]|(?:' + _STRING + r'|[^"\[\]{},])++|"'


def _levels(raw: str) -> tuple[Column, Column]:
    """Numbers of brackets outside strings that open and that close a level."""
    bare = F.regexp_replace(raw, _STRING, "")
    size = F.length(bare)
    return size - F.length(F.translate(bare, "[{", "")), size - F.length(F.translate(bare, "]}", ""))


def _before(column: Column, *by: str) -> Column:
    """Sum over the rows ahead, per file."""
    rows = Window.partitionBy("file").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(rows), F.lit(0))


def array_members(lines: DataFrame) -> DataFrame:
    """(file, member, v) of the arrays in `lines` (raw, file, block, line); `v` is NULL where a piece is no JSON value.

    A file is one array if none of its `v` is NULL. An empty array has no members. A member has to fit a row, a file has not.
    """
    opens, closes = _levels("raw")
    measured = lines.select("raw", "file", "block", "line", bound(_opens=opens, _closes=closes))
    rise = F.col("_opens") - F.col("_closes")
    # One row per split.
    splits = measured.groupBy("file", "block").agg(F.sum(rise).alias("_rise"))
    splits = splits.select("file", "block", _before(F.col("_rise"), "block").alias("_base"))
    ahead = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(rise).over(ahead), F.lit(0))
    deep = measured.withColumn("_here", here).join(splits, ["file", "block"]).withColumn("_depth", F.col("_here") + F.col("_base"))
    close = F.col("_depth") - F.col("_closes") <= 1
    tokens = F.when(close, F.regexp_extract_all("raw", F.lit(_TOKEN), F.lit(0))).otherwise(F.array("raw"))
    pieces = deep.select("file", "block", "line", "_depth", F.posexplode(tokens).alias("at", "text"))
    step = F.when(F.col("text").isin("[", "{"), 1).when(F.col("text").isin("]", "}"), -1).otherwise(0)
    in_line = Window.partitionBy("file", "block", "line").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.col("_depth") + F.coalesce(F.sum(step).over(in_line), F.lit(0))
    pieces = pieces.select("file", "block", "line", "at", "text", ((F.col("text") == ",") & (depth == 1)).alias("cut"))
    upto = Window.partitionBy("file", "block").orderBy("line", "at").rowsBetween(Window.unboundedPreceding, 0)
    placed = staged(pieces.withColumn("_local", F.sum(F.col("cut").cast("bigint")).over(upto)), "array-pieces")

    cuts = placed.groupBy("file", "block").agg(F.max("_local").alias("_cuts"))
    total = F.sum("_cuts").over(Window.partitionBy("file"))
    numbers = cuts.select("file", "block", _before(F.col("_cuts"), "block").alias("_base"), total.alias("_last"))
    named = placed.join(numbers, ["file", "block"])
    # Pieces of a line follow each other. A comma that cuts leaves an empty piece in the next member, so that none goes unseen.
    part = F.when(F.col("cut"), F.lit("")).when(F.col("at") == 0, F.concat(F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    grouped = named.groupBy("file", (F.col("_base") + F.col("_local")).alias("member")).agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "at", part.alias("part")))).alias("parts"), F.first("_last").alias("_last")
    )
    text = F.btrim(F.array_join(F.transform("parts", lambda p: p["part"]), ""), F.lit(BLANKS))
    first, last = F.col("member") == 0, F.col("member") == F.col("_last")
    whole = grouped.select("file", "member", "_last", bound(_text=text))
    size = F.length("_text") - first.cast("int") - last.cast("int")
    framed = (~first | F.startswith("_text", F.lit("["))) & (~last | F.endswith("_text", F.lit("]"))) & (size >= 0)
    body = F.when(framed, F.substring("_text", F.lit(1) + first.cast("int"), F.greatest(size, F.lit(0))))
    found = whole.select("file", "member", "_last", bound(_body=body))
    members = found.select("file", "member", "_last", "_body", bound(v=F.expr(strict_json("_body"))))
    empty = (F.col("_last") == 0) & (F.btrim("_body", F.lit(BLANKS)) == "")
    return members.filter(~F.coalesce(empty, F.lit(False))).select("file", "member", "v")
