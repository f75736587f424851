"""Readers for JSON-lines feeds, JSON documents, tag lists, sheets and ip lists."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.functions.sqltext import as_array, as_object, listed_json, only_member, strict_json, stripped
from feedloom.functions.text import strip
from feedloom.session import staged
from feedloom.sources.documents import array_members

DOCUMENT, JSONL, AUTO = "document", "jsonl", "auto"

# Largest object one row can hold.
DOCUMENT_BYTES = 2**31 - 1

# File extensions that always hold one JSON value per line.
LINE_SUFFIXES = (".jsonl", ".ndjson", ".jsonl.gz", ".ndjson.gz")

# Spellings of the ip member of a record, compared without case.
IP_KEYS = ["ip", "ip_address", "ipaddress"]


def parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the parsed record `v`, parsed once per line; NULL where a line is not one JSON value and nothing else."""
    # In two steps without lambdas, which would leave the parse out of generated code.
    listed = df.select("*", bound(_listed=F.expr(listed_json(raw))))
    return listed.select(*df.columns, bound(v=F.expr(only_member("_listed"))))


def spread(scan: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread the rows of a scan over `partitions`; by default, and for any input in many splits, nothing is shuffled.

    Gzip files and single row groups are one split each, so a small input of them may be worth it.
    """
    return scan.repartition(partitions) if partitions else scan


def _position() -> list[Column]:
    """File position of a line: comparable within and across splits of the same input."""
    return [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    ]


def read_lines(
    spark: SparkSession, path: str | list[str], partitions: int | None = None, keep_blank: bool = False
) -> DataFrame:
    """Lines as (raw, file, block, line), without blank ones. Gzip is read natively; `partitions` spreads few splits out."""
    text = spark.read.text(path).select(strip(F.col("value")).alias("raw"), *_position())
    return spread(text if keep_blank else text.filter(F.col("raw") != ""), partitions)


def read_feed(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """JSON-lines feed: (raw, file, block, line, v); blank and malformed lines are dropped."""
    return parsed(read_lines(spark, path, partitions)).filter(F.col("v").isNotNull())


def position(df: DataFrame) -> Column:
    """Order of a line, or of a record within a document, for "last occurrence wins"."""
    return F.struct("file", "block", "line", *(["item"] if "item" in df.columns else []))


def position_chunk() -> list[Column]:
    """Coarse, order-preserving part of the position: at most 2^20 lines share one chunk."""
    return [F.col("file"), F.col("block"), F.shiftright("line", 20).alias("block_part")]


def malformed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row with the number of lines that are not JSON."""
    lines = parsed(read_lines(spark, path))
    return lines.agg(F.count_if(F.col("v").isNull()).alias("malformed"))


def unwrapped(df: DataFrame, objects_only: bool = False) -> DataFrame:
    """Replace an array value by its members, numbered by `item`; everything else stays one row."""
    keep = [c for c in df.columns if c != "v"]
    out = df.select(*keep, F.expr(f"posexplode(coalesce({as_array('v')}, array(v)))").alias("item", "v"))
    return out.filter(F.expr(f"{as_object('v')} is not null")) if objects_only else out


def _heads(spark: SparkSession, paths: list[str], whole: bool = False) -> DataFrame:
    """(file, is_array, size) of the files whose first line is not JSON on its own but opens an array or object: only these can be one
    document over many lines. With `whole`, of all files that open one."""
    text = spark.read.text(paths).select(
        strip(F.col("value")).alias("raw"), *_position(), F.col("_metadata.file_size").alias("size")
    )
    first = text.filter(F.col("raw") != "").groupBy("file").agg(
        F.min_by("raw", F.struct("block", "line")).alias("head"), F.max("size").alias("size")
    )
    opened = first.filter(F.col("head").rlike(r"^[\[{]"))
    if not whole:
        opened = opened.filter(F.expr(strict_json("head")).isNull())
    return staged(opened.select("file", F.startswith("head", F.lit("[")).alias("is_array"), "size"), "document-heads")


def _object_documents(spark: SparkSession, heads: DataFrame) -> DataFrame | None:
    """(file, line, v) of the files that open an object, each as one document or else by its lines; a file has to fit a row."""
    files = heads.filter("not is_array").select("file", "size").collect()  # names only, one per file
    if not files:
        return None
    large = [r.file for r in files if r.size > DOCUMENT_BYTES]
    if large:
        raise ValueError(f"too large for one record: {large[0]}")
    # File names in metadata are URL-encoded, paths to read are not.
    text = spark.read.text([unquote(r.file) for r in files], wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    doc = parsed(text, "value")
    lines = f"transform(filter(split(value, '\\\\R'), l -> {stripped('l')} <> ''), l -> {strict_json(stripped('l'))})"
    items = F.expr(f"posexplode(if(v is null, {lines}, array(v)))").alias("line", "v")
    return doc.select("file", items).filter("v is not null")


def read_documents(spark: SparkSession, path: str | list[str], format: str = AUTO, objects_only: bool = False) -> DataFrame:
    """Records (raw, file, block, line, item, v) of JSON arrays, single objects or JSON lines.

    auto: a file whose first line parses is read by line, any other as one document, falling back to its lines if the document does
    not parse. An array of any size is cut into its members by many tasks; an object is one record. Finding the first lines is one
    more pass over files that do not end in .jsonl or .ndjson: name the format for large inputs. Malformed lines are dropped.
    """
    columns = ["raw", "file", "block", "line", "item", "v"]
    paths = [path] if isinstance(path, str) else list(path)
    if format == JSONL or (format == AUTO and all(p.lower().endswith(LINE_SUFFIXES) for p in paths)):
        return unwrapped(read_feed(spark, paths), objects_only).select(columns)
    heads = _heads(spark, paths, format == DOCUMENT)
    arrays = heads.filter("is_array").select("file")
    out = unwrapped(read_feed(spark, paths).join(heads.select("file"), "file", "left_anti"), objects_only).select(columns)
    if not arrays.isEmpty():
        lines = read_lines(spark, paths).join(arrays, "file", "left_semi")
        members = staged(array_members(lines), "array-members")
        broken = members.filter("v is null").select("file").distinct()
        # Member numbers beyond an int go on in `line`.
        top = F.lit(2**30)
        good = members.join(broken, "file", "left_anti").select(
            F.to_json("v").alias("raw"), "file", F.lit(0).cast("bigint").alias("block"), F.expr("member div 1073741824L").alias("line"),
            (F.col("member") % top).cast("int").alias("item"), "v",
        )
        by_line = parsed(lines.join(broken, "file", "left_semi")).filter("v is not null")
        out = out.unionByName(good.filter(F.expr(f"{as_object('v')} is not null")) if objects_only else good)
        out = out.unionByName(unwrapped(by_line, objects_only).select(columns))
    documents = _object_documents(spark, heads)
    if documents is not None:
        out = out.unionByName(unwrapped(documents, objects_only).select(
            F.to_json("v").alias("raw"), "file", F.lit(0).cast("bigint").alias("block"), F.col("line").cast("bigint").alias("line"), "item", "v"
        ))
    return out


def array_to_lines(spark: SparkSession, path: str) -> DataFrame:
    """Members of a JSON array file of any size as canonical lines (`value`); anything but an array is an error."""
    members = array_members(read_lines(spark, path))
    checked = F.when(F.col("v").isNull(), F.raise_error(F.lit("input is not a JSON array")).cast("string")).otherwise(F.to_json("v"))
    return members.select(checked.alias("value"))


def tag_text(v: str, raw: str) -> Column:
    """Tag of a line: its `tag` member, the string itself, or the raw text when it is not JSON."""
    return F.expr(
        f"case when {v} is null then {raw} "
        f"when {as_object(v)} is not null then try_variant_get({v}, '$.tag', 'string') "
        f"when schema_of_variant({v}) = 'STRING' then try_cast({v} as string) end"
    )


def read_tags(spark: SparkSession, path: str | list[str], objects_only: bool = False) -> DataFrame:
    """Tags (`tag`) of a metrics file: array of strings or objects, lines of either, or raw text lines.

    objects_only keeps just the `tag` members of objects. Values without a tag are dropped.
    """
    paths = [path] if isinstance(path, str) else list(path)
    heads = _heads(spark, paths)
    lines = parsed(read_lines(spark, paths)).join(heads, "file", "left_anti")
    items = unwrapped(lines).select("raw", "v")
    whole = [unquote(r.file) for r in heads.select("file").collect()]  # names only, one per file
    if whole:
        items = items.unionByName(read_documents(spark, whole, DOCUMENT).select("raw", "v"))
    if objects_only:
        items = items.filter(F.expr(f"{as_object('v')} is not null"))
    return items.select(tag_text("v", "raw").alias("tag")).filter(F.col("tag").isNotNull() & (F.col("tag") != ""))


def read_tag_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Plain tag list, one per line; blank lines are dropped."""
    return read_lines(spark, path).select(F.col("raw").alias("tag"))


def read_sheet(spark: SparkSession, path: str | list[str], multi_line: bool = False, position: str | None = None) -> DataFrame:
    """CSV sheet with lower-case, trimmed headers; every cell is text. Quotes in a quoted cell are doubled.

    `multi_line` reads line breaks inside quoted cells; a file is then one task. `position` names a column for the place of each row.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line)
    names = [c.strip().lstrip("\ufeff").lower() for c in df.columns]
    if not position:
        return df.toDF(*names)
    return df.select("*", F.struct(*_position()).alias(position)).toDF(*names, position)


def read_items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Items (`item`) of a free-form list, split on commas and white space."""
    return split_items(spark.read.text(path), "value")


def split_items(df: DataFrame, column: str) -> DataFrame:
    items = F.explode(F.split(F.col(column), r"[,\s]+")).alias("item")
    return df.select(items).filter(F.col("item") != "")


def ip_key(df: DataFrame, v: str = "v") -> str | None:
    """Name of the ip member, taken from the first record (one-row read)."""
    row = df.select(F.expr(f"map_keys({as_object(v)})").alias("keys")).filter("keys is not null").first()
    return next((k for k in (row.keys if row else []) if k.lower() in IP_KEYS), None)


def ip_text(key: str | None = None, v: str = "v") -> Column:
    """Trimmed ip of a record; without a key the known spellings are tried in any case."""
    if key:
        value = F.expr(f"try_cast(element_at({as_object(v)}, '{key}') as string)")
    else:
        names = ", ".join(f"'{k}'" for k in IP_KEYS)
        found = f"map_values(map_filter({as_object(v)}, (k, x) -> lower(k) in ({names})))"
        value = F.expr(f"try_element_at({found}, 1)").try_cast("string")
    return F.nullif(strip(value), F.lit(""))


def keyed_records(df: DataFrame, key: str | None = None) -> DataFrame:
    """Add `ip`; records without one are dropped."""
    return df.withColumn("ip", ip_text(key)).filter(F.col("ip").isNotNull())


def stamp_text(default: str, v: str = "v") -> Column:
    """Date label of a record: `Timestamp`, else `timestamp`, else the default."""
    return F.coalesce(
        F.expr(f"try_variant_get({v}, '$.Timestamp', 'string')"),
        F.expr(f"try_variant_get({v}, '$.timestamp', 'string')"),
        F.lit(default),
    )


def land_feed(df: DataFrame, path: str, dataset: str, snapshot_date: str) -> None:
    """Keep a parsed feed as Parquet with a VARIANT column, partitioned for date lookups."""
    out = df.select("raw", "v").withColumns({"dataset": F.lit(dataset), "snapshot_date": F.lit(snapshot_date)})
    out.write.mode("append").partitionBy("dataset", "snapshot_date").parquet(path)
