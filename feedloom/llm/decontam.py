"""Benchmark decontamination: a prefix-filtered set join of item windows against documents.

Every benchmark item gives windows of `WINDOW` consecutive words; a shorter item is one window. A window is a set of word
shingles at known offsets. For full containment the necessary prefix is a single shingle: a document that holds the window
holds the window's rarest shingle, so only that one is joined. Rarity is counted over all documents. The offset of the
shingle bounds the place of the window (it must start and end inside the document), and the words there are then compared.

Everything is DataFrame functions. Documents are read word by word once, and only places of benchmark shingles leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import ascii_lower, id_and_text, stored

WINDOW = 13
SHINGLE = 5
# Benchmark shingles are broadcast up to this count (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, letters and everything beyond ASCII, A-Z in lower case."""
    return F.filter(F.split(ascii_lower(text), WORD_BREAK), lambda w: w != "")


def _shingles(words: Column, size: int) -> Column:
    """array<bigint>: hashes of all runs of `size` words, by position."""
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(size)))
    )


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, win): windows as arrays of words. Items without words and rows with a null id give none."""
    words = id_and_text(items, item_col, text_col).select(F.col("doc_id").alias("item_id"), words_of(F.col("text")).alias("w"))
    whole = F.when(F.size("w") > 0, F.array("w")).otherwise(F.array().cast("array<array<string>>"))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - (window - 1)), lambda i: F.slice("w", i, F.lit(window)))
    return (
        words.filter("item_id is not null")
        .select("item_id", F.explode(F.when(F.size("w") >= window, cut).otherwise(whole)).alias("win"))
        .distinct()
    )


def _places(docs: DataFrame, size: int, wanted: DataFrame, reach: int) -> DataFrame:
    """(doc_id, text_key, n_words, pos, shingle, first, around): every place of a wanted shingle with `reach` words about it."""
    found = (
        docs.filter(F.size("w") >= size)
        .select("doc_id", "text_key", "w", F.posexplode(_shingles(F.col("w"), size)).alias("pos", "shingle"))
        .withColumn("pos", F.col("pos") + 1)
        .join(wanted, "shingle")
    )
    first = F.greatest(F.col("pos") - reach, F.lit(1))
    return found.select(
        "doc_id", "text_key", F.size("w").alias("n_words"), "pos", "shingle", first.alias("first"),
        F.slice("w", first, F.col("pos") - first + size + reach).alias("around"),
    )


def find_windows(docs: DataFrame, windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, start, length, win): every place where a window occurs in a document (positions from 1).

    `docs` has doc_id, text_key and the word array w; `windows` has distinct word arrays win.
    """
    spark = docs.sparkSession
    parts = stored(windows.select(
        "win", F.least(F.size("win"), F.lit(shingle)).alias("size")
    ).select("win", "size", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.size("win") - F.col("size")), lambda o: F.xxhash64(F.slice("win", o + 1, F.col("size")))
    )).alias("offset", "shingle")), "window-shingles")
    shape = parts.agg(
        F.collect_set("size").alias("sizes"), F.max(F.size("win")).alias("longest"), F.count_distinct("shingle").alias("n")
    ).first()
    wanted = parts.select("shingle").distinct()
    if shape["n"] <= BROADCAST_SHINGLES:
        wanted = F.broadcast(wanted)
    places = None
    for size in sorted(shape["sizes"]):
        part = _places(docs, size, wanted, shape["longest"] - size)
        places = part if places is None else places.unionByName(part)
    if places is None:
        return spark.createDataFrame([], "doc_id bigint, text_key bigint, start int, length int, win array<string>")
    places = stored(places, "shingle-places")
    rarity = places.groupBy("shingle").count()
    anchors = (
        parts.join(rarity, "shingle", "left")
        .groupBy("win")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "offset")).alias("rarest"))
        .filter("rarest.count > 0")
        .select("win", "rarest.shingle", "rarest.offset", F.size("win").alias("length"))
    )
    start = F.col("pos") - F.col("offset")
    return (
        places.join(anchors, "shingle")
        .filter((start >= 1) & (start + F.col("length") - 1 <= F.col("n_words")))
        .filter(F.slice("around", start - F.col("first") + 1, F.col("length")) == F.col("win"))
        .select("doc_id", "text_key", start.alias("start"), "length", "win")
    )


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items): per document row the words inside occurring windows and the ids of their items.

    `items` is the sorted array of ids as strings. Null texts have no words; rows that share an id are judged each by its own
    text (`text_key` is the text's hash); a null document id is kept; without benchmark rows nothing is hit.
    """
    texts = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w")
    )
    owned = stored(item_windows(items, item_col, item_text_col, window), "item-windows")
    hits = stored(find_windows(texts, owned.select("win").distinct(), shingle), "window-hits")
    by_start = Window.partitionBy("doc_id", "text_key").orderBy("start")
    covered = (
        hits.groupBy("doc_id", "text_key", "start").agg((F.col("start") + F.max("length")).alias("end"))
        .withColumn("before", F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("before", F.lit(0)))))
        .groupBy("doc_id", "text_key").agg(F.sum("new").alias("n_hit"))
    )
    named = (
        hits.select("doc_id", "text_key", "win").distinct().join(owned, "win")
        .select("doc_id", "text_key", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    found = covered.join(named, _same(covered, named)).select(
        covered["doc_id"], covered["text_key"], "n_hit", "items"
    )
    counted = texts.select("doc_id", "text_key", F.size("w").cast("bigint").alias("n_words"))
    return counted.join(found, _same(counted, found), "left").select(
        counted["doc_id"], counted["text_key"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
