"""Tag-set diffs, category counts of the additions, tag details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import or_default, strip
from feedloom.operators.grouping import last_per_key

ADDED, REMOVED = "added", "removed"


def tag_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(tag, change): tags on one side only. One aggregation, combined before the shuffle; blank tags are dropped."""
    sides = old.select("tag", F.lit(True).alias("o"), F.lit(False).alias("n")).unionByName(
        new.select("tag", F.lit(False).alias("o"), F.lit(True).alias("n"))
    )
    seen = sides.filter(strip(F.col("tag")) != "").groupBy("tag").agg(F.bool_or("o").alias("o"), F.bool_or("n").alias("n"))
    change = F.when(F.col("o"), F.lit(REMOVED)).otherwise(F.lit(ADDED))
    return seen.filter(F.col("o") != F.col("n")).select("tag", change.alias("change"))


def tag_records(df: DataFrame, seq: Column, v: str = "v") -> DataFrame:
    """(tag, categories, description) of the last record per tag; records without a tag are dropped."""
    rows = df.select(
        F.expr(f"try_variant_get({v}, '$.tag', 'string')").alias("tag"),
        F.expr(f"try_variant_get({v}, '$.categories', 'array<string>')").alias("categories"),
        F.expr(f"try_variant_get({v}, '$.description', 'string')").alias("description"),
        seq.alias("seq"),
    )
    return last_per_key(rows.filter(F.col("tag").isNotNull()), ["tag"], F.col("seq")).drop("seq")


def added_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of `new` whose tag is not in `old`; both hold one record per tag."""
    return new.join(old.select("tag"), "tag", "left_anti")


def category_counts(added: DataFrame) -> DataFrame:
    """(category, count) of the added tags; a tag without categories counts as Uncategorized."""
    named = F.when(F.size(F.coalesce("categories", F.array())) > 0, F.col("categories"))
    listed = F.coalesce(named, F.array(F.lit("Uncategorized")))
    return added.select(F.explode(listed).alias("category")).groupBy("category").agg(F.count("*").alias("count"))


def tag_details(added: DataFrame) -> DataFrame:
    """(tag, categories, description) as display text with defaults."""
    return added.select(
        "tag",
        or_default(F.array_join("categories", ", "), "None").alias("categories"),
        or_default(F.col("description"), "No description provided.").alias("description"),
    )


def tag_metadata(added: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata records of the added tags; tags without metadata are left out."""
    return added.select("tag").join(metadata, "tag")
