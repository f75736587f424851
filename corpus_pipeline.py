"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet and rereads it as the next
stage's docs. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import crf, decontam, neardup, suffixdedup
from feedloom.llm.common import broadcast_below, stored
from feedloom.llm.queries import contaminated, encoded, table
from feedloom.llm.running import running

# A repeated passage has 50 words or more; its words are looked for in repeats of at least so many bytes, four a word.
PASSAGE_WORDS = 50
PASSAGE_BYTES = 200


def _packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, text_key): each document as one column, so that no name in it can clash, beside what the stages read."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64(text).alias("text_key"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model does not reject. It learns from the labels of documents that are still here; the score is
    a column of the same scan, so nothing is joined. Null and empty texts are one empty line; repeated rows are judged alike; extra
    columns are passed on; without rows or labels nothing is rejected that scores 0.5 or more."""
    model = crf.train(docs, table(spark, sf_dir, "labels"))
    return crf.with_score(_packed(docs), model, "score").filter("score >= 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Where ids repeat or lack, documents are numbered by id (null last) and text first, so that every text is a document of its own;
    rows that agree in both are copies, of which the first by its JSON text stays. Texts without words are linked with nothing and all
    stay, but for such copies. Extra columns are passed on.
    """
    packed = _packed(docs)
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        numbered = packed.withColumn("number", F.col("doc_id"))
    else:
        single = packed.groupBy("doc_id", "text_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
        names = stored(running(
            single, "near-duplicate-numbers", [F.col("doc_id").asc_nulls_last(), F.col("text_key")], {}
        ), "near-duplicate-numbers")
        numbered = names.select("row", F.col("row.text").alias("text"), F.col("row_rank").alias("number"))
    groups = neardup.near_duplicates(numbered, "number", "text")
    gone = stored(groups.filter("not kept").select(F.col("doc_id").alias("number")).distinct(), "near-duplicates")
    return numbered.join(broadcast_below(gone), "number", "left_anti").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages of PASSAGE_WORDS words or more. Half characters at a cut are dropped; n_chars is
    that of the new text. Copies of a text lose it whole; null texts stay null; extra columns are passed on."""
    return suffixdedup.with_kept_text(docs, window=suffixdedup.Window(PASSAGE_BYTES), words=PASSAGE_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages. Null and empty texts hold no words and stay; rows that share an id
    are judged each by its own text; extra columns are passed on."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = stored(
        found.filter(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
        .distinct(),
        "contaminated",
    )
    rows = _packed(docs)
    same = rows["doc_id"].eqNullSafe(gone["id"]) & (rows["text_key"] == gone["key"])
    return rows.join(broadcast_below(gone), same, "left_anti").select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and digest of the decoded text, one row per row; a null text has no ids."""
    return encoded(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

# The classifier and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
