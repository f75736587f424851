import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from feedloom.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, before = documents, documents.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), f"test-{name}")
        assert docs.count() <= before
        before = docs.count()
        if name != "token_ids":
            assert docs.columns == COLUMNS
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < before


CLASHING = ["row", "text_key", "number", "score", "_score", "_k1", "_spans", "_cut", "_text_key", "_id", "id", "key", "cut", "spans"]


def texts_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_rows_that_share_an_id(spark):
    """Each text is a document of its own; only copies and near copies go."""
    base, other = [" ".join(f"{w}{k}" for k in range(60)) for w in ("a", "b")]
    rows = [(1, base), (5, base + " more"), (5, other), (5, other), (None, other), (None, "lone text of six words here"), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in CLASHING})
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(1, base), (5, other), (None, "lone text of six words here"), (7, None), (8, "")], key=repr
    )


def test_repeated_passages_by_words(spark):
    """Against a plain scan: bytes under 200-byte strings that start twice, in runs of 50 words or more."""
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(150)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    n, seen = corpus_pipeline.PASSAGE_BYTES, Counter()
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            seen[b[p : p + n]] += 1
    wanted = []
    for i, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        out, at = [], 0
        for m in re.finditer(b"\1+", bytes(gone)):
            if len(b[m.start() : m.end()].split()) >= corpus_pipeline.PASSAGE_WORDS:
                out.append(b[at : m.start()])
                at = m.end()
        wanted.append((i, (b"".join(out) + b[at:]).decode("utf-8", "ignore")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in CLASHING}).withColumn("n_chars", F.lit(0))
    found = corpus_pipeline.repeated_passages(spark, docs, FOLDER)
    assert found.columns == docs.columns and texts_of(found) == sorted(wanted)
    assert sum(a != b for a, b in zip(texts_of(found), sorted(rows))) > 5


def test_stages_on_odd_and_no_rows(spark):
    rows = [(1, None, None, None, None), (None, "text " * 200, "en", "s", 1), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c d e", "en", "s", 9), (4, "long text. " * 20000, "en", "s", 9)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    odd = odd.withColumns({c: F.lit("x") for c in CLASHING})
    for docs in (odd, odd.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, FOLDER)
            assert result.count() <= docs.count(), name
            if name != "token_ids":
                assert result.columns == COLUMNS + CLASHING
