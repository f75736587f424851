"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, clusters, crf, decontam, extract, fingerprints, infill, mixing, neardup, suffixdedup, tokenfiles, urlfilter, warc
from feedloom.llm.common import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents written as flat files in document order, then read back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    files = new_path(spark, "tokens")
    tokenfiles.write_tokens(table(spark, folder, "documents"), files, path, end_id=2)
    back = tokenfiles.read_tokens(spark, files, tokenfiles.file_width(path, 2))
    return back.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with the likeness to the edit and to the next document."""
    docs = fingerprints.with_edits(table(spark, folder, "documents"))
    return docs.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_hex(F.col("print")).alias("fingerprint"),
        fingerprints.as_hex(F.col("edited_print")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        F.coalesce(fingerprints.likeness(F.col("print"), F.col("next_print")), F.lit(0.0)).alias("near_next"),
    )


def contaminated(n_hit, n_words):
    """More than a stray hit: at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of 13 words found in all documents, the words they cover and their items."""
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


ORACLE["op5_decontamination"] = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
    SELECT item_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
    SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 13
        THEN list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))
        ELSE [array_to_string(w, ' ')] END) AS t, least(len(w), 13) AS k
    FROM b WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM win), spot AS (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k
), hit AS (
    SELECT s.doc_id, s.i, s.k, n.item_id FROM spot s JOIN win n
    ON n.k = s.k AND n.t = array_to_string(s.w[s.i:s.i + s.k - 1], ' ')
), words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles overlap by 0.75 or more."""
    return neardup.near_duplicates(table(spark, folder, "documents"))


ORACLE["op2_near_duplicates"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5
        THEN list_transform(range(1, len(w) - 3), lambda i: md5_number(array_to_string(w[i:i + 4], ' ')))
        WHEN len(w) > 0 THEN [md5_number(array_to_string(w, ' '))] ELSE [] END) AS s FROM w
), e AS MATERIALIZED (SELECT doc_id, unnest(s) AS h FROM s),
p AS MATERIALIZED (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
    SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
    WHERE 100 * shared >= 75 * (len(x.s) + len(y.s) - shared)
), ends AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (
    SELECT doc_id, doc_id AS far FROM s UNION SELECT r.doc_id, ends.b FROM reach r JOIN ends ON ends.a = r.far
), low AS (SELECT doc_id, min(far) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN low USING (doc_id)
"""


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents by a line-level conditional random field."""
    docs = table(spark, folder, "documents")
    model = crf.train(docs, table(spark, folder, "labels"))
    return crf.scores(docs, model).select(
        "doc_id", crf.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


URL_RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)


@query
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return urlfilter.judge_urls(table(spark, folder, "pages"), URL_RULES)


@query
def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return extract.extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


@query
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    archives = new_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), archives)
    return warc.read_pages(spark, archives).drop("payload")


ORACLE["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT html, max(page_id) AS holder FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS payload_digest,
    CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < holder THEN holder END AS refers_to
FROM p LEFT JOIN h ON p.html = h.html
"""


def encoded(docs: DataFrame) -> DataFrame:
    """Digests of the ids and of the decoded texts."""
    found = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded and decoded."""
    return encoded(table(spark, folder, "documents"))


@query
def op9_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that start twice or more."""
    found = suffixdedup.remove_repeats(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@query
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut into prefix, middle and suffix at line ends, and rebuilt."""
    found = infill.fill_in_middle(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


ORACLE["op12_fill_in_middle"] = r"""
WITH h AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
        sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x
    FROM documents
), d AS (
    SELECT doc_id, t, l, CAST(len(l) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
        CAST('0x' || x[25:32] AS BIGINT) AS h4
    FROM h
), c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
             WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM d
), p AS (
    SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM p
"""


# Sources of weight 5 lead early, those of weight 1 late; the whole of each is its target.
CURRICULUM = (
    mixing.Schedule(((0.0, 1.5), (1.0, 0.5))), mixing.Schedule(), mixing.Schedule(((0.0, 0.2), (0.5, 1.0), (1.0, 1.8))),
)


@query
def op11_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to target weights: the words that the training stream takes of each."""
    documents, stream = mixing.curriculum(table(spark, folder, "documents"), (5, 2, 1), CURRICULUM, 3)
    return mixing.taken_words(documents, stream).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op11_source_mix"] = r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || sha256('11:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS BIGINT) AS draw
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
    SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s
), o AS (
    SELECT *, row_number() OVER l AS r, sum(source_size) OVER () - (sum(cap) OVER l - cap) AS rest,
        sum(weight) OVER () - (sum(weight) OVER l - weight) AS open
    FROM w WINDOW l AS (ORDER BY cap * 10 // weight, k ROWS UNBOUNDED PRECEDING)
), level AS (
    SELECT CAST(rest AS BIGINT) AS rest, CAST(open AS BIGINT) AS open FROM o WHERE cap * open >= rest * weight ORDER BY r LIMIT 1
), t AS (
    SELECT source, k, source_size, least(CAST(cap AS DOUBLE), CAST(weight * rest AS DOUBLE) / CAST(level.open AS DOUBLE)) AS target,
        least(cap, weight * level.rest // level.open) AS words
    FROM (SELECT source, k, source_size, weight, cap FROM w) CROSS JOIN level
), a AS (
    SELECT d.*, t.source_size, t.target, t.words,
        coalesce(sum(d.size) OVER (PARTITION BY t.k ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size
    + greatest(0, least(size, words % source_size - ahead)) END AS BIGINT) AS taken
FROM a
"""


@query
def op13_shallot_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """All usable embeddings in 40 clusters after five rounds."""
    found = clusters.kmeans(table(spark, folder, "embeddings"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    )


def _rounds_sql(rounds: int) -> str:
    """Assignment of all vectors and mean of all clusters, round after round."""
    near = """a{i} AS MATERIALIZED (
    SELECT v.vec_id, v.v, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM v CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY d, c.c) = 1
)"""
    mean = """c{j} AS MATERIALIZED (
    SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
        SELECT c, list(x ORDER BY k) AS v FROM (
            SELECT c, k, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
            FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS k FROM a{i}) GROUP BY c, k
        ) GROUP BY c
    ) m USING (c)
)"""
    return ",\n".join(near.format(i=i) + (",\n" + mean.format(i=i, j=i + 1) if i < rounds else "") for i in range(rounds + 1))


ORACLE["op13_shallot_clusters"] = f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM v ORDER BY 1 LIMIT 40
),
{_rounds_sql(5)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
    CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a5 a JOIN c5 c USING (c)
"""
