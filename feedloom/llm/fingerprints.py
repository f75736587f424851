"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph is what stands between line feeds. Each is hashed to a wide vector and the vectors of a text are summed:

- `WIDE` lanes, uniform 32-bit values, summed modulo 2^32. They decide equality.
- `SIGNS` lanes of +1 or -1 for each fragment of the paragraph (at most `FRAGMENT` characters between punctuation), summed
  modulo 2^16. The squared length of such a vector estimates how many fragments it stands for, so the difference of two
  fingerprints tells how much two texts share.

Sums do not depend on order, and a paragraph is inserted or deleted by adding or subtracting its vector (`combine`). All of
it is column expressions: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.llm.common import id_and_text

WIDE = 32
SIGNS = 64  # the bits of one hash
FRAGMENT = 64
PARAGRAPH_BREAK = "\n"
FRAGMENT_PATTERN = f"[^.!?,;|\\n]{{1,{FRAGMENT}}}"
# Four 16-bit counters in one number, for bits j, j + 16, j + 32 and j + 48 of a hash. They hold COUNTED fragments; longer
# texts are counted in chunks of that many.
_FOUR = sum(1 << 16 * k for k in range(4))
COUNTED = 2**15 - 1
# Documents of one bucket are neighbours in id order; the number of buckets bounds what is broadcast.
BUCKET_DOCUMENTS = 1024
MAX_BUCKETS = 65536


def wide_lanes(text: Column) -> Column:
    """array<bigint>: the uniform lanes of a text. The empty text has no paragraph and sums to zeros."""
    digests = F.transform(F.split(text, PARAGRAPH_BREAK), lambda p: F.sha2(p, 256))
    digests = F.when(text == "", F.array().cast("array<string>")).otherwise(digests)

    def lanes(all_digests: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.lit(WIDE)),
            lambda i: F.pmod(
                F.aggregate(
                    all_digests, F.lit(0).cast("bigint"),
                    # The number first: it seeds the hash of the whole digest, so that lanes do not hang on one 64-bit value.
                    lambda total, d: total + F.xxhash64(i, d).bitwiseAND(2**32 - 1),
                ),
                F.lit(2**32),
            ),
        )

    return _bind(digests, lanes)


def sign_lanes(text: Column) -> Column:
    """array<int>: the signed lanes of a text, from -2^15 to 2^15 - 1."""
    fragments = F.regexp_extract_all(text, F.lit(f"({FRAGMENT_PATTERN})"))
    hashes = F.transform(fragments, lambda p: F.xxhash64(p))

    def lanes(hashed: Column) -> Column:
        last = F.greatest(F.floor((F.size(hashed) - 1) / COUNTED), F.lit(0)).cast("int")
        chunks = F.transform(
            F.sequence(F.lit(0), last), lambda c: F.slice(hashed, c * COUNTED + 1, F.lit(COUNTED))
        )

        def ones(all_chunks: Column) -> Column:
            def four(j: Column) -> Column:
                counters = F.transform(all_chunks, lambda chunk: F.aggregate(
                    chunk, F.lit(0).cast("bigint"),
                    lambda total, h: total + F.call_function("shiftrightunsigned", h, j).bitwiseAND(_FOUR),
                ))
                return _bind(counters, lambda found: F.array(*[
                    F.aggregate(
                        found, F.lit(0).cast("bigint"),
                        lambda total, c: total + F.shiftrightunsigned(c, 16 * k).bitwiseAND(2**16 - 1),
                    )
                    for k in range(4)
                ]))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), four))

        return F.transform(_bind(chunks, ones), lambda x: _signed(F.size(hashed) - 2 * x).cast("int"))

    return _bind(hashes, lanes)


def _bind(value: Column, body) -> Column:
    """`body` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _signed(value: Column) -> Column:
    """Residue modulo 2^16 nearest to zero."""
    return F.pmod(value + 2**15, F.lit(2**16)) - 2**15


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint struct of the union of two paragraph multisets, or (`sign=-1`) of the first without the second."""
    return F.struct(
        F.zip_with(a["wide"], b["wide"], lambda x, y: F.pmod(x + sign * y, F.lit(2**32))).alias("wide"),
        F.zip_with(a["signs"], b["signs"], lambda x, y: _signed(x + sign * y).cast("int")).alias("signs"),
    )


def fingerprint(text: Column) -> Column:
    """struct<wide: array<bigint>, signs: array<int>> of a text."""
    return F.struct(wide_lanes(text).alias("wide"), sign_lanes(text).alias("signs"))


def as_hex(print_: Column) -> Column:
    """Fixed-width lower-case hex of a fingerprint struct."""
    wide = F.transform(print_["wide"], lambda x: F.lpad(F.hex(x), 8, "0"))
    signs = F.transform(print_["signs"], lambda x: F.lpad(F.hex(F.pmod(x, F.lit(2**16)).cast("bigint")), 4, "0"))
    return F.lower(F.concat(F.array_join(wide, ""), F.array_join(signs, "")))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint structs, 0 to 1: twice the shared part over the sum of both, estimated from the signed
    lanes (standard error about 1 / sqrt(SIGNS)). Equal fingerprints give exactly 1."""
    square = lambda lanes: F.aggregate(lanes, F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    apart = square(F.zip_with(a["signs"], b["signs"], lambda x, y: _signed(x - y)))
    both = square(a["signs"]) + square(b["signs"])
    estimate = F.when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / both)))
    return F.when((a["wide"] == b["wide"]) & (a["signs"] == b["signs"]), 1.0).otherwise(estimate)


def _listed(numbers: list) -> Column:
    """Numbers as an array of texts: one literal after constant folding, however many there are."""
    return F.split(F.lit(",".join(map(str, numbers))), ",")


def _bounds(docs: DataFrame, ranges: int) -> list[int]:
    """First ids of all ranges but the first, at about equal numbers of rows; at most `ranges` numbers reach the driver."""
    if ranges < 2:
        return []
    shares = _listed([k / ranges for k in range(1, ranges)]).cast("array<double>")
    return sorted(set(docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * ranges))).first()[0] or ()))


def _range_of(number: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds a number has reached, by binary search; null for null."""
    if not bounds:
        return F.when(number.isNotNull(), F.lit(0)).cast("bigint")
    known = _listed(bounds).cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    reached = lambda at, step: F.coalesce(F.try_element_at(known, at + step) <= number, F.lit(False))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(at, step), at + step).otherwise(at))
    return F.when(number.isNotNull(), found).cast("bigint")


def with_next(docs: DataFrame, derived: Column, name: str) -> DataFrame:
    """Add the column `name` = `derived`, and `next_text` and `next_<name>`: the values in the document with the next larger
    id, after the last in the first.

    `docs` has bigint `doc_id` and `text`. Rows that share an id follow each other in the order of their texts' hashes; rows
    without an id have no next document. Ids are cut into at most MAX_BUCKETS ranges of about equal numbers of documents,
    however the ids lie; every range also gets the first
    document of the range after it, so no window needs more than its own range. The ranges' first ids are the only broadcast.
    """
    low, rows = docs.agg(F.min("doc_id"), F.count("doc_id")).first()
    buckets = max(1, min(MAX_BUCKETS, rows // BUCKET_DOCUMENTS))
    range_no = _range_of(F.col("doc_id"), _bounds(docs, buckets))
    own = docs.withColumn(
        "bucket", F.coalesce(range_no, -1 - F.pmod(F.xxhash64("text"), F.lit(MAX_BUCKETS)))
    ).withColumn("tail", F.lit(0))
    heads = (
        docs.filter("doc_id is not null").select("doc_id", range_no.alias("bucket"))
        .groupBy("bucket").agg(F.min("doc_id").alias("head"))
        .select("bucket", F.lead("head", 1, low or 0).over(Window.orderBy("bucket")).alias("doc_id"))
    )
    tails = docs.join(F.broadcast(heads), "doc_id").withColumn("tail", F.lit(1))
    order = Window.partitionBy("bucket").orderBy("tail", "doc_id", F.xxhash64("text"))
    rows = own.unionByName(tails).select("*", bound(**{name: derived}))
    following = rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("text", name)))
    return following.filter("tail = 0").select(
        "doc_id", "text", name,
        *(F.when(F.col("doc_id").isNotNull(), F.col(f"next_{c}")).alias(f"next_{c}") for c in ("text", name)),
    )


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, print, edited, edited_print, next_print): each whole text, the text whose last quarter is replaced by as
    many characters from the start of the next document, and their fingerprint structs.

    Null texts are empty. Without a next document (null id) the last quarter is cut off and `next_print` is null.
    """
    base = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    pairs = with_next(base, fingerprint(F.col("text")), "print")
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.char_length("text") - quarter),
        F.coalesce(F.substring("next_text", F.lit(1), quarter), F.lit("")),
    )
    pairs = pairs.select("*", bound(edited=edited))
    return pairs.select("*", bound(edited_print=fingerprint(F.col("edited")))).select(
        "doc_id", "text", "print", "edited", "edited_print", "next_print"
    )
