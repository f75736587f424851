"""Near-duplicate documents: MinHash bands, signature check, exact check, connected components.

A document's set holds its distinct shingles of five words. `BANDS` x `ROWS` universal hashes give minima; documents that
agree in a band share a bucket. At a similarity of 0.75 a pair misses all buckets with a probability of 2e-5.

Buckets are not turned into all their pairs. Documents with equal sets are one node from the start. Then nodes are linked in
three rounds, each checked exactly on the full sets and each followed by components:

1. every node with the most connected head among its buckets;
2. every node with the head of each bucket in which it and the head still are in different components;
3. the rest, exactly: nodes of buckets that still hold several components, by a prefix-filtered set join. Shingles are ordered by
   rarity; two sets that overlap enough share one of their rarest quarter, and its place in both bounds the overlap. For each
   shingle only nodes outside its largest component look for partners, and only in other components.

A large group of near copies is one component after the first two rounds. What is left shares common passages but differs in too
many rare shingles, and the bounds rule most of its pairs out before they are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import id_and_text, prepare, stored
from feedloom.llm.components import components

WORDS = 5
SIMILARITY_PERCENT = 75
BANDS = 40
ROWS = 5
SEED = 20240607
# A pair goes on to the exact check unless its signatures agree in less than this share: more than five standard errors
# below a similarity of 0.75.
SIGNATURE_FLOOR = 0.59
# Ids of candidate documents are broadcast to the scan of the texts up to this count (16 bytes each).
BROADCAST_IDS = 2_000_000

_draw = np.random.default_rng(SEED)
_MULTIPLY = _draw.integers(1, 2**64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_ADD = _draw.integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False)
_PLACE = _draw.integers(1, 2**64, WORDS + 1, np.uint64, endpoint=False) | np.uint64(1)
_BAND = _draw.integers(1, 2**64, (BANDS, ROWS), np.uint64, endpoint=False) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each whole text."""
    import xxhash

    split = [text.encode().lower().split() for text in texts]
    hashes = {word: xxhash.xxh64_intdigest(word) for word in set().union(*split)}
    sets = []
    for words in split:
        x = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        n = len(x)
        if n >= WORDS:
            total = np.zeros(n - WORDS + 1, np.uint64)
            for j in range(WORDS):
                total += x[j : n - WORDS + 1 + j] * _PLACE[j]
            sets.append(np.unique(_mix(total)))
        elif n:
            total = (x * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + _PLACE[WORDS:] * np.uint64(n)
            sets.append(_mix(total))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash over a set."""
    low = np.full(len(_MULTIPLY), 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 2048):
        values = shingles[k : k + 2048, None] * _MULTIPLY
        values += _ADD
        np.minimum(low, values.min(axis=0), out=low)
    return low


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, buckets, signature); the last three are null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist())
            keys, buckets, short = [], [], []
            for s in sets:
                if not len(s):
                    keys.append(None), buckets.append(None), short.append(None)
                    continue
                low = minima(s)
                bands = _mix((low.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                keys.append(blake2b(s.tobytes(), digest_size=16).digest())
                buckets.append(bands.view(np.int64))
                short.append((_mix(low) & np.uint64(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "text_key": batch.column(1),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array(keys, pa.binary()),
                "buckets": pa.array(buckets, pa.list_(pa.int64())),
                "signature": pa.array(short, pa.binary()),
            })

    return docs.mapInArrow(
        sign,
        "doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, buckets array<bigint>, signature binary",
    )


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, signature_a, signature_b) whose signatures do not rule the similarity out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, BANDS * ROWS) for c in (2, 3)
            )
            share = ((left == right).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            keep = pa.array(share >= SIGNATURE_FLOOR)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.select("a", "b", "signature_a", "signature_b").mapInArrow(check, "a bigint, b bigint")


def _linked(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, text_a, text_b) whose full sets overlap enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_sets(batch.column(c).to_pylist()) for c in (2, 3)]
            keep = []
            for x, y in zip(*sets):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(shared) and 100 * shared >= SIMILARITY_PERCENT * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


def _shingle_rows(nodes: DataFrame) -> DataFrame:
    """(node, own, node_group, size, shingle) of all shingles; `own` tells several sets of one node apart."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, group, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2).to_pylist())):
                own = int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                same = lambda x: pa.array(np.full(len(s), x, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [same(node), same(own), same(group), same(len(s)), pa.array(s.view(np.int64))],
                    ["node", "own", "node_group", "size", "shingle"],
                )

    return nodes.select("node", "node_group", "text").mapInArrow(
        explode, "node bigint, own bigint, node_group bigint, size bigint, shingle bigint"
    )


def prefix_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, node_group, text) in different groups that a prefix filter leaves; none that overlaps enough is
    lost."""
    rows = stored(_shingle_rows(nodes), "shingles")
    rarity = stored(
        rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("node_group").alias("low"), F.max("node_group").alias("high")),
        "shingle-rarity",
    )
    place = F.row_number().over(Window.partitionBy("node", "own").orderBy("df", "shingle")) - 1
    needed = F.ceil(F.col("size") * SIMILARITY_PERCENT / 100)
    prefix = stored(
        rows.join(rarity, "shingle").withColumn("place", place)
        .filter((F.col("place") <= F.col("size") - needed) & (F.col("low") != F.col("high"))).drop("df", "low", "high", "own"),
        "prefixes",
    )
    largest = stored(
        prefix.groupBy("shingle", "node_group").agg(F.count("*").alias("n"))
        .groupBy("shingle").agg(F.max(F.struct("n", "node_group")).alias("m")).select("shingle", F.col("m.node_group").alias("largest")),
        "largest-groups",
    )
    seekers = stored(prefix.join(largest, "shingle").filter("node_group <> largest").drop("largest"), "seekers")
    one, two = (df.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "node_group", "size", "place")))
                for df, s in ((seekers, "a"), (prefix, "b")))
    # What both sets have from the shared shingle on is the most they can share.
    rest = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    enough = (100 + SIMILARITY_PERCENT) * rest >= SIMILARITY_PERCENT * (F.col("size_a") + F.col("size_b"))
    return (
        one.join(two, "shingle").filter((F.col("node_group_a") != F.col("node_group_b")) & enough)
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    )


class _Checker:
    """Checks candidate pairs, first by signature and then on the full sets."""

    def __init__(self, nodes: DataFrame, texts: DataFrame):
        self.nodes, self.texts = nodes, texts

    def _sides(self, pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return pairs

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        likely = stored(_agreeing(self._sides(pairs, self.nodes, "signature")), f"{name}-likely")
        return stored(_linked(self._sides(likely, self.texts, "text")), f"{name}-links")


def _grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (bucket, node, head, ...) with the components of node and head; what has no link is its own component."""
    found = stored(components(links), "components")
    for side in ("node", "head"):
        own = found.select(F.col("node").alias(side), F.col("component").alias("found"))
        members = members.drop(f"{side}_group").join(own, side, "left").withColumn(
            f"{side}_group", F.coalesce("found", side)
        ).drop("found")
    return members


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    `component_id` is the smallest id that links reach; `kept` marks it. Documents without words are empty sets, linked with
    nothing. Rows that share an id are one node with the links of all of them. Rows without an id have no component and are
    kept. Null texts are empty; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    )
    signed = stored(signatures(texts), "signatures")
    full = signed.filter("set_key is not null and doc_id is not null")
    classes = stored(full.groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
    named = full.join(classes, "set_key")
    # One row for each distinct set. An id with several texts stands for the sets of all of them.
    nodes = stored(
        named.filter("doc_id = node").select("node", "text_key", "n_shingles", "signature", "buckets", "set_key")
        .dropDuplicates(["node", "set_key"]).drop("set_key"),
        "nodes",
    )
    owners = stored(named.select("doc_id", "node").distinct(), "owners")
    same_id = owners.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n"))
    several = owners.join(same_id.filter("n > 1").select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))

    spots = nodes.select("node", "n_shingles", F.explode("buckets").alias("bucket"))
    shared = stored(spots.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "shared-buckets")
    members = stored(spots.join(shared, "bucket"), "bucket-members")
    # How connected a node is: the number of nodes it meets, over all its buckets.
    weight = stored(members.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    weighed = stored(members.join(weight, "node"), "weighed-members")
    heads = stored(
        weighed.groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("weight"), "node")).alias("head"))
        .select("bucket", F.col("head.node").alias("head"), (-F.col("head.weight")).alias("head_weight")),
        "heads",
    )
    members = stored(weighed.select("bucket", "node", "n_shingles").join(heads, "bucket"), "headed-members")

    needed = weight.join(nodes.select("node", "text_key"), "node").select(F.col("node").alias("doc_id"), "text_key")
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    pool = stored(
        texts.join(needed, ["doc_id", "text_key"]).select(F.col("doc_id").alias("node"), "text"),
        "candidate-texts",
    )
    checker = _Checker(nodes, pool)

    best = (
        members.filter("node <> head").groupBy("node")
        .agg(F.min(F.struct((-F.col("head_weight")).alias("w"), "head")).alias("best"))
        .select(F.col("node").alias("a"), F.col("best.head").alias("b"))
    )
    links = several.union(checker.links(best, "first"))

    members = stored(_grouped(members, links), "members-after-first")
    apart = members.filter("node_group <> head_group").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    links = links.union(checker.links(apart, "second"))

    members = stored(_grouped(members, links), "members-after-second")
    mixed = stored(
        members.groupBy("bucket").agg(F.min("node_group").alias("low"), F.max("node_group").alias("high"))
        .filter("low <> high").select("bucket"),
        "mixed-buckets",
    )
    left = stored(members.join(mixed, "bucket").select("node", "node_group").distinct(), "left-nodes")
    rest = prefix_pairs(left.join(pool, "node"))
    links = links.union(checker.links(rest, "third"))

    found = stored(components(links), "components")
    result = owners.join(found, "node", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "node")).alias("component_id")
    )
    rows = signed.select("doc_id", "n_shingles").join(result, "doc_id", "left").withColumn(
        "component_id", F.coalesce("component_id", "doc_id")
    )
    return rows.select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
