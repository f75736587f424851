"""Token-ID files: flat unsigned integers, 64-bit document offsets, partition bases from prefix sums.

A shard is one file `part-NNNNN...` of little-endian numbers:

    ids        uint16 or uint32, one document after another, each closed by the end id
    doc ids    int64  x documents (NO_ID for a null)
    offsets    uint64 x (documents + 1), in ids from the start of the shard
    documents  uint64
    tokens     uint64

Shards follow each other in the order of their names and hold ascending document ids, so the global start of a document is
the base of its shard (tokens in all shards before it) plus its offset. `open_shard` maps a local shard into memory.

Spark's text sink writes the files, so the output committer covers lost and repeated tasks. The sink ends every row with a
separator; here that is the zero byte which ends each little-endian number anyway, so the file is the flat array itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import id_and_text, partitions_for, prepare
from feedloom.llm.merges import merges_of

NO_ID = -(2**63)
# Words kept per generation of a worker's table: two generations, some 30 MB each.
CACHE_WORDS = 150_000
# Text of a shard, in bytes: its numbers are read back as one row, which holds 2 GB at most.
SHARD_BYTES = 256 << 20
TAIL = b".,!?;:|"


class Numbered(dict):
    """Words in the order in which they are first asked for; looking a new one up gives it the next number."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class WordEncoder:
    """Ids of whole texts for a tokenizer whose pieces never cross white space.

    Each word of a task is encoded once (as long as the table holds it) and has a number; texts become arrays of numbers, and their ids
    are gathered from one flat array. Words are runs between ASCII white space, in ASCII lower case where the tokenizer's own
    normalizer lower-cases; closing punctuation is encoded apart, because a piece of letters never joins it.
    """

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            config = file.read()
        steps = (json.loads(config)["normalizer"] or {}).get("normalizers", [])
        if not any(step["type"] == "Lowercase" for step in steps):
            raise ValueError("needs a tokenizer that lower-cases and drops white space")
        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype(f"<u{width}")
        self.merges = merges_of(path)
        self.tails: dict[bytes, list[int]] = {b"": []}
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbered()
        self.ids, self.starts, self.lengths = np.empty(0, self.kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def _library(self, words: list[bytes]) -> list[list[int]]:
        return [code.ids for code in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]

    def _encoded(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. Latin letters are one pre-token and need the merges alone; the library encodes the others."""
        out: list[list[int]] = []
        ends: list[bytes] = []
        others: dict[bytes, list[int]] = {}
        one, tails = self.merges.one, self.tails
        for word in words:
            core = word if word[-1] not in TAIL else word.rstrip(TAIL)
            if core.isalpha():  # ASCII letters
                ends.append(word[len(core) :])
                out.append(one(core.lower()))
                continue
            text = core.decode()
            if core != word and not (text and text[-1].lower()[-1].isalpha()):
                core, text = word, word.decode()
            ends.append(word[len(core) :])
            # Lower case keeps to Latin-1, where no normal form differs.
            if text.isalpha() and max(text) <= "\xff":
                out.append(one(text.lower().encode()))
            else:
                others.setdefault(core, []).append(len(out))
                out.append([])
        for places, ids in zip(others.values(), self._library(list(others))):
            for i in places:
                out[i] = ids
        new = [t for t in set(ends) if t not in tails]
        tails.update(zip(new, self._library(new)))
        return [ids + tails[t] if t else ids for ids, t in zip(out, ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of the file's width."""
        if len(self.numbers) > CACHE_WORDS:
            self._forget()
        # A special token is matched in its own case, before the normalizer.
        split = [(x if b"<|" in x else x.lower()).split() for x in map(str.encode, texts)]
        sizes, known = np.array([len(words) for words in split], np.int64), len(self.numbers)
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if len(self.numbers) > known:
            found = self._encoded(list(islice(self.numbers, known, None)))
            lengths = np.array([len(ids) for ids in found], np.int64)
            flat = np.fromiter(chain.from_iterable(found), self.kind, int(lengths.sum()))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, flat])
        lengths = self.lengths[numbers]
        ids = self.ids[runs(self.starts[numbers], lengths)]
        bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=4)
def _encoder(path: str, width: int) -> WordEncoder:
    return WordEncoder(path, width)


def _vocabulary(path: str) -> int:
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    return max([*config["model"]["vocab"].values(), *(t["id"] for t in config["added_tokens"])]) + 1


def id_width(vocabulary: int, end_id: int) -> int:
    """Bytes of an id: 2 where the vocabulary fits and the end id closes with a zero byte, else 4."""
    if end_id < 0 or end_id >= 2**24:
        raise ValueError("the end id must close with a zero byte")
    return 2 if vocabulary <= 2**16 and end_id < 2**8 else 4


def file_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes of an id in the files of this tokenizer."""
    return id_width(_vocabulary(tokenizer_path), end_id)


def _shards(spark: SparkSession, docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(partitions_for(spark), -(-size // SHARD_BYTES))


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    shards: int | None = None,
) -> None:
    """Encode every whole text and write the shards. Null texts are empty; null ids come first; rows that share an id are all
    written, in an order fixed by their texts. There are as many shards as the session has shuffle partitions, or more, so that none
    holds much over SHARD_BYTES of text; `shards` sets their number. An empty table writes no numbers."""
    spark = prepare(docs.sparkSession)
    width = file_width(tokenizer_path, end_id)
    ordered = (
        id_and_text(docs, id_col, text_col)
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards or _shards(spark, docs, text_col), F.col("doc_id").asc_nulls_first(), F.col("tie"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    )

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path, width)
        close = np.array([end_id], f"<u{width}").tobytes()
        ids: list[int] = []
        counts: list[int] = []
        for batch in batches:
            ids += [NO_ID if x is None else x for x in batch.column(0).to_pylist()]
            codes = [code + close for code in encoder.encode(batch.column(1).to_pylist())]
            counts += [len(code) // width for code in codes]
            yield pa.RecordBatch.from_pydict({"value": pa.array([code[:-1] for code in codes], pa.binary())})
        if ids:
            ends = np.cumsum(counts, dtype="<u8")
            tail = b"".join([
                np.array(ids, "<i8").tobytes(), np.zeros(1, "<u8").tobytes(), ends.tobytes(),
                np.array([len(ids), ends[-1]], "<u8").tobytes(),
            ])
            yield pa.RecordBatch.from_pydict({"value": pa.array([tail[:-1]], pa.binary())})

    (
        ordered.mapInArrow(shard, "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\u0000")
        .text(folder)
    )


def parse_shard(data, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, document ids, offsets) of a shard's bytes or memory map, as views."""
    n, tokens = (int(x) for x in np.frombuffer(data, "<u8", 2, len(data) - 16))
    if len(data) != tokens * width + 8 * (2 * n + 3):
        raise ValueError("the shard's length does not fit its counts")
    ids = np.frombuffer(data, f"<u{width}", tokens)
    docs = np.frombuffer(data, "<i8", n, tokens * width)
    offsets = np.frombuffer(data, "<u8", n + 1, tokens * width + 8 * n)
    return ids, docs, offsets


def open_shard(path: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A local shard, memory-mapped: nothing is read until it is used."""
    return parse_shard(np.memmap(path, np.uint8, "r"), width)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)


def shard_bases(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, tokens, base): the base of a shard is the sum of the tokens before it. One row per file, from its last number."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([_shard_number(p) for p in batch.column(0).to_pylist()], pa.int32()),
                "tokens": pa.array([int.from_bytes(t, "little") for t in batch.column(1).to_pylist()], pa.int64()),
            })

    tails = _files(spark, folder).filter("length > 0").select("path", F.expr("substring(content, -8)").alias("tail"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return tails.mapInArrow(totals, "shard int, tokens bigint").withColumn(
        "base", F.coalesce(F.sum("tokens").over(before), F.lit(0))
    )


def _shard_number(path: str) -> int:
    return int(re.search(r"part-(\d+)[^/]*$", path)[1])


def read_tokens(spark: SparkSession, folder: str, width: int) -> DataFrame:
    """(doc_id, start, ids) of every document in the files; `ids` holds little-endian uint32 values with the end id."""
    prepare(spark)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_buffer()
                shard = _shard_number(path)
                ids, docs, offsets = parse_shard(data, width)
                step = 500
                for k in range(0, len(docs), step):
                    own = docs[k : k + step]
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array(np.full(len(own), shard, np.int32)),
                        "doc_id": pa.array(own, mask=own == NO_ID),
                        "local_start": pa.array(offsets[k : k + len(own)].astype("i8")),
                        "ids": pa.array(
                            [ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets[k:], offsets[k + 1 : k + 1 + len(own)])],
                            pa.binary(),
                        ),
                    })

    rows = (
        _files(spark, folder).filter("length > 0").select("path", "content")
        .mapInArrow(documents, "shard int, doc_id bigint, local_start bigint, ids binary")
    )
    # One row per file, so the side to broadcast is bounded by the number of shards.
    bases = shard_bases(spark, folder).select("shard", "base")
    return rows.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "ids"
    )
