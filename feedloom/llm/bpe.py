"""Byte-pair encoding through a table of distinct words, and decoding through an id-to-piece join.

Spark splits all texts into words and counts them. The most frequent words, at most `TABLE_WORDS`, form the word table: each is
encoded once, and its pieces are found by joining its ids with the vocabulary. The table is joined back by position, as a
broadcast whose size is bounded by that count. The long tail of rare words is encoded where it stands, once per task as long as
the task's own table holds it: joining each of its places through a shuffle would move every text twice.

A word is cut only where the pre-tokenizer must cut too: before a single space, around a single line feed, and between a
letter and closing punctuation. So the ids of a text are the ids of its words, one after another. The words of a batch are an
Arrow array over the bytes of its texts; Python sees each distinct word of a batch once, and what a text gives is taken by number.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import id_and_text, prepare, stored
from feedloom.llm.merges import byte_of, is_letters, merges_of

TABLE_WORDS = 150_000
# Words that a task counts before it passes them on, and words of one generation of a task's own table.
COUNTED_WORDS = 250_000
OWN_WORDS = 100_000
# Words encoded at once, for the library's results take far more than the ids; and characters of text looked up at once.
CODED_WORDS = 2_000
BLOCK = 1 << 20
TAIL = b".,!?;:|"
# White space beyond ASCII: all of it starts with one of few bytes.
_WIDE = [c.encode() for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]


def _bytes_in(values: bytes) -> np.ndarray:
    """For each byte whether it is one of the values."""
    return np.isin(np.arange(256), list(values))


_WHITE, _LEADS = _bytes_in(b"\t\n\v\f\r\x1c\x1d\x1e\x1f "), _bytes_in(bytes({c[0] for c in _WIDE}))
_CUTS, _CLOSING = _bytes_in(b" \n"), _bytes_in(TAIL)


def _white(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 whether it belongs to white space."""
    white = _WHITE[data]
    leads = np.flatnonzero(_LEADS[data])
    for char in _WIDE if len(leads) else ():
        at = leads[leads <= len(data) - len(char)]
        for k, byte in enumerate(char):
            at = at[data[at + k] == byte]
        for k in range(len(char)):
            white[at + k] = True
    return white


def _binary(offsets: np.ndarray, data) -> pa.Array:
    """The bytes between each offset and the next."""
    at = np.ascontiguousarray(offsets, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


def _joined(values: pa.Array, numbers: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The values of these numbers, joined between each bound and the next."""
    if not len(numbers):
        return _binary(np.zeros(len(bounds)), b"")
    taken = values.take(pa.array(numbers))
    _, offsets, data = taken.buffers()
    return _binary(np.frombuffer(offsets, np.int64, len(taken) + 1)[bounds], data if data is not None else b"")


def _ends(sizes) -> np.ndarray:
    """Zero and the running sum."""
    return np.concatenate([[0], np.cumsum(np.fromiter(sizes, np.int64))])


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the number of words ahead of each text and after the last. Joined, the words of a text give it."""
    coded = [text.encode() for text in texts]
    bounds, whole = _ends(map(len, coded)), b"".join(coded)
    data = np.frombuffer(whole, np.uint8)
    starts = np.zeros(len(data) + 1, bool)
    starts[bounds] = True
    white = np.append(_white(data), True)
    # A space or a line feed between characters of its text that are no white space.
    places = np.flatnonzero(_CUTS[data])
    alone = places[~(starts[places] | starts[places + 1] | white[places - 1] | white[places + 1])]
    starts[alone] = True
    starts[alone[data[alone] == ord("\n")] + 1] = True
    starts = np.flatnonzero(starts)
    return _binary(starts, whole), np.searchsorted(starts, bounds)


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[list[str]]:
    """All texts in their order, some at a time: no more characters than `size`, or one text."""
    held, length = [], 0
    for text in texts:
        if held and length + len(text) > size:
            yield held
            held, length = [], 0
        held.append(text)
        length += len(text)
    if held:
        yield held


def parts_of(word: bytes) -> tuple[bytes, ...]:
    """A word without its closing punctuation, and the punctuation."""
    core = word.rstrip(TAIL)
    if core and len(core) < len(word) and core.decode()[-1].isalpha():
        return core, word[len(core) :]
    return (word,)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> list[bytes]:
    """The bytes of each id."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    table, found = byte_of(), {}
    for token, number in config["model"]["vocab"].items():
        found[number] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    found |= {t["id"]: t["content"].encode() for t in config["added_tokens"]}
    return [found.get(k, b"") for k in range(max(found) + 1)]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores; every thread keeps memory of its own
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_words(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, and the number of ids ahead of each word and after the last. Letters, with or without a space ahead, are one
    pre-token and need the merges alone; the library encodes the others."""
    coded = [_encode(path, words[k : k + CODED_WORDS]) for k in range(0, len(words), CODED_WORDS)]
    return np.concatenate([np.empty(0, np.uint32), *(ids for ids, _ in coded)]), _ends(chain.from_iterable(n for _, n in coded))


def _encode(path: str, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Ids of all words, and their number in each word."""
    one = merges_of(path).one
    out: list[list[int]] = []
    rest: list[int] = []
    for i, word in enumerate(words):
        core = word[1:] if word[:1] == b" " else word
        if core.isalpha() or is_letters(core.decode()):  # ASCII letters are told without decoding
            out.append(one(word))
        else:
            rest.append(i)
            out.append([])
    for i, code in zip(rest, _tokenizer(path).encode_batch([words[i].decode() for i in rest], add_special_tokens=False)):
        out[i] = code.ids
    sizes = list(map(len, out))
    return np.fromiter(chain.from_iterable(out), np.uint32, sum(sizes)), sizes


def _parted(words: pa.Array, n: pa.Array) -> list[pa.Table]:
    """Words of several parts replaced by their parts."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64, len(words) + 1)[1:]
    closed = _CLOSING[np.frombuffer(data, np.uint8)[ends - 1]] if len(words) else np.zeros(0, bool)
    parts = [parts_of(word) for word in words.filter(pa.array(closed)).to_pylist()]
    times = np.repeat(n.to_numpy()[closed], [len(p) for p in parts])
    split = pa.array(list(chain.from_iterable(parts)), pa.large_binary())
    rest = pa.array(~closed)
    return [pa.table([words.filter(rest), n.filter(rest)], ["word", "n"]), pa.table([split, pa.array(times, pa.int64())], ["word", "n"])]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): parts of words with their number over all texts. `docs` has the column text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        pool = pa.default_memory_pool()

        def summed() -> pa.Table:
            found = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return found.rename_columns(["word", "n"])

        def packed(found: pa.Table) -> list[pa.RecordBatch]:
            return found.cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).to_batches()

        for batch in batches:
            counted = words_of(batch.column(0).to_pylist())[0].value_counts()
            held += _parted(counted.field(0), counted.field(1))
            pool.release_unused()
            if sum(map(len, held)) > 2 * COUNTED_WORDS:
                held[:] = [summed()]
                if len(held[0]) > COUNTED_WORDS:
                    yield from packed(held.pop())
        if held:
            yield from packed(summed())
        held.clear()
        pool.release_unused()

    return docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, limit: int = TABLE_WORDS) -> DataFrame:
    """The words with the highest counts, at most `limit`: all words from the smallest count that keeps to it."""
    # One row per distinct count reaches the driver; their number grows with the root of the number of words.
    held = 0
    least = None
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        held += row["words"]
        if held > limit:
            break
        least = row["n"]
    return counts.filter(F.lit(False) if least is None else F.col("n") >= least)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the vocabulary."""
    rows = pa.table({"id": pa.array(range(len(pieces_of(path))), pa.int64()), "piece": pa.array(pieces_of(path), pa.binary())})
    return spark.createDataFrame(rows)


def word_table(words: DataFrame, path: str) -> DataFrame:
    """(word, ids, pieces): every word encoded once, its pieces from the id-to-piece join, both in order."""
    spark = words.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = encode_words(path, batch.column(0).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["word", "ids"])

    coded = stored(words.select("word").mapInArrow(encode, "word binary, ids array<bigint>"), "word-ids")
    # The vocabulary has as many rows as the tokenizer has ids.
    placed = coded.select("word", F.posexplode("ids").alias("at", "id")).join(F.broadcast(vocabulary(spark, path)), "id")
    ordered = placed.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "id", "piece"))).alias("x"))
    return ordered.select("word", F.col("x.id").alias("ids"), F.col("x.piece").alias("pieces"))


class _Words:
    """Ids and bytes of words by number: the shared table, and what a task has encoded itself."""

    def __init__(self, path: str, table: dict[bytes, tuple[bytes, bytes]]):
        self.path, self.table = path, list(table)
        self.vocabulary = pa.array(pieces_of(path), pa.large_binary())
        self.shared = [pa.array([x[side] for x in table.values()], pa.large_binary()) for side in range(2)]
        self._forget()

    def _forget(self) -> None:
        self.numbers = dict(zip(self.table, range(len(self.table))))
        self.ids, self.pieces = self.shared

    def _add(self, words: list[bytes], ids: pa.Array, pieces: pa.Array) -> None:
        self.numbers.update(zip(words, range(len(self.ids), len(self.ids) + len(words))))
        self.ids, self.pieces = pa.concat_arrays([self.ids, ids]), pa.concat_arrays([self.pieces, pieces])

    def _learn(self, words: list[bytes]) -> None:
        """Encode the parts of these words that have no number yet, and put the words together."""
        split = [parts_of(word) for word in words]
        new = list({part for parts in split for part in parts if part not in self.numbers})
        ids, bounds = encode_words(self.path, new)
        self._add(new, _binary(4 * bounds, ids.astype("<u4").tobytes()), _joined(self.vocabulary, ids, bounds))
        several = [(word, parts) for word, parts in zip(words, split) if len(parts) > 1]
        numbers = self._numbers([part for _, parts in several for part in parts])
        bounds = _ends(len(parts) for _, parts in several)
        self._add([word for word, _ in several], _joined(self.ids, numbers, bounds), _joined(self.pieces, numbers, bounds))

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def look_up(self, texts: list[str]) -> list[list[tuple[bytes, bytes]]]:
        """(ids, bytes) of each text."""
        if len(self.numbers) > len(self.table) + OWN_WORDS:
            self._forget()
        words, bounds = words_of(texts)
        coded = words.dictionary_encode()
        own = coded.dictionary.to_pylist()
        if new := [word for word in own if word not in self.numbers]:
            self._learn(new)
        numbers = self._numbers(own)[coded.indices.to_numpy()]
        ids, pieces = (_joined(values, numbers, bounds).to_pylist() for values in (self.ids, self.pieces))
        return [[pair] for pair in zip(ids, pieces)]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, ids, decoded) for every row: `ids` as little-endian uint32 values, and the text that decoding them gives.

    Null texts are empty and have no ids; an empty table gives no rows. Special tokens inside a text get their own ids, as the
    tokenizer gives them; bytes that are no UTF-8 decode to replacement characters.
    """
    spark = prepare(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    counts = stored(count_words(texts), "word-counts")
    rows = word_table(frequent(counts, table_words), path).toLocalIterator(prefetchPartitions=True)
    # At most table_words rows.
    shared = spark.sparkContext.broadcast({
        bytes(r["word"]): (np.array(r["ids"], "<u4").tobytes(), b"".join(map(bytes, r["pieces"]))) for r in rows
    })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The worker outlives the task, and with it what its pool keeps.
        words, pool = _Words(path, shared.value), pa.default_memory_pool()
        for batch in batches:
            ids, decoded = [], []
            for part in blocks(batch.column(1).to_pylist()):
                found = words.look_up(part)
                ids += [b"".join([x for x, _ in row]) for row in found]
                decoded += [b"".join([x for _, x in row]).decode("utf-8", "replace") for row in found]
                pool.release_unused()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
            )
        del words
        pool.release_unused()

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
