"""Exact removal of repeated byte strings, by sorted suffixes with common-prefix lengths.

A byte goes if a string of a given length (400 bytes unless told otherwise) that covers it also starts somewhere else. Only some suffixes are sorted, the others are
induced from them:

1. Anchors. Of the grams of a fifth of that length in every window of that length those with the smallest hash are anchors. The choice
   depends on the window only, so equal windows have equal anchors at equal places. (In a run of a short period all windows
   repeat inside the run; it is removed as it stands, and only its first period keeps anchors for other texts to meet.)
2. Anchors that occur once are dropped. Places of an anchor with the same surroundings (all windows through it) repeat as a
   whole and need no comparison.
3. What is left are the ends of repeated passages. The suffixes at these anchors are sorted by Spark's external sort, which
   spills to disk and hands each task its suffixes in order; neighbours give the common-prefix lengths.
   The suffixes before an anchor are induced from that order, byte by byte to the left: two of them agree on the whole length if the
   bytes back to the anchor agree and the sorted suffixes agree on the rest, so the groups change only at the common-prefix
   lengths of the two directions.

The length is bounded, so one level of induction ends the recursion. Anchors with more than `CLASS_MEMBERS` different
surroundings are not compared in one task: their windows are counted by hash in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import id_and_text, prepare, release, stored

LENGTH = 400
MAX_LENGTH = 1000
SIDES = 4  # two windows that agree share one of so many substrings of length - step bytes about their anchor
CLASS_MEMBERS = 50_000
CHUNK = 1 << 20
# The spans to remove are broadcast up to this many (some 50 bytes each), else shuffled.
BROADCAST_PLACES = 200_000


@dataclass(frozen=True)
class Window:
    """Bytes of a repeat, and what follows from it."""

    length: int = LENGTH

    def __post_init__(self):
        if not 40 <= self.length <= MAX_LENGTH:
            raise ValueError(f"a repeat has 40 to {MAX_LENGTH} bytes")

    @property
    def gram(self) -> int:
        return self.length // 5

    @property
    def reach(self) -> int:
        """Bytes before an anchor that a window through it can cover."""
        return self.length - self.gram

    @property
    def step(self) -> int:
        return self.reach // SIDES

    @property
    def max_period(self) -> int:
        return self.length // 2

_draw = np.random.default_rng(20240611)
_BYTE = _draw.integers(0, 2**64, 256, np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SIZE = CHUNK + 4 * MAX_LENGTH
with np.errstate(over="ignore"):
    _POWER = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_SIZE, _BASE, np.uint64)]))
    _INVERSE = np.multiply.accumulate(
        np.concatenate([np.ones(1, np.uint64), np.full(_SIZE, np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64)])
    )


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes:
    """Hashes of all substrings of a piece of text of at most _SIZE bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _POWER[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * _INVERSE[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mix((self.sums[length:] - self.sums[:n]) * _INVERSE[:n])


def _sliding(values: np.ndarray, width: int, best: np.ufunc, filler: int) -> np.ndarray:
    """`best` over every run of `width` values, by running bests inside blocks of that width from both sides."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, filler, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - width + 1], ahead[width - 1 : n])


def _selected(grams: np.ndarray, reach: int) -> np.ndarray:
    """Places of grams that are the smallest of some window."""
    least = _sliding(grams, reach + 1, np.minimum, 2**64 - 1)
    padded = np.zeros(len(least) + 2 * reach, np.uint64)
    padded[reach : reach + len(least)] = least
    # A gram is the smallest of a window that holds it if the largest minimum of these windows is its own value.
    return np.flatnonzero(_sliding(padded, reach + 1, np.maximum, 0) == grams)


def _periodic(data: np.ndarray, places: np.ndarray, grams: np.ndarray, window: Window) -> list[tuple[int, int, int]]:
    """(start, end, period) of runs of a short period that are longer than a window and a period."""
    gaps = np.diff(places)
    near = (grams[1:] == grams[:-1]) & (gaps <= window.max_period)
    runs = []
    for period in np.unique(gaps[near]).tolist():
        same = np.concatenate([[0], (data[:-period] == data[period:]).astype(np.int8), [0]])
        turns = np.flatnonzero(np.diff(same))
        for start, end in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if end - start >= window.length:
                runs.append((start, end + period, period))
    return runs


def scan(text: bytes, window: Window = Window()) -> tuple[dict[str, np.ndarray], list[tuple[int, int]]]:
    """Anchors of a whole text (place, gram hash, hash of the surroundings and of SIDES parts, bytes before and after) and the
    runs to remove. Long texts are scanned in overlapping chunks."""
    length, gram, reach, step = window.length, window.gram, window.reach, window.step
    whole, n = np.frombuffer(text, np.uint8), len(text)
    found: list[dict[str, np.ndarray]] = []
    removed: list[tuple[int, int]] = []
    for base in range(0, n - length + 1, CHUNK):
        low, high = max(0, base - reach), min(n, base + CHUNK + 2 * length)
        data = whole[low:high]
        hashes = _Hashes(data)
        first, last = base - low, min(n, base + CHUNK + length - 1) - low
        grams = hashes.all(gram)[first : last - gram + 1]
        places = _selected(grams, reach)
        values = grams[places]
        places = places + first
        keep = np.ones(len(places), bool)
        for start, end, period in _periodic(data, places, values, window):
            removed.append((start + low, end + low))
            keep &= ~((places > start + period + reach) & (places <= end - length))
        places, values = places[keep], values[keep]
        before = np.minimum(reach, places + low)
        after = np.minimum(length, n - low - places)
        size = np.uint64(1 << 20)
        sides = []
        for t in range(SIDES):
            fits = (before >= step * t) & (after >= length - step * (t + 1))
            start = np.where(fits, places - step * t, 0)
            shared = hashes.of(start, np.where(fits, length - step, 0))
            sides.append(np.where(fits, shared * np.uint64(2 * t + 1) ^ values, 0))
        found.append({
            "place": places + low, "gram": values, "before": before, "after": after,
            "around": hashes.of(places - before, before + after) + before.astype(np.uint64) * size + after.astype(np.uint64),
            **{f"side{t}": side for t, side in enumerate(sides)},
        })
    if not found:
        return {}, removed
    merged = {name: np.concatenate([f[name] for f in found]) for name in found[0]}
    _, once = np.unique(merged["place"], return_index=True)
    return {name: column[once] for name, column in merged.items()}, removed


_SIDE_NAMES = [f"side{t}" for t in range(SIDES)]
_ANCHOR = (
    "k1 bigint, k2 bigint, place int, gram bigint, around bigint, before int, after int, run int, "
    + ", ".join(f"{name} bigint" for name in _SIDE_NAMES)
)


def _anchors(texts: DataFrame, window: Window) -> DataFrame:
    """Anchors of all texts; rows with `run` hold a run to remove from `place` on instead."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["place", "gram", "around", "before", "after", *_SIDE_NAMES, "run"]
        for batch in batches:
            keys, columns = [], {name: [] for name in names}
            for k1, k2, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                if len(data) < window.length:
                    continue
                anchors, runs = scan(data, window)
                n = len(anchors.get("place", ()))
                for name in names[:-1]:
                    own = anchors[name] if n else np.empty(0, np.int64)
                    columns[name].append(np.concatenate([
                        own.view(np.int64) if own.dtype == np.uint64 else own.astype(np.int64),
                        np.array([s if name == "place" else 0 for s, _ in runs], np.int64),
                    ]))
                columns["run"].append(np.array([0] * n + [e - s for s, e in runs], np.int64))
                keys.append(np.tile([[k1], [k2]], n + len(runs)))
            if keys:
                k1, k2 = np.concatenate(keys, axis=1)
                data = {"k1": k1, "k2": k2} | {name: np.concatenate(column) for name, column in columns.items()}
                small = {"place", "before", "after", "run"}
                order = ["k1", "k2", "place", "gram", "around", "before", "after", "run", *_SIDE_NAMES]
                yield pa.RecordBatch.from_pydict({
                    name: pa.array(data[name].astype(np.int32) if name in small else data[name]) for name in order
                })

    return texts.select("k1", "k2", "text").mapInArrow(find, _ANCHOR)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def induced(before: list[bytes], after: list[bytes], wanted: list[bool], window: Window = Window()) -> list[tuple[int, int, int]]:
    """(member, first, last): starts `first` to `last` bytes before its anchor at which a wanted member repeats another.

    `after` are the suffixes at the anchor in sorted order, `before` the reversed bytes ahead of it.
    """
    n, length, reach = len(after), window.length, window.reach
    if n == 2:
        first, last = max(0, length - _shared(*after)), _shared(*before)
        return [(i, first, last) for i in range(2) if wanted[i]] if first <= last else []
    right = np.array([0, *map(_shared, after[:-1], after[1:])])
    order = np.array(sorted(range(n), key=before.__getitem__))
    sorted_before = [before[i] for i in order]
    left = np.array([0, *map(_shared, sorted_before[:-1], sorted_before[1:])])
    bounds = np.unique(np.concatenate([[0, reach + 1], left + 1, length - right]))
    bounds = bounds[(bounds >= 0) & (bounds <= reach + 1)]
    space, room = np.array([len(b) for b in before]), np.array([len(a) for a in after])
    # One row per run of starts that groups the members alike; some rows at a time.
    starts = bounds[:-1]
    again = np.zeros((len(starts), n), bool)
    step = max(1, 250_000 // n)
    for k in range(0, len(starts), step):
        first = starts[k : k + step, None]
        left_group = np.empty((len(first), n), np.int64)
        left_group[:, order] = np.cumsum(left < first, axis=1)
        group = left_group * (n + 1) + np.cumsum(right < length - first, axis=1)
        fits = (space >= first) & (room >= length - first)
        group = np.where(fits, group, -1 - np.arange(n))
        at = np.argsort(group, axis=1)
        group = np.take_along_axis(group, at, axis=1)
        same = np.zeros((len(first), n + 1), bool)
        same[:, 1:-1] = group[:, 1:] == group[:, :-1]
        np.put_along_axis(again[k : k + step], at, same[:, 1:] | same[:, :-1], axis=1)
    turns = np.diff((again & np.array(wanted)).astype(np.int8), axis=0, prepend=0, append=0).T
    member, begin = np.nonzero(turns == 1)
    _, end = np.nonzero(turns == -1)
    return list(zip(member.tolist(), starts[begin].tolist(), (bounds[end] - 1).tolist()))


def _class_repeats(members: DataFrame, window: Window) -> DataFrame:
    """(k1, k2, start, end) from the sorted suffixes of each class. Tasks read (class, after) in order."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def close() -> pa.RecordBatch | None:
            # Rows of equal id and text give one place several times.
            places = {r[4:]: r for r in reversed(rows)}
            if len(places) < len(rows):
                rows[:] = [r for r in rows if places[r[4:]] is r]
            if len(rows) < 2:
                return None
            found = induced([r[2][::-1] for r in rows], [r[1] for r in rows], [r[3] for r in rows], window)
            if not found:
                return None
            out = [(rows[m][4], rows[m][5], rows[m][6] - last, rows[m][6] - first + window.length) for m, first, last in found]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["k1", "k2", "start", "end"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and rows[0][0] != row[0]:
                    if (out := close()) is not None:
                        yield out
                    rows.clear()
                rows.append(row)
        if (out := close()) is not None:
            yield out

    ordered = members.repartition("class").sortWithinPartitions("class", "after_bytes")
    return ordered.select("class", "after_bytes", "before_bytes", "single", "k1", "k2", "place").mapInArrow(
        compare, "k1 bigint, k2 bigint, start bigint, end bigint"
    )


def _window_repeats(members: DataFrame, window: Window) -> tuple[list[DataFrame], DataFrame]:
    """Stored tables, and the same rows for classes too large for a task: all windows through the anchors, counted by their hash."""

    length = window.length

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for after, before, k1, k2, place in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(before + after, np.uint8)
                if len(data) < length:
                    continue
                found = _Hashes(data).all(length)[: len(before) + 1]
                start = place - len(before) + np.arange(len(found))
                yield pa.RecordBatch.from_pydict({
                    "window": found.view(np.int64), "k1": np.full(len(found), k1), "k2": np.full(len(found), k2), "start": start
                })

    rows = stored(
        members.select("after_bytes", "before_bytes", "k1", "k2", "place")
        .mapInArrow(windows, "window bigint, k1 bigint, k2 bigint, start bigint"), "windows",
    )
    where = F.xxhash64("k1", "k2", "start")
    several = stored(
        rows.groupBy("window").agg(F.min(where).alias("low"), F.max(where).alias("high")).filter("low <> high").select("window"),
        "repeated-windows",
    )
    return [rows, several], rows.join(several, "window").select("k1", "k2", "start", (F.col("start") + length).alias("end"))


def _bounded(df: DataFrame, column: str) -> DataFrame:
    """A stored table, marked for broadcast if the elements of its array column keep to the bound."""
    held = df.agg(F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if held <= BROADCAST_PLACES else df


def _cut(texts: DataFrame, wanted: DataFrame, window: Window) -> DataFrame:
    """Bytes about the wanted anchors: `wanted` is (k1, k2, owner, places) with each place's class and marks. Of equal texts that of
    the owner is read."""

    length, reach = window.length, window.reach

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                data, out = text.encode(), []
                for x in places:
                    p = x["place"]
                    out.append((x["class"], data[p : p + length], data[max(0, p - reach) : p], x["single"], x["large"], k1, k2, p))
                    if len(out) == 1000:
                        yield pack(out)
                        out = []
                if out:
                    yield pack(out)

    schema = pa.schema([
        ("class", pa.int64()), ("after_bytes", pa.binary()), ("before_bytes", pa.binary()), ("single", pa.bool_()),
        ("large", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int32()),
    ])

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names)

    joined = texts.join(wanted, ["k1", "k2"]).filter(F.col("doc_id").eqNullSafe(F.col("owner")))
    return joined.select("k1", "k2", "text", "places").mapInArrow(
        cut,
        "class bigint, after_bytes binary, before_bytes binary, single boolean, large boolean, k1 bigint, k2 bigint, place int",
    )


def repeated_spans(texts: DataFrame, window: Window = Window()) -> tuple[DataFrame, list[DataFrame]]:
    """(k1, k2, start, end): spans of bytes to remove, overlapping and in no order; and the stored tables to release once these are
    read. `texts` is (doc_id, k1, k2, text) with keys of the text. Equal texts share a key and count as one place here."""
    anchors = stored(_anchors(texts, window), "anchors")
    where = F.xxhash64("k1", "k2", "place")
    runs = stored(
        anchors.filter("run > 0").select("k1", "k2", F.col("place").alias("start"), (F.col("place") + F.col("run")).alias("end")), "runs"
    )
    usual = anchors.filter("run = 0").drop("run")
    several = stored(
        usual.groupBy("gram").agg(F.min(where).alias("low"), F.max(where).alias("high")).filter("low <> high").select("gram"),
        "repeated-grams",
    )
    repeated = stored(usual.join(several, "gram"), "repeated-anchors")
    release(anchors, several)
    # One place stands for all with the same surroundings; `single` tells that there is no other.
    contexts = stored(
        repeated.groupBy("gram", "around").agg(
            F.min(where).alias("low"), F.max(where).alias("high"),
            F.min(F.struct("k1", "k2", "place", *_SIDE_NAMES)).alias("at"),
        ).select("gram", "around", "at.*", (F.col("low") == F.col("high")).alias("single")),
        "contexts",
    )
    alike = contexts.filter("not single").select("gram", "around")
    full = stored(
        repeated.filter(F.col("before") + F.col("after") >= window.length).join(alike, ["gram", "around"]).select(
            "k1", "k2", (F.col("place") - F.col("before")).alias("start"), (F.col("place") + F.col("after")).alias("end")
        ),
        "full-repeats",
    )
    release(repeated)
    sided = contexts.select(
        "k1", "k2", "place", "single", F.explode(F.array(*_SIDE_NAMES)).alias("class")
    ).filter("class <> 0")
    # Classes with the same members, as the parts of one passage have, are compared once.
    classes = stored(
        sided.groupBy("class").agg(F.count("*").alias("n"), F.max("single").alias("open"), F.bit_xor(where).alias("members"))
        .filter("n > 1 and open").groupBy("members", "n").agg(F.min("class").alias("class"))
        .select("class", (F.col("n") > CLASS_MEMBERS).alias("large")),
        "suffix-classes",
    )
    owners = texts.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner"))
    wanted = stored(
        sided.join(classes, "class").groupBy("k1", "k2").agg(
            F.collect_list(F.struct("class", "place", "single", "large")).alias("places")  # bounded by the length of the text
        ).join(owners, ["k1", "k2"]),
        "wanted-places",
    )
    release(contexts)
    members, held = _cut(texts, wanted, window), [runs, full, wanted, classes]
    if classes.filter("large").isEmpty():
        found = _class_repeats(members, window)
    else:
        members = stored(members, "suffixes")
        windows, repeats = _window_repeats(members.filter("large"), window)
        found = _class_repeats(members.filter("not large"), window).unionByName(repeats)
        held += [members, *windows]
    parts = [df.select("k1", "k2", F.col("start").cast("bigint"), F.col("end").cast("bigint")) for df in (runs, full, found)]
    return parts[0].union(parts[1]).union(parts[2]), held


_SPAN_TYPE = "array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans: DataFrame) -> DataFrame:
    """Sorted spans of each text merged to maximal runs."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(2).to_pylist():
                runs: list[dict] = []
                for x in own:
                    if runs and x["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], x["end"])
                    else:
                        runs.append(x)
                out.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _SPANS)], ["k1", "k2", "spans"])

    return spans.mapInArrow(merge, f"k1 bigint, k2 bigint, spans {_SPAN_TYPE}")


def _text_spans(docs: DataFrame, text_col: str, window: Window) -> DataFrame:
    """(row, text, spans): each row of `docs` as one column, its text (null as empty) and the merged spans to remove from it, null
    where there are none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Two hashes of 64 bits that do not follow from each other.
    keys = F.xxhash64(text).alias("k1"), F.xxhash64(F.md5(text)).alias("k2")
    rows = docs.select(F.struct("*").alias("row"), text.alias("text"), *keys)
    copies = (
        rows.filter(F.octet_length("text") >= window.length).groupBy("k1", "k2")
        .agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes")).filter("n > 1")
        .select("k1", "k2", F.lit(0).cast("bigint").alias("start"), F.col("bytes").cast("bigint").alias("end"))
    )
    found, held = repeated_spans(rows.select(F.col("row.doc_id").alias("doc_id"), "k1", "k2", "text"), window)
    spans = stored(_merged(
        found.union(copies).distinct().groupBy("k1", "k2")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))  # bounded by the length of the text
    ), "spans")
    release(*held)
    return rows.join(_bounded(spans, "spans"), ["k1", "k2"], "left").select("row", "text", "spans")


def _without(text: str, spans: list | None, words: int = 0) -> bytes:
    """The bytes outside all spans that hold at least so many words."""
    data, at, parts = text.encode(), 0, []
    for run in spans if spans is not None else ():
        if words and len(data[run["start"] : run["end"]].split()) < words:
            continue
        parts.append(data[at : run["start"]])
        at = run["end"]
    return b"".join(parts) + data[at:]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: Window = Window()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: the maximal runs of bytes to remove and the bytes that are left.

    Null texts are empty. Texts shorter than the window keep everything. Copies of a text remove each other as a whole, rows that share
    an id included. `kept` is binary: a cut can split a character. An empty table gives no rows; extra columns are left behind.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("binary")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(t, s) for t, s in zip(texts, spans)], dtype="object")

    rows = _text_spans(id_and_text(docs, id_col, text_col), "text", window)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.coalesce("spans", F.array().cast(_SPAN_TYPE)).alias("spans"), kept("text", "spans").alias("kept"),
    )


def with_kept_text(
    docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", window: Window = Window(), words: int = 0
) -> DataFrame:
    """`docs` with its repeated runs of at least so many words removed from the text, and the new number of characters.

    Needs the column doc_id. A run is a maximal range of bytes that strings of the window's length cover which start elsewhere too; its
    words are what white space parts, those cut at its ends included. Halves of characters at a cut are dropped. A null text stays null
    with no characters, copies of a text lose it whole, an empty table gives no rows, and extra columns of any name are passed on.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _without(t, s, words).decode("utf-8", "ignore") for t, s in zip(texts, spans)], dtype="object")

    found = _text_spans(docs, text_col, window)
    own = F.col("row").getField(text_col)
    cut = found.select("row", F.when(F.col("spans").isNull(), own).otherwise(kept("text", "spans")).alias("cut"))
    length = F.coalesce(F.char_length("cut"), F.lit(0)).cast("bigint")
    new = {text_col: F.col("cut"), chars_col: length}
    return cut.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
