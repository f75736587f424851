"""Mixing sources to target weights by a time-varying curriculum.

1. Targets. All words are shared among the sources by weight; a target stops at a multiple of what its source holds, and what is
   left over is shared again. The level at which this ends is found from running sums over the sources, sorted by the level at
   which each of them would stop.
2. Demand. Each source has a schedule: its weight over training time, from 0 to 1, linear between knots. The integral, scaled to the
   target, is the number of words that the source has given by a time. A document begins after all words ahead of it in its source's
   own order (drawn by the id); the time at which the integral reaches that number is its place in training.
3. Stream. All pieces are range-sorted by time; running sums give the first word of each piece in the whole stream.

DataFrame functions only. Running sums are taken in two levels (`running`), so that a source with any share of the rows is spread.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import stored
from feedloom.llm.running import running

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Schedule:
    """Weight of a source over training time: (time, weight) knots from time 0 to time 1, linear between them."""

    knots: tuple[tuple[float, float], ...] = ((0.0, 1.0), (1.0, 1.0))

    def __post_init__(self):
        times = [t for t, _ in self.knots]
        if len(times) < 2 or times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:])):
            raise ValueError("knots must rise from time 0 to time 1")
        if any(w < 0 for _, w in self.knots) or not any(w > 0 for _, w in self.knots):
            raise ValueError("weights must not be negative, nor all zero")

    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """(time, weight, slope, share given before, share given after) of the spans with any weight; the whole integral is 1."""
        spans = [(t, w, u, v, (u - t) * (w + v) / 2) for (t, w), (u, v) in zip(self.knots, self.knots[1:])]
        total = math.fsum(area for *_, area in spans)
        out, before = [], 0.0
        for t, w, u, v, area in spans:
            after = before + area / total
            if area > 0:
                out.append((t, w / total, (v - w) / (u - t) / total, before, after))
            before = after
        return out

    def time_of(self, share: Column) -> Column:
        """The time at which the integral reaches a share (0 to 1) of the whole: in each span the root of a quadratic."""
        when = None
        pieces = self.pieces()
        for k, (time, weight, slope, before, after) in enumerate(pieces):
            more = F.greatest(share - F.lit(before), F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2 * slope) * more, F.lit(0.0)))
            here = F.when(more == 0, F.lit(time)).otherwise(F.lit(time) + 2 * more / (F.lit(weight) + root))
            if k == len(pieces) - 1:
                return here if when is None else when.otherwise(here)
            inside = share <= F.lit(after)
            when = F.when(inside, here) if when is None else when.when(inside, here)


def draw(key: Column, seed: int) -> Column:
    """A number below 2^60 that depends on the seed and the key alone; a null key draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], ceiling: int) -> DataFrame:
    """(source, source_rank, source_size, target, target_words) from (source, size): the words each source should give.

    Sources by code point, null last, take the weights in turn. Whole numbers decide which sources stop at `ceiling` times their
    size, so no rounding can tip them.
    """
    sources = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    ranked = running(sources, "mix-ranks", [F.col("source").asc_nulls_last()], {}).withColumnRenamed("row_rank", "source_rank")
    turn = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), (F.col("source_rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumns({"weight": turn, "cap": F.col("source_size") * ceiling})
    # A source stops where the level per unit of weight passes cap / weight, here in whole numbers.
    stop = F.col("cap") * F.lit(math.lcm(*weights)).cast("bigint") / F.col("weight")
    levels = stored(running(
        capped.withColumn("stop", stop.cast("decimal(38,0)")), "mix-levels", [F.col("stop"), F.col("source_rank")],
        {"caps_before": F.col("cap"), "weights_before": F.col("weight")},
    ), "mix-levels")
    sums = levels.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    wide = lambda c: c.cast("decimal(19,0)")
    rest, weight_left = F.lit(sums["size"] or 0) - F.col("caps_before"), F.lit(sums["weight"] or 0) - F.col("weights_before")
    open_ = levels.filter(wide(F.col("cap")) * wide(weight_left) >= wide(rest) * wide(F.col("weight")))
    level = open_.select("row_rank", rest.alias("rest"), weight_left.alias("weight_left")).orderBy("row_rank").first()
    words, shares = (level["rest"], level["weight_left"]) if level else (0, 1)
    asked = F.col("weight") * F.lit(words).cast("bigint")
    return levels.select(
        "source", "source_rank", "source_size",
        F.least(F.col("cap").cast("double"), asked.cast("double") / F.lit(float(shares))).alias("target"),
        F.least("cap", F.expr(f"(weight * {words}L) div {shares}L")).alias("target_words"),
    )


def curriculum(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), schedules: tuple[Schedule, ...] = (Schedule(),), ceiling: int = 3,
    seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(documents, stream).

    documents: (row, doc_id, source, size, source_size, target), one row per row of `docs`; `row` numbers them.
    stream: (row, doc_id, source, copy, words, time, start, piece), one row per document and copy that the mix takes, sorted by time:
    `words` of the document's first words, which stand from word `start` on. Only the last copy of one document per source is cut
    short, so a source gives its target to the word; a document is never given more than `ceiling` times.

    Sources take weights and schedules in turn, by code point, null last. A null text has no words. Documents without words are
    listed but not in the stream. Rows that share an id are ordered by their texts; repeated rows are separate documents. An empty
    table gives empty results. Extra columns are left behind.
    """
    if not weights or any(w <= 0 for w in weights) or ceiling < 1:
        raise ValueError("weights must be above 0 and the ceiling at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), draw(F.col(id_col), seed).alias("draw"),
        F.xxhash64(text).alias("text_hash"),
    ), "mix-sizes")
    targets = stored(source_targets(sized.select("source", "size"), weights, ceiling), "mix-targets")
    named = targets.withColumnRenamed("source", "named")
    # One row per source; Spark broadcasts it if it is small, and else splits a hot source.
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    order = [F.col(c) for c in ("source_rank", "draw")] + [F.col("doc_id").asc_nulls_first(), F.col("text_hash"), F.col("size")]
    placed = stored(
        running(rows, "mix-order", order, {"ahead": F.col("size")}, F.col("source_rank")).withColumnRenamed("row_rank", "row"), "mix-rows"
    )
    full = F.expr("target_words div source_size")
    last = F.greatest(F.lit(0), F.least("size", F.col("target_words") - full * F.col("source_size") - F.col("ahead")))
    copies = F.transform(
        F.sequence(F.lit(0).cast("bigint"), full),
        lambda c: F.struct(c.alias("copy"), F.when(c < full, F.col("size")).otherwise(last).cast("bigint").alias("words")),
    )
    pieces = (
        placed.filter("size > 0").select("*", F.inline(copies)).filter("words > 0")
        .withColumn("share", (F.col("copy") * F.col("source_size") + F.col("ahead")) / F.col("target_words"))
    )
    turn = F.col("source_rank") % len(schedules)
    time = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        time = F.when(turn == k, schedule.time_of(F.col("share"))).otherwise(time)
    timed = pieces.select("row", "doc_id", "source", "copy", "words", time.alias("time"))
    stream = running(timed, "mix-stream", [F.col("time"), F.col("row"), F.col("copy")], {"start": F.col("words")})
    return (
        placed.select("row", "doc_id", "source", "size", "source_size", "target"),
        stored(stream.withColumnRenamed("row_rank", "piece"), "mix-stream"),
    )


def taken_words(documents: DataFrame, stream: DataFrame) -> DataFrame:
    """`documents` with `taken`, the words that the stream takes of each, repeats counted."""
    taken = stream.groupBy("row").agg(F.sum("words").alias("taken"))
    return documents.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
