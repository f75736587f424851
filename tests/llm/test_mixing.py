import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from feedloom.llm import mixing
from feedloom.llm.common import partitions_for
from feedloom.llm.mixing import Schedule
from feedloom.llm.running import running

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reshared(sizes, weights, ceiling):
    """Targets by the rounds of the contract: share, stop, share the excess again."""
    total, left, target = sum(sizes), set(range(len(sizes))), {}
    while True:
        rest = total - sum(ceiling * sizes[k] for k in target)
        level = Fraction(rest, sum(weights[k] for k in left)) if left else 0
        above = {k for k in left if weights[k] * level > ceiling * sizes[k]}
        if not above:
            return [Fraction(ceiling * sizes[k]) if k in target else weights[k] * level for k in range(len(sizes))]
        for k in above:
            target[k] = True
        left -= above


def sources(rows):
    return sorted({r[1] for r in rows}, key=lambda s: (s is None, (s or "").encode()))


@pytest.fixture
def mix_docs(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)


def some_rows(counts):
    rows, i = [], 0
    for name, count in counts.items():
        for _ in range(count):
            i += 1
            rows.append((i * 7919 % 10007, name, "w " * (i * i % 23)))
    return rows


CASES = [
    {"b": 50, "a": 3, None: 4, "c": 40}, {"a": 200}, {"a": 1, "B": 300, "é": 10, "z": 2, "\U0001f600": 5, "y": 80},
    {f"s{k}": 1 + k * k % 40 for k in range(30)},
]


@pytest.mark.parametrize("counts", CASES)
def test_targets_and_words(mix_docs, counts):
    rows = some_rows(counts)
    documents, stream = mixing.curriculum(mix_docs(rows), (5, 2, 1), (Schedule(), Schedule(((0, 0), (1, 2)))), 3)
    got = mixing.taken_words(documents, stream).collect()
    names = sources(rows)
    held = [sum(len(WORD.findall(t)) for _, s, t in rows if s == name) for name in names]
    wanted = dict(zip(names, reshared(held, [(5, 2, 1)[k % 3] for k in range(len(names))], 3)))
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len(WORD.findall(t))) for i, _, t in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(float(wanted[r["source"]]))
        assert r["source_size"] == held[names.index(r["source"])] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == int(wanted[s]) for s in names)


def test_order_and_times(mix_docs):
    """Pieces stand where the integral of the schedule says, one after another, without gaps."""
    rows = some_rows({"a": 60, "b": 30, "c": 20})
    plans = (Schedule(((0, 2), (0.25, 0), (0.75, 0), (1, 1))), Schedule(((0, 0.5), (1, 1.5))), Schedule())
    documents, stream = mixing.curriculum(mix_docs(rows), (5, 2, 1), plans)
    docs, pieces = {r["row"]: r for r in documents.collect()}, stream.orderBy("piece").collect()
    assert [p["piece"] for p in pieces] == list(range(len(pieces)))
    assert [p["time"] for p in pieces] == sorted(p["time"] for p in pieces)
    ends = [p["start"] + p["words"] for p in pieces]
    assert [p["start"] for p in pieces] == [0, *ends[:-1]]
    for source, plan in zip("abc", plans):
        own = sorted((p for p in pieces if p["source"] == source), key=lambda p: p["time"])
        drawn = sorted(
            (r for r in docs.values() if r["source"] == source),
            key=lambda r: int(hashlib.sha256(f"11:{r['doc_id']}".encode()).hexdigest()[:15], 16),
        )
        ring = [r["row"] for r in drawn if r["size"]] * 3
        assert [p["row"] for p in own] == ring[: len(own)]
        given, total = 0, sum(p["words"] for p in own)
        for p in own:
            assert integral(plan, p["time"]) == pytest.approx(given / total, abs=1e-9)
            given += p["words"]


def integral(plan, time):
    """Share of the whole area up to a time, summed in small steps of exact trapezoids."""
    area = lambda end: sum(
        (min(u, end) - t) * (w + w + (v - w) * (min(u, end) - t) / (u - t)) / 2
        for (t, w), (u, v) in zip(plan.knots, plan.knots[1:]) if end > t
    )
    return area(time) / area(1)


def test_reruns_agree_on_other_partitions(mix_docs, spark):
    rows = some_rows({"a": 90, "b": 9})
    once = mixing.curriculum(mix_docs(rows))[1]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 7)
        again = mixing.curriculum(mix_docs(rows[::-1]).repartition(5))[1]
        columns = ["doc_id", "copy", "words", "time", "start", "piece"]
        assert sorted(once.select(columns).collect()) == sorted(again.select(columns).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_one_large_document(mix_docs):
    """A source with a single document is cut to its target, not left far from it."""
    documents, stream = mixing.curriculum(mix_docs([(1, "a", "w " * 1000), (2, "b", "v " * 10)]), (1, 5))
    rows = {r["doc_id"]: r for r in mixing.taken_words(documents, stream).collect()}
    assert rows[2]["taken"] == 30 and rows[1]["taken"] == 980


def test_running_sums(spark):
    """Every value of `within` starts anew, however many tasks it is spread over."""
    rows = [(k, k * 31 % 97 % 3, k % 5) for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, g int, x bigint")
    got = running(df, "test", [F.col("g"), F.col("k")], {"ahead": F.col("x")}, F.col("g")).collect()
    seen, sums = sorted(rows, key=lambda r: (r[1], r[0])), defaultdict(int)
    by_key = {r["k"]: r for r in got}
    assert len(got) == 1000 and partitions_for(spark) > 1
    for rank, (k, g, x) in enumerate(seen):
        assert (by_key[k]["row_rank"], by_key[k]["ahead"]) == (rank, sums[g])
        sums[g] += x


@pytest.mark.parametrize("knots", [((0, 1),), ((0, 1), (0.5, 1)), ((0, 1), (1, -1)), ((0, 0), (1, 0)), ((0, 1), (0, 2), (1, 1))])
def test_bad_schedules(knots):
    with pytest.raises(ValueError):
        Schedule(knots)


def test_odd_rows(odd_docs, no_docs):
    odd = odd_docs.withColumn("source", F.when(F.col("doc_id") > 4, F.lit("s"))).withColumns(
        {c: F.lit("x") for c in ("running_task", "running_in", "row_rank", "size", "target", "ahead", "row", "draw", "named")}
    )
    documents, stream = mixing.curriculum(odd)
    rows = mixing.taken_words(documents, stream).collect()
    assert len(rows) == odd_docs.count()
    for name in (None, "s"):
        own = [r for r in rows if r["source"] == name]
        assert sum(r["taken"] for r in own) == int(own[0]["target"]) and all(r["taken"] <= 3 * r["size"] for r in own)
    documents, stream = mixing.curriculum(no_docs.withColumn("source", F.lit("s")))
    assert mixing.taken_words(documents, stream).collect() == [] and stream.collect() == []
    documents, stream = mixing.curriculum(odd.withColumn("text", F.lit(None).cast("string")))
    assert {(r["target"], r["taken"]) for r in mixing.taken_words(documents, stream).collect()} == {(0.0, 0)}
