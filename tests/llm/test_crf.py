import itertools

import numpy as np
import pytest

from feedloom.llm import crf


@pytest.mark.parametrize("lines", [1, 2, 5])
def test_marginals_against_enumeration(lines):
    draw = np.random.default_rng(lines)
    odds, moves = draw.normal(size=(2, lines)), draw.normal(size=(2, 2))
    good, pairs = crf.marginals(odds, moves)
    for c in range(2):
        weight = {
            labels: np.exp(sum(odds[c, t] * labels[t] for t in range(lines)) + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
            for labels in itertools.product((0, 1), repeat=lines)
        }
        total = sum(weight.values())
        for t in range(lines):
            assert good[c, t] == pytest.approx(sum(w for y, w in weight.items() if y[t]) / total)
        for a, b in itertools.product((0, 1), repeat=2):
            want = sum(w * sum((x, y) == (a, b) for x, y in zip(l, l[1:])) for l, w in weight.items()) / total
            assert pairs[c, a, b] == pytest.approx(want)


def corpus(n=120):
    for k in range(n):
        good = f"The house number {k} stands by the river, and people like it.\nIt was built in the year {1900 + k}.\nAll is well."
        yield k, good if k % 3 else ("buy now " * (20 + k % 7) + "\n" + "CHEAP!! FAST!! " * 10), int(bool(k % 3))


def test_learns_and_holds_out(spark, docs):
    rows = list(corpus())
    df = docs(*[(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in crf.scores(df, crf.train(df, labels)).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    learnt = {r["doc_id"] for r in crf.training_ids(labels).collect()}
    import zlib

    assert learnt == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert crf.training_ids(labels, limit=5).count() == 5


def test_without_labels_or_with_one_class(spark, docs):
    df = docs((1, "a"), (2, "b"), (3, "c"))
    for labels in ([], [(2, 1), (3, 1)], [(2, None), (None, 1)]):
        model = crf.train(df, spark.createDataFrame(labels, "doc_id bigint, quality int"))
        assert all(0 <= r["score"] <= 1 for r in crf.scores(df, model).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1), (5, 1), (5, 0)], "doc_id bigint, quality int")
    model = crf.train(odd_docs, labels)
    rows = crf.scores(odd_docs, model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(empty) == 1
    assert crf.scores(no_docs, model).count() == 0
    assert crf.with_score(odd_docs, model).columns[: len(odd_docs.columns)] == odd_docs.columns
