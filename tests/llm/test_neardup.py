import random

import pytest

from feedloom.llm import neardup
from feedloom.llm.components import components


def words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(words(t))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= 75 * len(x | y) and x & y for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def family(draw, size, rate, length=120):
    base = [f"w{draw.randrange(5000)}" for _ in range(length)]
    return [" ".join(w if draw.random() > rate else f"e{draw.randrange(10**6)}" for w in base) for _ in range(size)]


@pytest.mark.parametrize("seed,rate", [(1, 0.01), (2, 0.03), (3, 0.05)])
def test_components_of_families(docs, seed, rate):
    draw = random.Random(seed)
    texts = family(draw, 40, rate) + family(draw, 15, rate / 2) + ["", "one two", "ONE two", "one two three"]
    rows = list(enumerate(texts)) + [(100, texts[0]), (7, texts[50])]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(*rows)).collect()}
    assert got == brute(rows)


def test_prefix_pairs_lose_nothing(spark):
    draw = random.Random(4)
    texts = family(draw, 60, 0.02)
    sets = [words(t) for t in texts]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "node bigint, node_group bigint, text string")
    got = {(r["a"], r["b"]) for r in neardup.prefix_pairs(df).collect()}
    want = {(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert {(b, a) for a, b in want} <= got


@pytest.mark.parametrize("links", [
    [], [(1, 2)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 40)], [(5, 1), (1, 5), (3, 3), (9, 7), (7, 2)],
])
def test_components(spark, links):
    up = {x: x for pair in links if pair[0] != pair[1] for x in pair}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in up}


def test_odd_rows(odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == 13
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[1]["kept"] and by[1]["n_shingles"] == 0
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert neardup.near_duplicates(no_docs).count() == 0
