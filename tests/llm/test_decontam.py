import random
import re

import pytest

from feedloom.llm import decontam

BREAK = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    table = {c: c + 32 for c in range(65, 91)}
    return [w for w in BREAK.split((text or "").translate(table)) if w]


def brute(rows, items, window=13):
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            k = min(window, len(v))
            for a in range(len(v) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[a : a + k]:
                        hit.update(range(p, p + k))
                        found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,broadcast", [(1, True), (2, False)])
def test_against_brute_force(spark, docs, monkeypatch, seed, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", -1)
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "x-y"]
    line = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = [(k, line(draw.choice([1, 2, 4, 8, 13, 14, 30]))) for k in range(10)] + [(10, None), (11, ""), (12, line(20)), (12, line(3))]
    items.append((13, items[8][1]))
    rows = [(k, ", ".join([line(draw.randint(0, 20)), draw.choice(items)[1] or "", line(5)]).upper()) for k in range(30)]
    rows += [(30, None), (31, ""), (None, items[3][1]), (3, items[4][1]), (3, items[4][1])]
    found = decontam.contamination(docs(*rows), spark.createDataFrame(items, "item_id bigint, text string"))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=repr)
    assert got == brute(rows, items)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "a b c d e f g"), (None, "tie"), (2, "one")], "item_id bigint, text string")
    by = {r["doc_id"]: r for r in decontam.contamination(odd_docs, items).collect()}
    assert by[5]["n_hit"] == 7 and by[6]["items"] == ["1"] and by[3]["items"] == ["2"] and by[9]["n_hit"] == 0
    assert decontam.contamination(odd_docs, items).count() == 13
    assert decontam.contamination(no_docs, items).count() == 0
    assert all(r["n_hit"] == 0 for r in decontam.contamination(odd_docs, items.filter("false")).collect())
