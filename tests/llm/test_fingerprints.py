import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.llm import fingerprints as fp


def prints(docs):
    rows = docs.select("doc_id", "text", fp.fingerprint(F.col("text")).alias("p")).select(
        "doc_id", "p", fp.as_hex(F.col("p")).alias("hex")
    )
    return {r["doc_id"]: r for r in rows.collect()}


def test_order_does_not_matter_and_content_does(docs):
    found = prints(docs((1, "a x\nb y\nc"), (2, "c\na x\nb y"), (3, "a x\nb y\nd"), (4, "a x\na x\nb y\nc"), (5, "")))
    assert found[1]["hex"] == found[2]["hex"]
    assert len({found[i]["hex"] for i in (1, 3, 4, 5)}) == 4


def test_insert_and_delete(docs):
    both = docs((1, "a b. c\nd, e"), (2, "a b. c"), (3, "d, e")).select("doc_id", fp.fingerprint(F.col("text")).alias("p"))
    a, b, c = (both.filter(F.col("doc_id") == i).select(F.col("p").alias(f"p{i}")) for i in (1, 2, 3))
    row = a.crossJoin(b).crossJoin(c).select(
        (fp.combine(F.col("p2"), F.col("p3")) == F.col("p1")).alias("inserted"),
        (fp.combine(F.col("p1"), F.col("p3"), -1) == F.col("p2")).alias("deleted"),
    ).first()
    assert row["inserted"] and row["deleted"]


@pytest.mark.parametrize("count", [1, 3, 70_000])
def test_many_fragments(docs, count):
    row = docs((1, "word." * count)).select(fp.sign_lanes(F.col("text")).alias("s")).first()
    residue = (count + 2**15) % 2**16 - 2**15
    assert {abs(x) for x in row["s"]} == {abs(residue)}


def test_edits_follow_the_next_id(docs, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_DOCUMENTS", 2)
    texts = {k * 7: "".join(chr(97 + (k + j) % 26) for j in range(k % 9)) for k in range(40)}
    got = {r["doc_id"]: r["edited"] for r in fp.with_edits(docs(*texts.items())).collect()}
    ids = sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        quarter = len(texts[i]) // 4
        assert got[i] == texts[i][: len(texts[i]) - quarter] + texts[j][:quarter]


def test_ranges_follow_the_rows_not_the_ids(spark):
    """One far id does not put all others into one range."""
    ids = [*range(3000), 2**60, *([7] * 50)]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id bigint")
    bounds = fp._bounds(df, 20)
    rows = df.select("doc_id", fp._range_of(F.col("doc_id"), bounds).alias("r")).collect()
    assert all(r["r"] == (None if r["doc_id"] is None else sum(b <= r["doc_id"] for b in bounds)) for r in rows)
    held = Counter(r["r"] for r in rows)
    assert len(bounds) == 19 and max(held.values()) < 400
    assert fp._bounds(df.filter("false"), 20) == [] and fp._bounds(df, 1) == []


def test_lanes_do_not_hang_on_one_value(docs):
    """Every lane hashes the whole digest under its own seed: no lane follows from another one."""
    row = docs((1, "some paragraph")).select(fp.wide_lanes(F.col("text")).alias("w"), *(
        F.xxhash64(F.lit(i), F.sha2("text", 256)).bitwiseAND(2**32 - 1).alias(f"l{i}") for i in range(1, fp.WIDE + 1)
    )).first()
    assert row["w"] == [row[f"l{i}"] for i in range(1, fp.WIDE + 1)] and len(set(row["w"])) == fp.WIDE
    # What the lanes were before: functions of one 64-bit value.
    joined = docs((1, "x")).select((F.xxhash64("text", F.lit(3)) == F.xxhash64(F.lit(3), "text")).alias("same")).first()
    assert not joined["same"]


def test_likeness(docs):
    base = [f"sentence number {k} of the text" for k in range(200)]
    near, far = base[:150] + [f"other {k}" for k in range(50)], [f"far away {k}" for k in range(200)]
    rows = docs((1, ". ".join(base)), (2, ". ".join(near)), (3, ". ".join(far)))
    p = rows.select("doc_id", fp.fingerprint(F.col("text")).alias("p"))
    pairs = p.alias("a").join(p.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id")).select(
        F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), fp.likeness(F.col("a.p"), F.col("b.p")).alias("l")
    )
    got = {(r["x"], r["y"]): r["l"] for r in pairs.collect()}
    assert got[1, 1] == 1.0 and got[1, 2] > 0.5 and got[1, 3] < 0.4


def test_odd_rows(odd_docs, no_docs):
    rows = fp.with_edits(odd_docs).select("*", F.sha2("edited", 256).alias("sha")).collect()
    assert len(rows) == 13
    alone = [r for r in rows if r["doc_id"] is None and r["text"]]
    assert alone[0]["edited"] == "no i" and alone[0]["next_print"] is None
    last = [r for r in rows if r["doc_id"] == 2]
    assert last[0]["sha"] == hashlib.sha256(b"").hexdigest()
    assert fp.with_edits(no_docs).count() == 0
