import random

import pytest
from pyspark.sql import functions as F

from feedloom.llm import suffixdedup as sd


def brute(rows, length=sd.LENGTH):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        out.append((i, len(b), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def result(df, length=sd.LENGTH):
    rows = sd.remove_repeats(df, window=sd.Window(length)).select("doc_id", "n_bytes", F.size("spans").alias("n"), "kept").collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n"], bytes(r["kept"])) for r in rows), key=repr)


def passages(seed, n=60):
    draw = random.Random(seed)
    letters = "abcdefgh é"
    base = ["".join(draw.choices(letters, k=1500)) for _ in range(5)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(draw.randint(0, 4)):
            kind = draw.random()
            if kind < 0.5:
                at = draw.randint(0, 1000)
                parts.append(draw.choice(base)[at : at + draw.choice([330, 380, 399, 400, 401, 410, 450, 500])])
            elif kind < 0.7:
                parts.append(draw.choice(["ab", "x", "abc " * 7, "Su ", base[0][:190]]) * draw.choice([1, 20, 150, 300, 500]))
            else:
                parts.append("".join(draw.choices(letters, k=draw.randint(0, 600))))
        rows.append((k, "".join(parts)))
    return rows + [(None, rows[3][1]), (5, None), (6, ""), (7, rows[8][1]), (7, rows[8][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    rows = passages(seed)
    assert result(docs(*rows)) == brute(rows)


@pytest.mark.parametrize("length", [40, 200, 333])
def test_other_lengths(docs, length):
    rows = passages(length)
    assert result(docs(*rows), length) == brute(rows, length)


def test_large_classes_and_shuffled_joins(docs, monkeypatch):
    monkeypatch.setattr(sd, "CLASS_MEMBERS", 1)
    monkeypatch.setattr(sd, "BROADCAST_PLACES", -1)
    rows = passages(3)
    assert result(docs(*rows)) == brute(rows)


def test_long_texts_are_scanned_in_chunks(docs, monkeypatch):
    rows = passages(4, 20)
    rows.append((99, "".join(t for _, t in rows if t)))
    whole = result(docs(*rows))
    assert whole == brute(rows)
    data = rows[-1][1].encode()
    monkeypatch.setattr(sd, "CHUNK", 1000)
    pieces, runs = sd.scan(data)
    monkeypatch.setattr(sd, "CHUNK", 1 << 20)
    all_at_once, long_runs = sd.scan(data)
    # Runs are found inside a chunk, so a chunk may keep anchors that the whole drops; it never loses one.
    assert set(all_at_once["place"].tolist()) <= set(pieces["place"].tolist())
    assert all(any(a <= s and e <= b for a, b in long_runs) for s, e in runs)


def test_kept_text(docs, odd_docs):
    repeated = "é" * 3 + "".join(chr(97 + k * k % 26) for k in range(500))
    got = {r["doc_id"]: r for r in sd.with_kept_text(docs((1, "x" + repeated), (2, repeated + "y"), (3, None)).withColumn("n_chars", F.lit(0))).collect()}
    assert got[1]["text"] == "x" and got[2]["text"] == "y" and got[3]["text"] is None and got[1]["n_chars"] == 1
    assert sd.with_kept_text(odd_docs.withColumn("n_chars", F.lit(1))).columns == [*odd_docs.columns, "n_chars"]


def test_kept_text_by_words(docs):
    """Of a repeated run of bytes, only one with enough words goes; extra columns of any name are passed on."""
    few, many = " ".join("w" * 20 + str(k) for k in range(20)), " ".join(f"v{k}" for k in range(100, 170))
    rows = docs((1, f"one {few} and {many} end"), (2, f"two {many} mid {few}"), (3, None))
    named = rows.withColumns({c: F.lit("x") for c in ("row", "spans", "k1", "k2", "_k1", "_spans", "cut", "a.b")}).withColumn("n_chars", F.lit(0))
    found = sd.with_kept_text(named, window=sd.Window(200), words=50)
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.columns == named.columns and got[1]["a.b"] == "x" and got[3]["text"] is None and got[3]["n_chars"] == 0
    assert got[1]["text"] == f"one {few} andend" and got[2]["text"] == f"twomid {few}" and got[1]["n_chars"] == len(got[1]["text"])


def test_odd_rows(odd_docs, no_docs):
    rows = sd.remove_repeats(odd_docs).collect()
    assert len(rows) == 13
    long = next(r for r in rows if r["doc_id"] == 4)
    assert len(long["kept"]) == 0 and len(long["spans"]) == 1
    assert sd.remove_repeats(no_docs).count() == 0
