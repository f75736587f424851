import hashlib
import re

import pytest
from pyspark.sql import functions as F

from feedloom.llm import infill
from feedloom.llm.queries import QUERIES

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plainly(doc_id, text, seed=7, percent=100, spm=50):
    """(n, form, prefix_chars, middle_chars, output) by slicing a list of lines."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = UNIT.findall(text)
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(lines), "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    "a\nb\nc\n", "one line", "\n", "\n\n\n", "é漢\U0001f600\nx\r\n y\n", "with <S> inside\nand more", "<P", "S>\n<\nM>\n<<", "$1 \\ $3\n\\n$\n",
    "tab\tand nul\x00\nmore\x85text\x0b\n", None, "", "x\n" * 300 + "end",
]


def test_equals_slicing_of_lines(docs):
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(260)]
    for percent, spm in ((100, 50), (40, 0), (100, 100)):
        found = infill.fill_in_middle(docs(*rows), percent=percent, spm_percent=spm)
        got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
        assert got == {k: plainly(k, t, percent=percent, spm=spm) for k, t in rows}
        back = found.select("doc_id", infill.restore(F.col("output"), F.col("form")).alias("text")).collect()
        assert {r["doc_id"]: r["text"] for r in back} == {k: t or "" for k, t in rows}


def test_very_long_texts(docs):
    """A million lines, and one line of eight million characters, in one match."""
    rows = [(k, t) for k in range(4) for t in ("ab\n" * 1_000_000, "x" * 8_000_000)]
    found = infill.fill_in_middle(docs(*rows)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.md5("output").alias("o")
    )
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted((k, *plainly(k, t)[:4], hashlib.md5(plainly(k, t)[4].encode()).hexdigest()) for k, t in rows)


def test_other_units_and_markers(docs):
    marks = infill.Markers("[pre]", "\\$suf", "#mid")
    found = infill.fill_in_middle(docs((1, "one two three four"), (2, "a b #mid c")), unit=r"(?:[^ ]* |[^ ]+)", markers=marks)
    rows = {r["doc_id"]: r for r in found.withColumn("back", infill.restore(F.col("output"), F.col("form"), marks)).collect()}
    assert rows[1]["n"] == 4 and rows[1]["back"] == "one two three four" and rows[1]["output"].count("\\$suf") == 1
    assert rows[2]["form"] == "plain" and rows[2]["prefix_chars"] is None
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.Markers(*bad)


def test_odd_rows(odd_docs, no_docs):
    found = infill.fill_in_middle(odd_docs)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted(((r["doc_id"], *plainly(r["doc_id"], r["text"])) for r in odd_docs.collect()), key=repr)
    assert infill.fill_in_middle(no_docs).collect() == []


def test_no_shuffle_and_no_python(spark):
    plan = QUERIES["op12_fill_in_middle"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
