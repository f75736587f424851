import json
import random

import pytest
from pyspark.sql import functions as F

from feedloom.sources import feeds
from feedloom.sources.documents import array_members


def value(draw, depth=0):
    kind = draw.random()
    if depth > 3 or kind < 0.5:
        return draw.choice([1, -2.5, True, None, "", "a,b", 'q"[{', "]},\\", "\\\"", "é漢 x", "line\nfeed", "tab\t"])
    if kind < 0.75:
        return [value(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {draw.choice(["a", 'k"', "[", "b,}"]) + str(k): value(draw, depth + 1) for k in range(draw.randrange(4))}


def laid_out(draw, members):
    """An array as text, with lines broken at any place that JSON allows."""
    tokens = []
    decoder = json.JSONDecoder()
    text, at = json.dumps(members, ensure_ascii=False), 0
    while at < len(text):
        if text[at] == '"':
            _, end = decoder.raw_decode(text, at)
        elif text[at] in "[]{},: ":
            end = at + 1
        else:
            end = at
            while text[end] not in "[]{},: ":
                end += 1
        tokens.append(text[at:end])
        at = end
    return "".join(t + draw.choice(["", "", "\n", " ", "\n\n  "]) for t in tokens)


def canonical(rows):
    return sorted(json.dumps(x, sort_keys=True, ensure_ascii=False) for x in rows)


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that members run over several of them."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_random_arrays(spark, tmp_path, small_splits, seed):
    draw = random.Random(seed)
    wanted, folder = [], tmp_path / "in"
    folder.mkdir()
    for k in range(6):
        members = [value(draw) for _ in range(draw.choice([0, 1, 2, 30, 80]))]
        text = "[\n" + laid_out(draw, members)[1:]
        (folder / f"f {k}.json").write_text(text, encoding="utf-8")
        assert json.loads(text) == members
        wanted += members
    records = feeds.read_documents(spark, str(folder))
    got = records.select("raw", "file", "line", "item").collect()
    assert canonical(json.loads(r.raw) for r in got) == canonical(wanted)
    for name in {r.file for r in got}:
        assert sorted(r.item for r in got if r.file == name) == list(range(sum(r.file == name for r in got)))
    objects = feeds.read_documents(spark, str(folder), objects_only=True)
    assert canonical(json.loads(r.raw) for r in objects.select("raw").collect()) == canonical(x for x in wanted if isinstance(x, dict))


def test_order_and_many_tasks(spark, tmp_path, small_splits):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"n": k, "t": ["x" * (k % 50)] * 3} for k in range(500)], indent=2), encoding="utf-8")
    lines = feeds.read_lines(spark, str(path))
    assert lines.select("block").distinct().count() > 100
    rows = array_members(lines).select("member", F.expr("try_variant_get(v, '$.n', 'int')").alias("n")).collect()
    assert len(rows) == 500 and all(r.member == r.n for r in rows)


def test_broken_arrays_are_read_by_line(spark, tmp_path):
    texts = {
        "unclosed": '[\n{"a":1}\n', "twice": '[\n1]\n[2]\n', "comma": '[\n{"a":2},\n]\n', "extra": '[\n{"a":3}\n]]\n',
        "text": '[\n"un\nfinished"\n]\n{"a":4}\n', "gap": '[\n1,,\n2]\n',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(Exception, match="not a JSON array"):
            feeds.array_to_lines(spark, str(tmp_path / f"{name}.json")).collect()
    rows = feeds.read_documents(spark, str(tmp_path)).select("raw", F.regexp_extract("file", r"(\w+)\.json", 1).alias("f")).collect()
    got = {(r.f, r.raw) for r in rows}
    assert got == {("unclosed", '{"a":1}'), ("twice", "[2]"), ("extra", '{"a":3}'), ("text", '{"a":4}')}


def test_array_to_lines(spark, tmp_path):
    for k, text in enumerate(["[]", " [ \n ] ", "[1]", '[[1,2],\n{"b":[]}]', '[\n"a]",\n"b,"\n]']):
        path = tmp_path / f"{k}.json"
        path.write_text(text)
        got = [json.loads(r.value) for r in feeds.array_to_lines(spark, str(path)).collect()]
        assert canonical(got) == canonical(json.loads(text))
    path.write_text('{"a":1}')
    with pytest.raises(Exception, match="not a JSON array"):
        feeds.array_to_lines(spark, str(path)).collect()


def test_long_lines(spark, tmp_path):
    """Many members on one line of an array over several lines."""
    members = [{"k": k, "s": "[,]" * (k % 4)} for k in range(20_000)]
    path = tmp_path / "l.json"
    path.write_text("[\n" + json.dumps(members)[1:-1] + "\n]", encoding="utf-8")
    rows = feeds.read_documents(spark, str(path)).select("raw", "item").collect()
    assert [json.loads(r.raw)["k"] for r in sorted(rows, key=lambda r: r.item)] == list(range(20_000))
