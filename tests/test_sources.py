import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from feedloom.sources import catalog, feeds, sinks
from feedloom.operators import snapshots


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def values(df):
    return sorted(r.j for r in df.select(F.to_json("v").alias("j")).collect())


def test_lines_drop_blank_and_bad(spark, tmp_path):
    path = write(tmp_path / "f.jsonl", '{"a":1}\n\n  \nbad\n{"a":2}  \r\n{"a":3,"a":4}\n')
    assert values(feeds.read_feed(spark, path)) == ['{"a":1}', '{"a":2}', '{"a":4}']
    assert feeds.malformed_lines(spark, path).first().malformed == 1


def test_invalid_utf8_does_not_fail(spark, tmp_path):
    (tmp_path / "f.jsonl").write_bytes(b'{"a":"x\xff"}\n{"a":"y"}\n')
    assert feeds.read_feed(spark, str(tmp_path / "f.jsonl")).count() == 2


def test_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "20240101Anonymous.json.gz", "wt") as f:
        f.write("\n".join(json.dumps({"n": i}) for i in range(100)))
    df = feeds.read_feed(spark, str(tmp_path / "20240101Anonymous.json.gz"))
    assert df.count() == 100
    info = df.select(*[c.alias(n) for n, c in catalog.snapshot_info(F.col("file")).items()]).distinct().collect()
    assert [tuple(r) for r in info] == [("20240101", None, "Anonymous")]


@pytest.mark.parametrize("name, text, want", [
    ("a.json", '[{"a":1},\n {"a":[2]}]', ['{"a":1}', '{"a":[2]}']),
    ("o.json", '{\n "a": 1\n}', ['{"a":1}']),
    ("one.json", '{"a":1}', ['{"a":1}']),
    ("lines.json", '{"a":1}\n[{"a":2},{"a":3}]\nbad\n', ['{"a":1}', '{"a":2}', '{"a":3}']),
    ("broken.json", '{"a":1\n{"a":2}\n', ['{"a":2}']),
    ("scalar.json", "7", ["7"]),
    ("name with space & %41.json", '[\n{"a":1}\n]', ['{"a":1}']),
])
def test_documents(spark, tmp_path, name, text, want):
    assert values(feeds.read_documents(spark, write(tmp_path / name, text))) == want


def test_documents_in_one_folder(spark, tmp_path):
    write(tmp_path / "a.json", '[\n{"a":1},\n{"a":2}\n]')
    write(tmp_path / "b.json", '{"a":3}\n{"a":4}\n5\n')
    df = feeds.read_documents(spark, str(tmp_path), objects_only=True)
    assert values(df) == ['{"a":1}', '{"a":2}', '{"a":3}', '{"a":4}']


def test_array_to_lines(spark, tmp_path):
    path = write(tmp_path / "a.json", '[{"b":1,"a":"é"},\n2]')
    assert sorted(r.value for r in feeds.array_to_lines(spark, path).collect()) == ["2", '{"a":"é","b":1}']
    with pytest.raises(Exception, match="not a JSON array"):
        feeds.array_to_lines(spark, write(tmp_path / "o.json", '{"a":1}')).collect()


@pytest.mark.parametrize("text, want", [
    ('["A","B",{"tag":"C"},5]', ["A", "B", "C"]),
    ('[\n"A",\n"B"\n]', ["A", "B"]),
    ('{"tag":"A"}', ["A"]),
    ('{"tag":"A"}\n"B"\nRAW_TAG\n{"no":1}\n\n', ["A", "B", "RAW_TAG"]),
])
def test_tags(spark, tmp_path, text, want):
    assert sorted(r.tag for r in feeds.read_tags(spark, write(tmp_path / "t.json", text)).collect()) == want


def test_tag_list_and_items(spark, tmp_path):
    path = write(tmp_path / "t.txt", "A\n\n B \n")
    assert sorted(r.tag for r in feeds.read_tag_list(spark, path).collect()) == ["A", "B"]
    path = write(tmp_path / "i.txt", "1.1.1.1, 2.2.2.2 3.3.3.3\n\n::1,\n")
    assert sorted(r.item for r in feeds.read_items(spark, path).collect()) == ["1.1.1.1", "2.2.2.2", "3.3.3.3", "::1"]


def test_sheet_with_bom(spark, tmp_path):
    path = write(tmp_path / "s.csv", "﻿IP, First Seen \n1.1.1.1,2024-01-01\n")
    df = feeds.read_sheet(spark, path)
    assert df.columns == ["ip", "first seen"] and df.first().ip == "1.1.1.1"


def test_last_record_wins_in_file_order(spark, tmp_path):
    path = write(tmp_path / "s.jsonl", "".join(f'{{"IP":" 1.1.1.{i % 3} ","n":{i}}}\n' for i in range(30)))
    df = feeds.read_feed(spark, path)
    assert feeds.ip_key(df) == "IP"
    keyed = feeds.keyed_records(df)
    last = snapshots.latest_records(keyed, feeds.position(keyed))
    got = {r.ip: r.n for r in last.select("ip", F.expr("v:n::int").alias("n")).collect()}
    assert got == {"1.1.1.0": 27, "1.1.1.1": 28, "1.1.1.2": 29}
    audit = snapshots.audit_duplicates(keyed, feeds.position(keyed), feeds.position_chunk()).first()
    assert (audit.identical, audit.conflicting) == (0, 27)


def test_keyed_records_need_an_ip(records):
    df = feeds.keyed_records(records({"ip": "a"}, {"Ip_Address": "b"}, {"ip": ""}, {"x": 1}))
    assert sorted(r.ip for r in df.collect()) == ["a", "b"]


def test_file_date(spark):
    rows = spark.createDataFrame([("/x/20240203-feed.json",), ("/x/feed.json",)], "f string")
    got = rows.select(catalog.file_date(F.col("f"), F.lit("2024-05-06 01:02:03").cast("timestamp")).alias("d")).collect()
    assert [r.d for r in got] == ["20240203", "20240506"]


@pytest.mark.parametrize("name, want", [
    ("20240101120000AnonResRT.json", ("20240101", "120000", "AnonResRT")),
    ("20240101AnonymousResidential.json.gz", ("20240101", None, "AnonymousResidential")),
    ("20240101AnonResWeekly.json", (None, None, "AnonymousResidentialWeekly")),
    ("20240101.json", (None, None, "CustomFeed")),
    ("myfeed.json", (None, None, "myfeed")),
])
def test_snapshot_info(spark, name, want):
    df = spark.createDataFrame([(f"file:/d/{name}",)], "f string")
    assert tuple(df.select(*catalog.snapshot_info(F.col("f")).values()).first()) == want


def test_feed_catalog(spark):
    df = catalog.feed_catalog(spark)
    assert df.count() == 27 and df.select("category").distinct().count() == 8
    row = df.filter("dataset = 'AnonymousResidentialRT'").first()
    assert catalog.feed_path(row.path_template, "20240101", "0930") == "anonymous-residential/realtime/20240101/0930.json.gz"


def test_sinks(spark, tmp_path, records):
    df = spark.createDataFrame([("1", "ok", None), ("2", "failed", "é")], "ip string, status string, note string")
    sinks.write_json_lines(df.drop("status"), str(tmp_path / "j"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert lines == ['{"ip":"1","note":null}', '{"ip":"2","note":"é"}']
    sinks.write_by_status(df, str(tmp_path / "s"))
    assert sorted(d for d in os.listdir(tmp_path / "s") if d.startswith("status")) == ["status=failed", "status=ok"]
    feed = records('{"b": 1,  "a": 2}')
    sinks.write_raw_lines(feed, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == '{"b": 1,  "a": 2}'
    sinks.write_tags(spark.createDataFrame([("B",), ("A",)], "tag string"), str(tmp_path / "t"))
    assert sinks.line_count(feeds.read_tag_list(spark, str(tmp_path / "t"))).first().lines == 2


def test_wide_csv(spark, tmp_path, records):
    sinks.write_wide_csv(records({"b": {"x": True}, "a": [1, "c"]}, {"c": None, "a": 'q"'}, [1]), str(tmp_path / "c"))
    rows = spark.read.csv(str(tmp_path / "c"), header=True, escape='"').collect()
    assert rows[0].asDict().keys() == {"a", "b_x", "c"}
    assert sorted((r.a, r.b_x, r.c) for r in rows if r.b_x) == [("1,c", "True", None)]
    assert [r.b_x for r in rows].count(None) == 1


def test_landed_feed_prunes_by_date(spark, tmp_path, records):
    for day in ("20240101", "20240102"):
        feeds.land_feed(records({"d": day}), str(tmp_path / "lake"), "Anonymous", day)
    df = spark.read.parquet(str(tmp_path / "lake")).filter("snapshot_date = '20240102'")
    assert values(df) == ['{"d":"20240102"}']
    assert "PartitionFilters: [isnotnull(snapshot_date" in df._jdf.queryExecution().toString()


def test_spread_only_where_asked(spark):
    few = spark.range(0, 100, 1, 1)
    assert feeds.spread(few) is few
    assert feeds.spread(few, 4).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("line, whole", [
    ('{"a":1}', True), ("[1,2]", True), ('"x"', True), ("12", True), ("null", True), ('[1,"x"]', True), ('{"a":1} ', True),
    ('{"a":1} xyz', False), ('{"a":1}{"b":2}', False), ('{"a":1},', False), ("12 monkeys", False), ("1,2", False), ("", False),
    ("true vpn", False), ('"QUOTED" x', False), ("1]", False), ('1,"x"],["y"', False), ("[1", False), ("{", False), ("a", False),
])
def test_a_line_is_one_value_and_nothing_else(spark, line, whole):
    row = feeds.parsed(spark.createDataFrame([(line,)], "raw string")).select((F.col("v").isNotNull()).alias("ok")).first()
    assert row.ok == whole


def test_raw_tags_that_begin_like_json(spark, tmp_path):
    path = write(tmp_path / "t.txt", '12 monkeys\ntrue vpn\n"QUOTED" x\n"Q"\n')
    assert sorted(r.tag for r in feeds.read_tags(spark, path).collect()) == ['"QUOTED" x', "12 monkeys", "Q", "true vpn"]


def test_a_document_beyond_the_row_limit_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "DOCUMENT_BYTES", 10)
    array = write(tmp_path / "a.json", '[\n{"ip": "1.1.1.1",\n"n": 1}\n]')
    assert feeds.read_documents(spark, array).count() == 1
    path = write(tmp_path / "d.json", '{"ip": "1.1.1.1",\n"n": 1}')
    with pytest.raises(ValueError, match="too large"):
        feeds.read_documents(spark, path).collect()
    lines = write(tmp_path / "l.json", '{"ip": "1.1.1.1"}\n{"ip": "2.2.2.2"}\n')
    assert feeds.read_documents(spark, lines).count() == 2


CELLS = ['say "hi", ok', " x ", "a,b", "plain", '"', "ü", "", "tab\t"]


def test_wide_csv_keeps_cells(records, tmp_path):
    import csv

    sinks.write_wide_csv(records(*[{"k": c, "n": i} for i, c in enumerate(CELLS)]), str(tmp_path / "out"), bom=True)
    got = {}
    for part in (tmp_path / "out").glob("part-*.csv"):
        with open(part, encoding="utf-8-sig", newline="") as file:
            got |= {int(r["n"]): r["k"] for r in csv.DictReader(file)}
    assert [got[i] for i in range(len(CELLS))] == CELLS


def test_sheet_with_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path / "s.csv", 'IP,Note,N\n1.1.1.1,"a ""b"", c",2\n2.2.2.2,"two\nlines",3\n')
    rows = feeds.read_sheet(spark, path, multi_line=True).collect()
    assert [(r.ip, r.note, r.n) for r in rows] == [("1.1.1.1", 'a "b", c', "2"), ("2.2.2.2", "two\nlines", "3")]


def test_colliding_keys_keep_the_last(records):
    from feedloom.operators.criteria import Criterion, filter_feed

    df = records({"a": {"b": 1}, "a_b": 2}, {"a": {"b": 1}}, {"a_b": 2})
    for columns in (None, ["a_b"]):
        assert [r.a_b for r in sinks.wide(df, columns).orderBy("id").collect()] == ["2", "1", "2"]
    hits = lambda x: [r.id for r in filter_feed(df, [Criterion("a_b", [x])]).orderBy("id").collect()]
    assert hits("=2") == [0, 2] and hits("=1") == [1]
