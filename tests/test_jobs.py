"""The jobs on small files."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from feedloom.operators.criteria import Criterion
from feedloom.plans import jobs
from feedloom.streaming import criteria_stream


def dump(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_filter(spark, tmp_path):
    path = dump(tmp_path / "f.jsonl", [{"a": 1}, "bad", "", {"a": 5}, "[1]", {"a": 9}])
    counters = jobs.filter_feed_files(spark, path, str(tmp_path / "out"), [Criterion("a", [">2"])])
    assert counters == {"lines_parsed": 6, "exported": 2}
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"a": 5}', '{"a": 9}']


def test_profile_flatten_and_lines(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[\n{"a":{"b":1}},\n{"a":{"b":2},"c":[1,2]}\n]')
    got = jobs.profile_files(spark, str(path), top=1).collect()
    assert {(r.path, r.value, r.percent) for r in got} == {("a.b", "1", 50.0), ("c", "1", 50.0)}
    jobs.flatten_files(spark, str(path), str(tmp_path / "csv"))
    rows = spark.read.csv(str(tmp_path / "csv"), header=True).collect()
    assert {(r.a_b, r.c) for r in rows} == {("1", None), ("2", "1,2")}
    jobs.array_file_to_lines(spark, str(path), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2


def test_tags(spark, tmp_path):
    old = dump(tmp_path / "old.jsonl", [{"tag": "A"}])
    new = dump(tmp_path / "new.jsonl", [{"tag": "B", "categories": ["x"]}, {"tag": "B", "categories": ["y"]}])
    out = jobs.tag_changes(spark, old, new)
    assert sorted((r.tag, r.change) for r in out["diff"].collect()) == [("A", "removed"), ("B", "added")]
    assert [r.category for r in out["categories"].collect()] == ["y"]
    jobs.list_tags(spark, new, str(tmp_path / "tags"))
    assert spark.read.text(str(tmp_path / "tags")).count() == 2


def test_snapshots(spark, tmp_path):
    old = dump(tmp_path / "old.json", [{"ip": "a", "x": 1, "Timestamp": "20240101"}, {"ip": "b"}])
    new = dump(tmp_path / "new.json", [{"IP": "a", "x": 0}, {"IP": "a", "x": 2}])
    out = jobs.snapshot_changes(spark, old, new, "20240102")
    rows = {r.ip: r for r in out["rows"].collect()}
    assert json.loads(rows["a"].changes) == {"x": {"old": 1, "new": 2}} and rows["b"].status == "REMOVED"
    assert out["summary"].first().modified == 1 and out["attributes"].first().attribute == "x"


def test_staged_intermediates(spark, tmp_path):
    past = dump(tmp_path / "h.jsonl", [{"ip": "a", "x": 1, "Timestamp": "20240101"}])
    now = dump(tmp_path / "c.jsonl", [{"ip": "a", "x": 2}])
    out = jobs.forensic_report(spark, past, now, "20240102")
    assert out["summary"].first().multi_stage == 0
    folder = spark.conf.get("spark.checkpoint.dir")
    assert f"{folder}/history" in out["summary"]._jdf.queryExecution().toString()


def test_one_record_snapshot(spark, tmp_path):
    path = dump(tmp_path / "one.jsonl", [{"ip": "a", "x": 1}])
    assert jobs.snapshot_changes(spark, path, path, "20240102")["summary"].first().unchanged == 1


def test_forensics(spark, tmp_path):
    past = dump(tmp_path / "h.jsonl", [
        {"ip": "a", "x": "old", "Timestamp": "20240101"}, {"ip": "a", "x": "new", "Timestamp": "20240101"}, {"ip": "a", "x": "late", "timestamp": "20240102"}, {"ip": "z"},
    ])
    now = dump(tmp_path / "c.jsonl", [{"ip": "a"}])
    out = jobs.forensic_report(spark, past, now, "20240103")
    rows = {(r.section, r.ts): r.value for r in out["rows"].collect() if r.ip == "a"}
    assert rows == {("timeline", "20240101"): '"new"', ("timeline", "20240102"): '"late"', ("current", "20240103"): "null"}
    assert {(r.status, r.ts) for r in out["rows"].collect() if r.ip == "z"} == {("AGED_OUT", "unknown_date")}
    assert out["summary"].first().transient == 1
    assert [tuple(r) for r in out["attributes"].collect()] == [("x", 1, 0)]


def context(spark, rows):
    df = spark.createDataFrame(rows, "ip string, dt string, raw string")
    return df.select("ip", F.to_date("dt").alias("dt"), F.parse_json("raw").alias("v"))


def test_enrich_and_resume(spark, tmp_path):
    sheet = tmp_path / "s.csv"
    sheet.write_text("IP,First,Last,id\na,20240101,20240103,7\nb,,,8\n,20240101,,9\n")
    table = context(spark, [("a", "2024-01-01", '{"ip":"a","n":1}'), ("b", None, '{"ip":"b","n":2}')])
    counters, audit = jobs.enrich_sheet(spark, str(sheet), table, str(tmp_path / "out"), cap=2)
    ok = sorted(r.value for r in spark.read.text(str(tmp_path / "out/status=ok")).collect())
    assert ok == ['{"id":"7","Timestamp":"20240101","ip":"a","n":1}', '{"id":"8","Timestamp":null,"ip":"b","n":2}']
    failed = json.loads(spark.read.text(str(tmp_path / "out/status=failed")).first().value)
    assert failed == {"IP": "a", "id": "7", "Timestamp": "20240102", "Error_Reason": "404 Not Found (No Data)"}
    assert counters == {"processed": 3, "success": 2, "failed": 1, "skipped": 0}
    assert [r.Skipped_Range for r in audit.collect()] == ["20240103 to 20240103"]
    done = [str(tmp_path / "out/status=ok"), str(tmp_path / "out/status=failed")]
    counters, _ = jobs.enrich_sheet(spark, str(sheet), table, str(tmp_path / "again"), cap=3, done=done)
    assert counters == {"processed": 4, "success": 0, "failed": 1, "skipped": 3}


def test_timeline(spark):
    table = context(spark, [("a", "2024-01-01", '{"k":1}'), ("a", "2024-01-02", '{"k":2}'), ("a", "2023-01-01", '{"k":0}'), ("b", "2024-01-01", '{"k":1}')])
    ips = spark.createDataFrame([("a",), ("q",)], "ip string")
    out = jobs.timeline_report(table, ips, "20240101-20240103", search_key="k", search_value="1")
    assert sorted((r.ip, r.event) for r in out["events"].collect()) == [("a", "Change"), ("a", "Final Context"), ("a", "Initial Context")]
    assert sorted((r.ip, r.start, r.end) for r in out["intervals"].collect()) == [("a", "20240101", "20240101"), ("q", None, None)]
    with pytest.raises(ValueError):
        jobs.timeline_report(table, ips, "sometime")


def test_geo(spark, tmp_path):
    feed = dump(tmp_path / "g.jsonl", [{"prefix": "10.0.0.0/24", "geo": "x"}, "bad", {"prefix": "9.0.0.0/24"}])
    reg = spark.createDataFrame([("10.0.0.1", '{"asn_cidr":"10.0.0.0/24"}'), ("9.0.0.1", '{"asn_cidr":"9.0.0.0/24"}')], "ip string, raw string")
    reg = reg.select("ip", F.parse_json("raw").alias("v"))
    got = jobs.geo_by_prefix(spark, spark.createDataFrame([("10.0.0.1",)], "ip string"), reg, feed).collect()
    assert [(r.ip, r.cidr) for r in got] == [("10.0.0.1", "10.0.0.0/24")]


def test_geo_records(spark, tmp_path):
    feed = dump(tmp_path / "g.jsonl", [{"prefix": "10.0.0.0/24", "geo": "x"}, {"prefix": "9.0.0.0/24"}])
    reg = spark.createDataFrame([("10.0.0.1", '{"asn_cidr":"10.0.0.0/24"}')], "ip string, raw string")
    reg = reg.select("ip", F.parse_json("raw").alias("v"))
    jobs.geo_records(spark, spark.createDataFrame([("10.0.0.1",)], "ip string"), reg, feed, str(tmp_path / "out"))
    line = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert line == {"ip": "10.0.0.1", "cidrs": [{"cidr": "10.0.0.0/24", "ipgeo_data": {"prefix": "10.0.0.0/24", "geo": "x"}}]}


def test_enrich_list(spark, tmp_path):
    path = tmp_path / "ips.txt"
    path.write_text("10.0.0.0/31, 10.0.0.1\nnone 10.0.0.9\n")
    table = context(spark, [("10.0.0.1", "2024-01-01", '{"ip":"10.0.0.1","n":1}'), ("10.0.0.9", None, '{"ip":"10.0.0.9"}')])
    counters = jobs.enrich_list(spark, str(path), table, str(tmp_path / "out"), date(2024, 1, 1))
    assert counters["success"] == 1 and counters["processed"] == 4
    counters = jobs.enrich_list(spark, str(path), table, str(tmp_path / "now"))
    assert counters["success"] == 1 and counters["failed"] == 3


def test_summaries_and_counts(spark, tmp_path):
    path = dump(tmp_path / "f.jsonl", [{"a": 1}, {"a": 1}, {"a": 2}])
    jobs.summarise_files(spark, path, str(tmp_path / "out"), top=1)
    line = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert (line["key"], line["unique_count"], line["total_input_objects"], line["unique_values"][0]["count"]) == ("a", 2, 3, 2)
    assert jobs.count_lines(spark, path, {"ones": '"a": 1', "none": "b"}) == {"lines": 3, "ones": 2, "none": 0}


def test_latest_context(spark):
    rows = context(spark, [("a", "2024-01-01", '{"k":1}'), ("a", "2024-01-02", '{"k":2}')]).withColumn("n", F.lit(1))
    got = jobs.latest_context(rows, F.col("n")).select("dt", F.expr("v:k::int").alias("k")).collect()
    assert sorted((str(r.dt), r.k) for r in got) == [("2024-01-01", 1), ("2024-01-02", 2), ("None", 2)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    dump(tmp_path / "in/a.jsonl", [{"t": "err", "n": 60}, {"t": "err", "n": 5}, "bad"])
    criteria = [Criterion("t", ["err"]), Criterion("n", [">50"])]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for more in (None, [{"t": "error", "n": 51}]):
        if more:
            dump(tmp_path / "in/b.jsonl", more)
        run = criteria_stream.write_matches(criteria_stream.stream_matches(spark, str(tmp_path / "in"), criteria), out, state)
        assert run.awaitTermination(120)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"t": "err", "n": 60}', '{"t": "error", "n": 51}']


def test_stream_counters(spark, tmp_path):
    """Counts of every run over all its batches, blank and malformed lines included."""
    (tmp_path / "in").mkdir()
    criteria = [Criterion("n", [">50"])]
    where = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(5):
        dump(tmp_path / f"in/{k}.jsonl", [{"n": 60 + k}, {"n": 5}, "bad", ""])
    assert criteria_stream.filter_stream(spark, *where, criteria, max_files_per_trigger=2) == {"lines_parsed": 20, "exported": 5}
    assert criteria_stream.filter_stream(spark, *where, criteria) == {"lines_parsed": 0, "exported": 0}
    dump(tmp_path / "in/9.jsonl", [{"n": 51}, {"n": 99}])
    assert criteria_stream.filter_stream(spark, *where, criteria) == {"lines_parsed": 2, "exported": 2}
    assert spark.read.text(where[1]).count() == 7
