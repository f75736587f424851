import json
from datetime import date, timedelta

import pytest

from feedloom.operators import retry
from feedloom.plans import jobs


def dump(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


@pytest.fixture
def context(spark):
    rows = [("a", "20240102", '{"ip":"a","n":1}'), ("a", None, '{"ip":"a","n":2,"note":"now"}'), ("b", "20240105", '{"ip":"b","n":3}')]
    return spark.createDataFrame(rows, "ip string, d string, raw string").selectExpr(
        "ip", "to_date(d, 'yyyyMMdd') as dt", "parse_json(raw) as v"
    )


@pytest.fixture
def failed(tmp_path):
    return dump(tmp_path / "failed.json", [
        {"IP": "a", "Timestamp": "20240101", "note": "kept", "Error_Reason": "old"}, {"IP": "b", "x": {"y": [1]}}, "not json",
        {"IP": "", "Timestamp": "20240101"}, {"Timestamp": "20240101"}, {"IP": "nan"}, {"IP": "a", "timestamp_of": "2024-01-05"},
    ])


def run(spark, failed, context, tmp_path, sources, done=None):
    out = tmp_path / f"out{len(list(tmp_path.iterdir()))}"
    counters = jobs.retry_failed(spark, failed, context, str(out), sources, done)
    lines = {}
    for status in ("ok", "failed"):
        folder = out / f"status={status}"
        read = spark.read.text(str(folder)).collect() if folder.exists() else []
        lines[status] = sorted((json.loads(r.value) for r in read), key=lambda r: (r["IP"], r["Queried_Date"]))
    return counters, lines, out


def asked(lines):
    return sorted((r["IP"], r["Queried_Date"]) for rows in lines.values() for r in rows)


def test_current_state(spark, failed, context, tmp_path):
    counters, lines, _ = run(spark, failed, context, tmp_path, [retry.Current()])
    assert counters == {"records": 6, "without_ip": 2, "undated": 0, "skipped": 0, "success": 2, "failed": 2, "processed": 4}
    first = next(r for r in lines["ok"] if "Timestamp" in r)
    # Members of the context win, the old reason is gone.
    assert first == {"IP": "a", "Timestamp": "20240101", "note": "now", "Queried_Date": "Current", "ip": "a", "n": 2}
    assert [(r["IP"], r["Error_Reason"]) for r in lines["failed"]] == [("b", "404 Not Found (No Data for Current)"), ("nan", "Missing or Invalid IP")]
    assert lines["failed"][0]["x"] == {"y": [1]}


def test_named_days(spark, failed, context, tmp_path):
    days = retry.named_days(spark, "[2024-01-02, 2024-01-04 to 2024-01-05]")
    assert days.days == (date(2024, 1, 2), date(2024, 1, 4), date(2024, 1, 5))
    counters, lines, _ = run(spark, failed, context, tmp_path, [days])
    assert counters["processed"] == 12 and {(r["IP"], r["Queried_Date"]) for r in lines["ok"]} == {("a", "20240102"), ("b", "20240105")}
    assert lines["failed"][0]["Error_Reason"] == "404 Not Found (No Data for 20240104)"
    with pytest.raises(ValueError):
        retry.named_days(spark, "soon")


def test_days_of_a_sheet(spark, failed, context, tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_text(
        'Client IP,Date Seen\n b ,20240101\nb,"[2024-01-05, 2024-01-05]"\nb,nothing\nc,20240101\n', encoding="utf-8"
    )
    counters, lines, _ = run(spark, failed, context, tmp_path, [jobs.sheet_days(spark, str(sheet))])
    assert asked(lines) == [("b", "20240105")] and counters["undated"] == 3 and counters["success"] == 1


def test_range_of_a_sheet(spark, failed, context, tmp_path):
    sheet = tmp_path / "range.csv"
    sheet.write_text('ip,"time\nof it"\nz,20240103\nz,"2024-01-01"\n', encoding="utf-8")
    counters, lines, _ = run(spark, failed, context, tmp_path, [jobs.sheet_range(spark, str(sheet), multi_line=True)])
    assert {d for _, d in asked(lines)} == {"20240101", "20240102", "20240103"} and counters["processed"] == 12
    empty = tmp_path / "empty.csv"
    empty.write_text("ip,time\nz,never\n", encoding="utf-8")
    with pytest.raises(Exception, match="no dates in the sheet"):
        run(spark, failed, context, tmp_path, [jobs.sheet_range(spark, str(empty))])


def test_days_around(spark, failed, context, tmp_path):
    counters, lines, _ = run(spark, failed, context, tmp_path, [retry.Around(1)])
    near = lambda d: [(date.fromisoformat(d) + timedelta(k)).strftime("%Y%m%d") for k in (-1, 0, 1)]
    assert asked(lines) == sorted(("a", d) for d in near("2024-01-01") + near("2024-01-05"))
    assert counters["undated"] == 2 and counters["without_ip"] == 2
    with pytest.raises(ValueError):
        retry.plan(spark.createDataFrame([("{}",)], "raw string").selectExpr("raw", "parse_json(raw) v"), [retry.Around(-1)])


def test_sources_are_joined_and_outputs_subtracted(spark, failed, context, tmp_path):
    """A day that two sources name is asked once; what earlier outputs hold, found or not, is not asked again."""
    sources = [retry.Around(0), retry.Days((date(2024, 1, 1), date(2024, 1, 2))), retry.Current()]
    counters, lines, out = run(spark, failed, context, tmp_path, sources)
    first = asked(lines)
    assert first.count(("a", "20240101")) == 2 and first.count(("a", "20240105")) == 1 and counters["processed"] == len(first) == 13
    done = [str(out / "status=ok"), str(out / "status=failed")]
    counters, lines, _ = run(spark, failed, context, tmp_path, [*sources, retry.Days((date(2024, 1, 9),))], done)
    assert counters["skipped"] == 13 and set(asked(lines)) == {(ip, "20240109") for ip in ("a", "b", "nan")} and counters["processed"] == 4
    with pytest.raises(ValueError):
        run(spark, failed, context, tmp_path, [])
