import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import grouping, snapshots, timeline
from feedloom.plans import jobs
from feedloom.sources import landing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def halves(spark):
    rows = spark.range(400).selectExpr(
        "id", "cast(id % 90 as string) as ip", "cast(date_add(date '2024-01-01', cast(id div 90 as int)) as date) as dt",
        "parse_json(concat('{\"ip\":\"', id % 90, '\",\"n\":', id % 7, '}')) as v",
    )
    return [snapshots.latest_records(rows.filter(f"id % 2 = {k} or ip < '3'"), F.col("id")) for k in (0, 1)], rows


@pytest.fixture
def no_broadcast(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_diff_of_landed_snapshots_moves_no_rows(spark, halves, no_broadcast):
    (old, new), _ = halves
    sides = [landing.land(df, f"snapshot_{k}", 8) for k, df in enumerate((old, new))]
    diff, apart = snapshots.diff_records(*sides), snapshots.diff_records(old, new)
    assert "Exchange" not in plan(diff) and "Exchange" in plan(apart)
    text = lambda df: sorted((r.ip, r.status, r.c) for r in df.select("ip", "status", F.to_json("changes").alias("c")).collect())
    assert text(diff) == text(apart) and len(text(diff)) == 90
    ips = spark.range(9).selectExpr("cast(id as string) as ip")
    listed = landing.land(ips, "listed", 8)
    assert "Exchange" not in plan(sides[0].join(listed, "ip", "left_semi"))


def test_windows_over_landed_days_move_no_rows(halves):
    _, rows = halves
    series = timeline.daily_series(rows, F.col("id"))
    kept = landing.land(series, "days", 5)
    changes = timeline.daily_changes(kept)
    assert "Exchange" not in plan(changes) and "Exchange" not in plan(grouping.last_per_key(kept, ["ip"], F.col("dt")))
    names = ["ip", "dt", "path", "old_value", "new_value"]
    assert sorted(changes.select(names).collect()) == sorted(timeline.daily_changes(series).select(names).collect())


def test_job_and_modes(spark, tmp_path):
    for k, rows in enumerate(([{"ip": "a", "x": 1}, {"ip": "b"}], [{"ip": "a", "x": 2}, {"ip": "c"}, {"ip": "c", "y": 1}])):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
        assert jobs.land_snapshot(spark, str(tmp_path / f"{k}.jsonl"), f"job_{k}", 3).count() == 2
    out = jobs.landed_changes(spark, "job_0", "job_1", "20240102")
    assert {(r.ip, r.status) for r in out["rows"].collect()} == {("a", "MODIFIED"), ("b", "REMOVED"), ("c", "ADDED")}
    with pytest.raises(Exception, match="already exists"):
        landing.land(spark.range(1).selectExpr("'a' as ip"), "job_0", 3)
    with pytest.raises(ValueError):
        landing.land(spark.range(1), "none", 0)
