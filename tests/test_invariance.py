"""Results do not depend on how the input is partitioned or ordered."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import enrich, forensics, snapshots, tags, timeline
from feedloom.operators.criteria import Criterion, filter_feed
from feedloom.sources.feeds import parsed


@pytest.fixture(scope="module")
def events(spark):
    """One key holds a third of the rows; the position decides which record is the last."""
    rows = []
    for i in range(240):
        ip = "hot" if i % 3 == 0 else f"ip{i % 17}"
        record = {"ip": ip, "x": i % 4, "l": [i % 2, 1, 0][: i % 4], "o": {"p": {"q": i % 5}}, "tag": f"t{i // 2}"}
        if i % 5:
            record["risk"] = ["low", None, "high"][i % 3]
        rows.append((i, ip, f"202401{i % 9 + 1:02d}", json.dumps(record)))
    return parsed(spark.createDataFrame(rows, "pos int, ip string, day string, raw string"))


def jobs(df):
    pos = F.col("pos")
    dated = df.withColumn("dt", F.to_date("day", "yyyyMMdd"))
    old = snapshots.latest_records(df.filter("day < '20240105'"), pos)
    new = snapshots.latest_records(df.filter("day >= '20240105'"), pos)
    series = timeline.daily_series(dated, pos)
    history = forensics.history_records(df.filter("day < '20240108'").withColumnRenamed("day", "ts"), pos)
    return {
        "filter": filter_feed(df, [Criterion("x", [">1"]), Criterion("risk", ["!high"])]).select("pos"),
        "diff": snapshots.diff_rows(snapshots.diff_records(old, new), "20240109"),
        "audit": snapshots.audit_duplicates(df, pos, [F.shiftright("pos", 4)]),
        "forensics": forensics.forensic_rows(history, new, "20240109"),
        "timeline": timeline.timeline_events(series),
        "presence": timeline.presence_intervals(series, "o.p.q", 3),
        "tags": tags.tag_diff(tags.tag_records(df.filter("day < '20240105'"), pos), tags.tag_records(df.filter("day >= '20240105'"), pos)),
        "lookup": enrich.context_lookup(dated.select("pos", F.col("ip").alias("IP"), F.date_sub("dt", 3).alias("dt")), series).select("pos", "status", "Error_Reason"),
    }


def rows(df):
    return sorted(map(repr, df.collect()))


def test_partitions_and_order(events):
    want = {name: rows(df) for name, df in jobs(events.coalesce(1)).items()}
    assert [name for name, found in want.items() if not found] == []
    for parts, seed in ((2, 1), (16, 2)):
        shuffled = events.orderBy(F.rand(seed)).repartition(parts)
        for name, df in jobs(shuffled).items():
            assert rows(df) == want[name], (name, parts)


def test_snapshot_identities(events):
    old = snapshots.latest_records(events.filter("day < '20240105'"), F.col("pos"))
    new = snapshots.latest_records(events.filter("day >= '20240105'"), F.col("pos"))
    row = snapshots.diff_summary(snapshots.diff_records(old, new)).first()
    assert row.unchanged + row.modified + row.added == row.current == new.count()
    assert row.unchanged + row.modified + row.removed == row.historic == old.count()
