from datetime import date

import pytest
from pyspark.sql import functions as F

from feedloom.functions import dates as d
from feedloom.operators import enrich, requests, tags


def column(spark, values, name="c"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} string")


@pytest.mark.parametrize("text, want", [
    ("20240105", "2024-01-05 00:00:00"), ("1/5/2024", "2024-01-05 00:00:00"), ("01/05/24", "2024-01-05 00:00:00"),
    ("1/5/68", "2068-01-05 00:00:00"), ("1/5/69", "1969-01-05 00:00:00"), ("2024-1-5", "2024-01-05 00:00:00"),
    ("01-05-2024", "2024-01-05 00:00:00"), ("1/5/2024 3:04", "2024-01-05 03:04:00"), ("1/5/70 13:04", "1970-01-05 13:04:00"),
    ("2024-01-05 03:04:05", "2024-01-05 03:04:05"), ("Fri, Jan 05, 2024 03:04 PM UTC", "2024-01-05 15:04:00"),
    ("2024-01-05T03:04:05Z", "2024-01-05 03:04:05"), ("2024-01-05T03:04:05.5+02:00", "2024-01-05 03:04:05.5"),
    ("2025-01-01:00:00:00.000", "2025-01-01 00:00:00"), ("1704423845", "2024-01-05 03:04:05"), ("20240105.0", "2024-01-05 00:00:00"),
    (" 20240105 ", "2024-01-05 00:00:00"), ("nan", None), ("", None), (None, None), ("x", None), ("1704423845000", None),
    ("2024-02-30", None), ("13/13/2024", None), ("2024-01-05T25:00:00", None),
])
def test_instants(spark, text, want):
    assert column(spark, [text]).select(d.instant("c").cast("string").alias("i")).first().i == want


@pytest.mark.parametrize("text, want", [
    ("[2026-02-06, 2026-02-08 to 2026-02-10]", [6, 8, 9, 10]), ('"2026-02-06"', [6]), ("20260203-20260201", [1, 2, 3]),
    ("2026-02-03 - 2026-02-05, 02-04-2026", [3, 4, 5]), ("junk, 2026-02-01", [1]), ("2026-02-01 to junk", []), (None, []), ("nan", []),
    ("2026-02-01 23:00:00 to 2026-02-03 01:00:00", [1, 2]), ("[]", []),
])
def test_date_sets(spark, text, want):
    got = column(spark, [text]).select(d.date_set("c").alias("s")).first().s
    assert got == [date(2026, 2, day) for day in want]


def test_spans():
    assert d.parse_span("20260302-20260327") == (date(2026, 3, 2), date(2026, 3, 27))
    assert d.parse_span("30 Days", date(2026, 1, 31)) == (date(2026, 1, 1), date(2026, 1, 31))
    assert d.parse_span("2 weeks", date(2026, 1, 31)) == (date(2026, 1, 17), date(2026, 1, 31))
    assert d.parse_span("2 months") is None and d.parse_span("a-b") is None


def test_day_of(spark):
    got = column(spark, ["20240229", "20230229", "2024"]).select(d.day_of(F.col("c")).alias("d")).collect()
    assert [r.d for r in got] == [date(2024, 2, 29), None, None]


def test_column_discovery():
    assert requests.map_columns([" IP Address", "Vendor", "First Seen"]) == (" IP Address", "First Seen", "Vendor")
    assert requests.map_columns(["ip", "date"]) == ("ip", "date", "date")
    assert requests.map_columns(["ips", "start", "end", "date"]) == ("ips", "start", "end")
    assert requests.map_columns(["ip", "last seen"]) == ("ip", "last seen", "last seen")
    assert requests.map_columns(["ip"]) == ("ip", None, None)
    with pytest.raises(ValueError):
        requests.map_columns(["zip"])
    assert requests.map_columns_loosely(["zip", "runtime"]) == ("zip", "runtime")
    with pytest.raises(ValueError):
        requests.map_columns_loosely(["ip"])


ROWS = [
    ("1", "20240101", "20240103"), ("2", "2024-01-05", "20240103"), ("3", "20240101", None), ("4", "x", "20240102"),
    ("5", None, "y"), ("6", "2024-01-01 23:00:00", "2024-01-02 01:00:00"), ("7", "20240101", "20240120"),
]


@pytest.fixture
def sheet(spark):
    return spark.createDataFrame([(i, s, e, "keep") for i, s, e in ROWS], "IP string, s string, e string, note string")


def test_expand_days(sheet):
    rows = requests.expand_days(sheet, "s", "e", cap=5).collect()
    got = {}
    for r in rows:
        assert r.note == "keep"
        got.setdefault(r.IP, []).append(r.Timestamp and r.Timestamp[-2:])
    assert got == {
        "1": ["01", "02", "03"], "2": ["03", "04", "05"], "3": ["01"], "4": ["02"], "5": [None], "6": ["01"],
        "7": ["01", "02", "03", "04", "05"],
    }
    audit = requests.skipped_ranges(sheet, "IP", "s", "e", 5).collect()
    assert [tuple(r) for r in audit] == [
        ("7", "20240101 to 20240105", "20240106 to 20240120", "Exceeded 5-day cap. (Total span: 20 days)")
    ]
    assert requests.max_span(sheet, "s", "e").first().max_days == 20
    assert requests.max_span(sheet.filter("IP = '5'"), "s", "e").first().max_days == 0
    assert {r.Timestamp for r in requests.expand_days(sheet, "s", "e", historic=False).collect()} == {None}


def test_resume(spark, records):
    df = spark.createDataFrame(
        [(" A ", "20240101"), ("a", None), ("b", "20240101"), ("c", None), ("", "1"), ("NaN", "1"), (None, None)], "IP string, Timestamp string"
    )
    valid = requests.valid_requests(df)
    assert valid.count() == 4
    done = requests.done_keys(records({"ip": "a", "Timestamp": "20240101"}), records({"IP": "C", "Timestamp": None}, {"x": 1}))
    assert sorted(r.IP for r in requests.resume(valid, done).collect()) == ["a", "b"]


def test_dates_per_ip(spark):
    sheet = spark.createDataFrame(
        [(1, "a", "20240101"), (2, "a", "20240105, 20240106"), (3, "a", "junk"), (4, "b", "n/a")], "seq int, ip string, date string"
    )
    dates = requests.dates_per_ip(sheet, "ip", "date", F.col("seq"))
    records = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "IP string, n int")
    got = sorted((r.n, r.dt.day) for r in requests.with_own_dates(records, dates).collect())
    assert got == [(1, 5), (1, 6), (3, 5), (3, 6)]
    bounds = requests.global_range(sheet, "date")
    assert tuple(bounds.first()) == (date(2024, 1, 1), date(2024, 1, 6), 6)
    assert requests.with_dates(records, requests.range_days(bounds)).count() == 18


def test_proximity(records):
    df = records(
        {"IP": "1", "Timestamp": "none", "Queried_Date": "20240105"}, {"my_TIMESTAMP_x": "2024-01-05"}, {"IP": "3"},
        {"Update": "20240101 to 20240102"}, {"Timestamp": "20240110", "date": "20240101"},
    )
    got = {}
    for r in requests.proximity_dates(df, 1).select("id", "dt").collect():
        got.setdefault(r.id, set()).add(r.dt.day)
    assert got == {0: {4, 5, 6}, 1: {4, 5, 6}, 3: {31, 1, 2, 3}, 4: {9, 10, 11}}
    assert requests.undated(df).first().undated == 1


def test_normalise_ips(spark):
    items = column(spark, ["1.2.3.4", "1.2.3.4", "01.2.3.4", "10.0.0.7/30", "::1", "0:0::1", "2001:DB8::/126", "x", "1.2.3.4/33", "fe80::/129"], "item")
    got = sorted(r.ip for r in requests.normalise_ips(items).collect())
    want = ["1.2.3.4", "::1"] + [f"10.0.0.{i}" for i in range(4, 8)] + ["2001:db8::"] + [f"2001:db8::{i}" for i in (1, 2, 3)]
    assert got == sorted(want)
    assert sorted(r.item for r in requests.rejected_ips(items).collect()) == ["01.2.3.4", "1.2.3.4/33", "fe80::/129", "x"]


def test_masks_and_expanded_items(spark):
    items = column(spark, ["10.0.0.5/255.255.255.252", "10.0.1.5/0.0.0.1", "10.0.0.0/255.0.255.0", "TAG", "::4/127", "::1", "1.2.3.4/33", "1.1.1.1", "1.1.1.1"], "item")
    got = sorted(r.ip for r in requests.expand_items(items).collect())
    assert got == sorted([
        "10.0.0.4", "10.0.0.5", "10.0.0.6", "10.0.0.7", "10.0.1.4", "10.0.1.5", "10.0.0.0/255.0.255.0", "TAG", "::4", "::5", "::1",
        "1.2.3.4/33", "1.1.1.1", "1.1.1.1",
    ])


def test_large_ranges(spark):
    items = column(spark, ["10.0.0.0/8", "10.0.0.0/15", "1.1.1.1"], "item")
    with pytest.raises(Exception, match="too many addresses"):
        requests.normalise_ips(items).count()
    assert requests.normalise_ips(items, on_large="skip").count() == 2**17 + 1
    half = items.filter("item <> '10.0.0.0/8'")
    assert requests.normalise_ips(half, max_expand=10, on_large="expand").count() == 2**17 + 1


CONTEXT = [("a", "20240101", {"ip": "a", "o": 1}), ("a", None, {"ip": "a", "o": 2, "extra": "ctx"})]


def context(records):
    rows = records(*[v for _, _, v in CONTEXT])
    keys = F.element_at(F.array(*[F.struct(F.lit(k).alias("ip"), F.lit(t).cast("string").alias("t")) for k, t, _ in CONTEXT]), F.col("id") + 1)
    return rows.select(keys.alias("k"), "v").select("k.ip", d.day_of(F.col("k.t")).alias("dt"), "v")


def test_context_lookup(spark, records):
    asked = spark.createDataFrame(
        [(1, "a", date(2024, 1, 1), "row"), (2, "a", None, "row"), (3, "a", date(2024, 1, 2), "row"), (4, None, None, "row"), (5, "a", date(2024, 2, 1), "r")],
        "n int, IP string, dt date, extra string",
    )
    rows = enrich.context_lookup(asked, context(records), today=F.lit(date(2024, 2, 1)), name_day=True)
    got = {r.n: (r.status, r.Error_Reason) for r in rows.collect()}
    assert got == {
        1: ("ok", None), 2: ("ok", None), 3: ("failed", "404 Not Found (No Data for 20240102)"),
        4: ("failed", "Missing or Invalid IP"), 5: ("ok", None),
    }
    lines = {r.value for r in enrich.enriched_json(rows.drop("dt").filter("n in (2, 3)")).collect()}
    assert lines == {
        '{"n":2,"extra":"ctx","ip":"a","o":2}',
        '{"n":3,"IP":"a","extra":"row","Error_Reason":"404 Not Found (No Data for 20240102)"}',
    }
    row = enrich.lookup_summary(rows).first()
    assert (row.processed, row.success, row.failed, row.skipped, row.success_pct) == (5, 3, 2, 0, 60.0)


def test_lookup_reads_only_the_days_asked_for(spark, records, tmp_path):
    days = [date(2024, 1, n) for n in range(1, 6)]
    rows = spark.createDataFrame([("a", d, "{}") for d in days] + [("a", None, '{"now":1}')], "ip string, dt date, raw string")
    rows.select("ip", "dt", F.parse_json("raw").alias("v")).write.partitionBy("dt").parquet(str(tmp_path / "ctx"))
    table = spark.read.parquet(str(tmp_path / "ctx"))
    asked = spark.createDataFrame([("a", date(2024, 1, 2)), ("a", date(2024, 1, 3)), ("a", None)], "IP string, dt date")
    found = enrich.context_lookup(asked, table)
    assert [r.status for r in found.collect()] == ["ok"] * 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(isnull(dt" in plan and "Subquery" in plan
    only_now = enrich.context_lookup(asked.filter("dt is null"), table)
    assert [r.status for r in only_now.collect()] == ["ok"]


def test_networks(records, spark):
    reg = records(
        {"network": {"cidr": [{"value": "10.0.0.0/24"}, {"x": 1}, {"value": "10.0.0.0/16"}]}}, {"network": {"cidr": []}, "asn_cidr": "10.1.0.0/16"},
        {"network": "bad"}, {"asn_cidr": "10.0.0.0/16"},
    ).withColumn("ip", F.concat(F.lit("ip"), 9 - F.col("id")))
    resolved = enrich.resolve_networks(reg)
    assert sorted(resolved.collect(), key=str) == sorted(
        [("ip9", "10.0.0.0/24"), ("ip9", "10.0.0.0/16"), ("ip8", "10.1.0.0/16"), ("ip7", None), ("ip6", "10.0.0.0/16")], key=str
    )
    feed = spark.createDataFrame([("10.0.0.0/16", 1), ("10.0.0.0/16", 2), ("10.9.0.0/16", 3)], "prefix string, n int")
    assert sorted((r.n, r.ip) for r in enrich.prefix_join(feed, resolved).collect()) == [(1, "ip6"), (2, "ip6")]
    assert enrich.prefix_join(feed, resolved, first_only=False).count() == 4


def test_longest_prefix(spark):
    ips = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("11.0.0.1",), ("bad",), ("255.255.255.255",)], "ip string")
    pre = spark.createDataFrame([("10.0.0.0/8", "a"), ("10.1.0.0/16", "b"), ("10.1.2.0/24", "c"), ("10.1.2.77/28", "d"), ("255.255.255.255/32", "e"), ("x", "f")], "prefix string, geo string")
    got = {r.ip: r.geo for r in enrich.longest_prefix(ips, pre).collect()}
    assert got == {"10.1.2.3": "c", "10.1.9.9": "b", "255.255.255.255": "e"}


def test_tag_job(records):
    old = tags.tag_records(records({"tag": "A"}, {"tag": "B", "categories": ["x"]}, {"no": 1}), F.col("id"))
    new = tags.tag_records(
        records({"tag": "B"}, {"tag": "C", "categories": ["old"]}, {"tag": "C", "categories": ["p", "q"]}, {"tag": "D", "categories": [], "description": "text"}),
        F.col("id"),
    )
    assert sorted((r.tag, r.change) for r in tags.tag_diff(old, new).collect()) == [("A", "removed"), ("C", "added"), ("D", "added")]
    added = tags.added_records(old, new)
    assert sorted((r.category, r["count"]) for r in tags.category_counts(added).collect()) == [("Uncategorized", 1), ("p", 1), ("q", 1)]
    assert sorted(map(tuple, tags.tag_details(added).collect())) == [("C", "p, q", "No description provided."), ("D", "None", "text")]


def test_range_requests_are_counted_by_date(spark, tmp_path):
    """The day is written after the count, not for each of customers times days; one split is spread over the cores."""
    import __spark_entry__ as entry

    spark.range(200).selectExpr("id as c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.sql("""select id as o_orderkey, id as o_custkey, 'O' as o_orderstatus, '1-URGENT' as o_orderpriority, cast(0 as double) as o_totalprice,
        timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as o_orderdate from range(5)""").write.parquet(str(tmp_path / "orders.parquet"))
    df = entry.queries()["global_range_requests"](spark, str(tmp_path))
    assert {r.day: r.n for r in df.collect()} == {f"202401{d:02d}": 200 for d in range(1, 11)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    groups = [x for x in plan.splitlines() if "Aggregate [" in x and "dt" in x]
    assert groups and not any("date_format" in x.split("], [")[0] for x in groups)
    assert "Repartition" in plan
