import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import forensics, snapshots
from feedloom.operators.grouping import duplicate_audit, last_per_key, top_per_group

OLD = {
    "a": {"ip": "a", "Timestamp": "20240101", "s": "x", "n": 1, "l": [1, 2], "o": {"p": 1, "q": 2}, "gone": "y", "z": None, "t": "[1]"},
    "b": {"IP": "b", "timestamp": "20240102", "k": True},
    "c": {"ip": "c", "only": "old"},
    "d": {"ip": "d", "same": 0},
}
NEW = {
    "a": {"ip": "a", "s": "x", "n": 1.0, "l": [2, 1], "o": {"q": 2, "p": 1}, "fresh": [0], "t": [1]},
    "b": {"ip": "b", "k": 1},
    "d": {"ip": "d", "same": False, "none": None},
    "e": {"ip": "e", "Timestamp": "own"},
    "f": {"ip": "f", "v": 1},
}


@pytest.fixture
def side(records):
    def build(data):
        rows = records(*data.values())
        names = list(data)
        return rows.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("id") + 1).alias("ip"), "v")

    return build


def test_diff_rows(side):
    diff = snapshots.diff_records(side(OLD), side(NEW))
    status = {r.ip: r.status for r in diff.collect()}
    assert status == {"a": "MODIFIED", "b": "UNCHANGED", "c": "REMOVED", "d": "UNCHANGED", "e": "ADDED", "f": "ADDED"}
    rows = {r.ip: r for r in snapshots.diff_rows(diff, "20240201").collect()}
    assert set(rows) == {"a", "c", "e", "f"}
    a = rows["a"]
    assert a.historic_date == "20240101"
    assert json.loads(a.changes) == {
        "l": {"old": [1, 2], "new": [2, 1]}, "gone": {"old": "y", "new": None}, "fresh": {"old": None, "new": [0]},
        "t": {"old": "[1]", "new": [1]},
    }
    assert json.loads(a.unchanged) == {"s": "x", "n": 1, "o": {"p": 1, "q": 2}, "z": None}
    assert json.loads(rows["c"].data) == OLD["c"]
    assert json.loads(rows["e"].data) == {"ip": "e", "Timestamp": "own"}
    assert json.loads(rows["f"].data) == {"ip": "f", "v": 1, "Timestamp": "20240201"}


def test_attribute_counts_and_summary(side):
    diff = snapshots.diff_records(side(OLD), side(NEW))
    counts = {r.attribute: (r.changed, r.gained, r.lost) for r in snapshots.attribute_counts(diff).collect()}
    assert counts == {"l": (1, 0, 0), "gone": (1, 0, 1), "fresh": (1, 1, 0), "t": (1, 0, 0)}
    row = snapshots.diff_summary(diff).first()
    assert (row.historic, row.current, row.unchanged, row.modified, row.removed, row.added) == (4, 5, 2, 1, 1, 2)
    assert (row.current_richer, row.historic_richer) == (1, 1)
    assert (row.modified_pct_historic, row.added_pct_current) == (25.0, 40.0)


def test_diff_with_itself_is_unchanged(side):
    diff = snapshots.diff_records(side(NEW), side(NEW))
    assert {r.status for r in diff.collect()} == {"UNCHANGED"}


def test_empty_side(side):
    nothing = side(NEW).filter("ip = 'none'")
    row = snapshots.diff_summary(snapshots.diff_records(nothing, nothing)).first()
    assert row.historic == 0 and row.unchanged_pct_historic == 0.0


def test_last_per_key_ignores_input_order(spark):
    rows = [(k, i, f"{k}{i}") for k in "ab" for i in range(50)]
    for seed in (1, 2, 3):
        df = spark.createDataFrame(rows, "k string, s int, v string").orderBy(F.rand(seed)).repartition(seed * 3)
        got = last_per_key(df, ["k"], F.col("s"))
        assert sorted((r.k, r.v) for r in got.collect()) == [("a", "a49"), ("b", "b49")]


@pytest.mark.parametrize("bits", [0, 2, 20])
def test_duplicate_audit_across_chunks(spark, bits):
    """A hot key that holds most rows: the chunk size must not change the counts."""
    rows = [("hot" if i % 5 else "cold", i, i // 7 % 3) for i in range(200)]
    held, same, other = {}, 0, 0
    for k, _, v in rows:
        if k in held:
            same, other = (same + 1, other) if held[k] == v else (same, other + 1)
        held[k] = v
    df = spark.createDataFrame(rows, "k string, s bigint, v int").repartition(7)
    got = duplicate_audit(df, "k", F.col("v"), F.col("s"), [F.shiftright("s", bits)]).first()
    assert (got.identical, got.conflicting) == (same, other)


def test_top_per_group_with_a_hot_group(spark):
    rows = [("hot", i, i * 37 % 1000) for i in range(1000)] + [("cold", 1, 5)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    got = top_per_group(df, ["g"], [F.col("n").desc()], 3, ["i"]).collect()
    assert sorted((r.g, r.rank, r.n) for r in got) == [("cold", 1, 5), ("hot", 1, 999), ("hot", 2, 998), ("hot", 3, 997)]


HISTORY = [
    ("a", "20240101", {"ip": "a", "x": 1, "risk": "high", "gone": "z"}),
    ("a", "20240102", {"ip": "a", "x": 1, "risk": "low", "Timestamp": "t"}),
    ("b", "20240101", {"ip": "b", "x": [1]}),
    ("d", "20240101", {"ip": "d", "x": None, "y": "k"}),
    ("d", "20240102", {"ip": "d", "y": "k"}),
]
CURRENT = {"a": {"ip": "a", "x": 1, "risk": None, "new": {"p": 1}}, "c": {"ip": "c", "x": 2}, "d": {"ip": "d", "y": "k"}}


@pytest.fixture
def sides(records, side):
    rows = records(*[v for _, _, v in HISTORY])
    keys = F.element_at(F.array(*[F.struct(F.lit(k).alias("ip"), F.lit(t).alias("ts")) for k, t, _ in HISTORY]), F.col("id") + 1)
    return rows.select(keys.alias("k"), "v").select("k.ip", "k.ts", "v"), side(CURRENT)


def test_forensic_states(sides):
    status = {r.ip: (r.status, r.dates) for r in forensics.key_status(*sides).collect()}
    assert status == {"a": ("CONTINUOUS", 2), "b": ("AGED_OUT", 1), "c": ("EMERGING", 0), "d": ("CONTINUOUS", 2)}
    got = {
        (r.ip, r.attribute): "".join(f for f, on in zip("cmte", (r.changed, r.multi_stage, r.transient, r.escalating)) if on)
        for r in forensics.attribute_states(*sides).collect()
    }
    assert got == {
        ("a", "x"): "", ("a", "risk"): "cmt", ("a", "gone"): "cmt", ("a", "new"): "ce", ("d", "x"): "", ("d", "y"): "",
    }


def test_forensic_summary_and_counts(sides):
    row = forensics.forensic_summary(*sides).first()
    assert (row.pool, row.continuous, row.aged_out, row.emerging) == (4, 2, 1, 1)
    assert (row.transient, row.multi_stage, row.escalating) == (1, 1, 1)
    assert (row.continuous_pct, row.transient_pct) == (50.0, 50.0)
    counts = forensics.forensic_attribute_counts(forensics.attribute_states(*sides)).collect()
    assert sorted((r.attribute, r.aged_out, r.new_current) for r in counts) == [("gone", 1, 0), ("new", 0, 1), ("risk", 1, 0)]


def test_forensic_rows(sides):
    rows = forensics.forensic_rows(*sides, "20240201").collect()
    timeline = {(r.attribute, r.ts): r.value for r in rows if r.section == "timeline"}
    assert timeline == {
        ("risk", "20240101"): '"high"', ("risk", "20240102"): '"low"', ("gone", "20240101"): '"z"',
        ("gone", "20240102"): "null", ("new", "20240101"): "null", ("new", "20240102"): "null",
    }
    assert {(r.ip, r.section) for r in rows if r.status != "CONTINUOUS"} == {("b", "history"), ("c", "data")}
    assert json.loads(next(r.value for r in rows if r.ip == "c")) == {"Timestamp": "20240201", "ip": "c", "x": 2}
    assert {(r.ip, r.attribute) for r in rows if r.section == "unchanged"} == {("a", "x"), ("d", "x"), ("d", "y")}


def test_nested_history_keeps_every_row(sides):
    rows = forensics.forensic_rows(*sides, "20240201")
    for size in (1, 1000):
        lines = [json.loads(r.line) for r in forensics.nested_history(rows, size).collect()]
        assert sum(len(x["rows"]) for x in lines) == rows.count()
