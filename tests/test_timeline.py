import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from feedloom.operators import timeline as tl


@pytest.fixture
def pair(records):
    def diff(old, new, **kw):
        rows = records({"o": old, "n": new}).select("id", F.expr("v:o").alias("old_v"), F.expr("v:n").alias("new_v"))
        got = tl.deep_diff(rows, **kw).collect()
        load = lambda t: "MISSING" if t is None else json.loads(t)
        return {r.path: (r.change, load(r.old_value), load(r.new_value)) for r in got}

    return diff


def test_deep_diff(pair):
    assert pair({"a": 1}, {"a": 1.0}) == {}
    assert pair({"a": True, "b": None}, {"a": 1}) == {"b": ("removed", None, "MISSING")}
    assert pair({"a": {"b": {"c": 1, "d": 2}}}, {"a": {"b": {"c": 1, "d": 3}}}) == {"a.b.d": ("changed", 2, 3)}
    assert pair({"a": {"b": 1}}, {"a": 5}) == {"a": ("changed", {"b": 1}, 5)}
    assert pair({}, {"x": {"y": {"z": 1}}}) == {"x": ("added", "MISSING", {"y": {"z": 1}})}
    assert pair({"a": None}, {"a": 0}) == {"a": ("changed", None, 0)}
    assert pair({"a": {}}, {"a": {}}) == {}
    assert pair({"a": {}}, {"a": {"k": 1}}) == {"a.k": ("added", "MISSING", 1)}


@pytest.mark.parametrize("old, new, same", [
    ([1, 2], [2, 1], True),
    ([1, 1, 2], [1, 2, 2], False),
    ([1, 2], [1.0, 2], True),
    (["1"], [1], False),
    ([{"a": [1, 2], "b": 1}, 3], [3, {"b": 1, "a": [2, 1]}], True),
    ([{"a": [[1, 2], [3]]}], [{"a": [[3], [2, 1]]}], True),
    ([{"a": [[1, 2], [3]]}], [{"a": [[3], [2, 2]]}], False),
    ([], [], True),
    ([], [None], False),
    ([True], [1], True),
    (["a,b"], ["a", "b"], False),
    ([{"a": "}"}], [{"a": "}", "b": 1}], False),
])
def test_unordered_lists(pair, old, new, same):
    assert pair({"l": old}, {"l": new}) == ({} if same else {"l": ("changed", old, new)})


def settled(x):
    """Members in an order that does not depend on the order of lists, booleans as numbers."""
    if isinstance(x, list):
        return ["list", *sorted((settled(y) for y in x), key=repr)]
    if isinstance(x, dict):
        return {k: settled(x[k]) for k in sorted(x)}
    return float(x) if isinstance(x, (int, float)) else x


def test_random_nested_lists(spark):
    """Against a plain recursive comparison, 30 levels deep, with strings full of signs."""
    draw = random.Random(3)
    words = ["", "a,b", "[", "]}", '"', "\\", "x:1", "\u0011", "é"]

    def value(depth):
        kind = draw.random()
        if depth == 0 or kind < 0.2:
            return draw.choice([1, 1.0, 2.5, -3, True, None, 10**20, *words])
        if kind < 0.7:
            return [value(depth - 1) for _ in range(draw.randrange(1, 4) if depth < 4 else 1)]
        return {draw.choice(words) + str(k): value(depth - 1) for k in range(draw.randrange(3) if depth < 4 else 1)}

    def turned(x):
        if isinstance(x, list):
            return draw.sample([turned(y) for y in x], len(x))
        return {k: turned(y) for k, y in x.items()} if isinstance(x, dict) else x

    rows = []
    for k in range(120):
        old = [value(draw.choice([1, 3, 6, 30])) for _ in range(draw.randrange(4))]
        new = turned(old) if k % 2 else [value(3) for _ in old]
        if k % 4 == 1 and new:
            new[0] = value(2)
        rows.append((k, json.dumps({"l": old}), json.dumps({"l": new})))
    df = spark.createDataFrame(rows, "k int, o string, n string").selectExpr("k", "parse_json(o) as old_v", "parse_json(n) as new_v")
    changed = {r.k for r in tl.deep_diff(df).select("k").collect()}
    wanted = {k for k, o, n in rows if settled(json.loads(o)["l"]) != settled(json.loads(n)["l"])}
    assert changed == wanted and 20 < len(wanted) < 100


def test_deep_levels_and_limit(pair):
    def nest(x, depth):
        for _ in range(depth):
            x = {"k": x}
        return x

    assert pair(nest(1, 9), nest(2, 9)) == {".".join("k" * 9): ("changed", 1, 2)}
    with pytest.raises(Exception, match="nested deeper"):
        pair(nest(1, 9), nest(2, 9), max_depth=2)


DAYS = [
    ("x", "2024-01-01", {"c": {"p": ["a", "b"]}, "n": {"count": 3}}),
    ("x", "2024-01-02", {"c": {"p": ["b", "a"]}, "n": {"count": 5}}),
    ("x", "2024-01-05", {"c": {}, "n": {"count": 5}}),
    ("x", "2024-01-06", {"c": {"p": ["a"]}}),
    ("x", "2024-01-07", {"c": {"p": "a"}}),
    ("y", "2024-01-03", {"c": {"p": ["z", None]}}),
    ("y", "2024-01-04", {}),
    ("w", "2024-01-01", {"c": {"p": ["a"]}}),
    ("w", "2024-01-02", {"c": {"p": ["q"]}}),
]


@pytest.fixture
def series(records):
    rows = records(*[v for _, _, v in DAYS])
    keys = F.element_at(
        F.array(*[F.struct(F.lit(k).alias("ip"), F.lit(t).cast("date").alias("dt")) for k, t, _ in DAYS]), F.col("id") + 1
    )
    flat = rows.select(keys.alias("k"), "v", "id").select("k.ip", "k.dt", "v", "id")
    return tl.daily_series(flat, F.col("id"))


def test_timeline_events(series):
    rows = tl.timeline_events(series).collect()
    got = {(r.ip, r.dt.day, r.event, r.path): (r.old_value, r.new_value) for r in rows}
    assert ("y", 4, tl.FINAL, None) not in got and ("y", 3, tl.INITIAL, None) in got
    assert {k[1] for k in got if k[0] == "x" and k[2] == tl.CHANGE} == {2, 5, 6, 7}
    assert got["x", 2, tl.CHANGE, "n.count"] == ("3", "5")
    assert got["x", 5, tl.CHANGE, "c.p"] == ('["b","a"]', None)
    assert got["x", 6, tl.CHANGE, "n"] == ('{"count":5}', None)
    assert json.loads(got["x", 7, tl.FINAL, None][1]) == DAYS[4][2]


@pytest.mark.parametrize("path, target, want", [
    ("c.p", "a", {("w", "20240101", "20240101"), ("x", "20240101", "20240102"), ("x", "20240106", "Present")}),
    ("c.p", None, {("w", "20240101", "Present"), ("x", "20240101", "20240102"), ("x", "20240106", "Present"), ("y", "20240103", "Present")}),
    ("n.count", 5, {("x", "20240102", "20240105")}),
    ("n.count", "5", {("x", "20240102", "20240105")}),
    ("c.none.deeper", None, set()),
])
def test_presence(series, path, target, want):
    got = {(r.ip, r.start, r.end) for r in tl.presence_intervals(series, path, target).collect()}
    assert got == want


def test_presence_of_listed(spark, series):
    ips = spark.createDataFrame([("x",), ("q",), ("q",)], "ip string")
    got = sorted((r.ip, r.start) for r in tl.presence_intervals(series, "n.count", 3, ips).collect())
    assert got == [("q", None), ("x", "20240101")]


@pytest.mark.parametrize("value, path, want", [
    ({"a": [{"b": 1}, {"b": [2, 3]}, 4, {"c": 5}]}, "a.b", [1, 2, 3]),
    ({"a": [{"c": 5}]}, "a.b", None),
    ({"a": [{"b": {"c": 1}}, {"b": [{"c": 2}]}]}, "a.b.c", [1, 2]),
    ({"a": {"b": None}}, "a.b", None),
    ({"a": 5}, "a.b", None),
    ({"a": {"b": False}}, "a.b", False),
])
def test_value_at(records, value, path, want):
    got = records(value).select(F.to_json(tl.value_at("v", path)).alias("j")).first().j
    assert (None if got is None else json.loads(got)) == want


def test_list_and_count_delta(spark):
    df = spark.createDataFrame([('["a","a b",1]', '["a b",{"k":[2,1]},"c"]'), ("[1,1]", "[1]")], "o string, n string")
    rows = df.select(*[c.alias(n) for n, c in tl.list_delta("o", "n").items()]).collect()
    assert (rows[0].added, rows[0].removed) == (['"c"', '{"k":[1,2]}'], ["1", '"a"'])
    assert (rows[1].added, rows[1].removed) == ([], [])
    df = spark.createDataFrame([("n.count", "3", "5"), ("n.count", "5", "2"), ("n.count", "1.5", "2"), ("count", "1", "2")], "p string, o string, n string")
    rows = df.select(*tl.count_delta(F.col("p"), F.col("o"), F.col("n")).values()).collect()
    assert [tuple(r) for r in rows] == [(2, "up"), (-3, "down"), (None, None), (None, None)]


def test_parse_target():
    assert tl.parse_target(" ") is None and tl.parse_target("NULL") is None and tl.parse_target(None) is None
    assert tl.parse_target("true") is True and tl.parse_target("5") == 5 and tl.parse_target("a b") == "a b"


def test_hot_key_days_are_bounded(records):
    """Many records of one ip on few days leave one row per day for the windows."""
    rows = records(*[{"n": i} for i in range(500)])
    flat = rows.select(F.lit("hot").alias("ip"), F.expr("date_add(date'2024-01-01', id % 3)").alias("dt"), "v", "id")
    got = tl.daily_series(flat, F.col("id")).orderBy("dt").collect()
    assert [r.dt for r in got] == [date(2024, 1, d) for d in (1, 2, 3)]


@pytest.mark.parametrize("old, new, same", [
    ([[1, 2], [3]], [[3], [2, 1]], True),
    ([[1, 2], [3]], [[1, 3], [2]], False),
    ([{"a": "x"}, {"b": "y"}], [{"a": "y"}, {"b": "x"}], False),
    ([1, 1, 2], [2, 2, 1], False),
    ([1, True], [1.0, 1], True),
    (["a]", "b"], ["b", "a]"], True),
])
def test_lists_of_the_same_tokens(spark, pair, old, new, same):
    assert (pair({"l": old}, {"l": new}) == {}) is same
    texts = [json.dumps(x, separators=(",", ":"), sort_keys=True) for x in (old, new)]
    row = spark.createDataFrame([tuple(texts)], "o string, n string").select(tl.bag_differs("o", "n").alias("d")).first()
    assert not (row.d and same)


def test_list_texts_are_computed_once(records):
    rows = records({"o": {"l": [1]}, "n": {"l": [2]}}).select("id", F.expr("v:o").alias("old_v"), F.expr("v:n").alias("new_v"))
    plan = tl.deep_diff(rows)._jdf.queryExecution().optimizedPlan().toString()
    # The settling of lists reads bound texts: no filter turns values into text again.
    assert not [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Filter") and "to_json" in x.lower()]
