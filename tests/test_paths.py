"""Key paths against a plain recursive reading of random nested records."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.operators import paths
from feedloom.sources import sinks


def compact(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def indexed(value, path, out):
    if isinstance(value, dict):
        for k, x in value.items():
            indexed(x, f"{path}_{k}" if path else k, out)
    elif isinstance(value, list) and any(isinstance(x, dict) for x in value):
        for i, x in enumerate(value):
            if isinstance(x, dict):
                indexed(x, f"{path}_{i}", out)
            else:
                out.append((f"{path}_{i}", x))
    else:
        out.append((path, value))
    return out


def objects(value, path, out):
    for k, x in value.items():
        here = f"{path}.{k}" if path else k
        if isinstance(x, dict) and x:
            objects(x, here, out)
        else:
            out.append((here, x))
    return out


def walked(value, path, out):
    """Containers and values below `value`, list members under the list's path."""
    members = [(path, x) for x in value] if isinstance(value, list) else [
        (f"{path}.{k}" if path else k, x) for k, x in value.items()
    ]
    for here, x in members:
        if not (isinstance(value, dict) and isinstance(x, list)):
            out.append((here, x))
        if isinstance(x, (dict, list)):
            walked(x, here, out)
    return out


def random_value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.3:
        return {k: random_value(rng, depth - 1) for k in rng.sample("abcdxyz", rng.randint(0, 3))}
    if depth and kind < 0.55:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, 2.5, -7, True, False, None, "", "text", "none", 'q"uote', "1"])


@pytest.fixture(scope="module")
def random_records():
    rng = random.Random(11)
    return [{k: random_value(rng, 8) for k in rng.sample("abcdef", 4)} for _ in range(150)]


@pytest.mark.parametrize("style, brute", [(paths.INDEXED, indexed), (paths.OBJECTS, objects), (paths.WALK, walked)])
@pytest.mark.parametrize("levels", [1, 5])
def test_styles_match_plain_recursion(records, random_records, monkeypatch, style, brute, levels):
    monkeypatch.setattr(paths, "LEVELS", levels)
    rows = paths.leaves(records(*random_records).select("id", "v"), style)
    got = Counter((r.id, r.path, r.text) for r in rows.select("id", "path", F.to_json("v").alias("text")).collect())
    want = Counter((i, p, compact(x)) for i, rec in enumerate(random_records) for p, x in brute(rec, "", []))
    assert got == want


def test_hand_worked_flatten(records):
    df = records({"a": {"b": 1, "c": []}, "l": [{"x": True}, 5, [1, 2]], "s": ["p", None, False], "o": {}, "n": None})
    rows = paths.leaves(df.select("v")).select("path", paths.leaf_value().alias("t")).collect()
    assert {r.path: r.t for r in rows} == {
        "a_b": "1", "a_c": "", "l_0_x": "True", "l_1": "5", "l_2": "[1,2]", "s": "p,None,False", "n": None,
    }


def test_too_deep_raises(records):
    deep = {"k": 1}
    for _ in range(12):
        deep = {"k": deep}
    df = records(deep)
    assert paths.leaves(df.select("v")).first().path.count("k") == 13
    with pytest.raises(Exception, match="nested deeper"):
        paths.leaves(df.select("v"), max_depth=8).collect()


def test_top_level_list_counts_as_records(records):
    rows = paths.observations(records([1, {"k": "x"}, [2]]).select("v")).collect()
    assert sorted((r.path, r.type, r.value) for r in rows) == [
        ("<root>", "number", "1"), ("<root>", "number", "2"), ("k", "string", "x"),
    ]


def test_key_suggestions_and_samples(records):
    df = records({"t": [{"op": "A,B"}, {"op": " C "}], "x": 1}, {"t": [{"op": 7}], "t_op": 3})
    assert {r.key for r in paths.key_suggestions(df).collect()} == {"t_op", "x"}
    assert {r.value for r in paths.value_samples(df, "t_op").collect()} == {"A", "B", "C", "7", "3"}
    assert {r.value for r in paths.value_samples(df, "x").collect()} == {"1"}


def test_wide_matches_leaves(records, random_records):
    df = records(*random_records)
    table = sinks.wide(df.select("id", "v"))
    rows = paths.leaves(df.select("id", "v")).select("id", "path", paths.leaf_value().alias("t")).collect()
    want = {(r.id, r.path): r.t for r in rows}
    got = {(r["id"], c): r[c] for r in table.collect() for c in table.columns if c != "id"}
    assert table.columns[1:] == sorted(table.columns[1:])
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in want.items() if v is not None}


def test_wide_given_columns(records):
    df = records({"a": {"b": 1}, "l": [{"c": "x"}]}, {"a_b": 2, "l": "no list"}, [1])
    rows = sinks.wide(df.select("v"), ["a_b", "l_0_c", "l", "missing"]).collect()
    assert {tuple(r) for r in rows} == {("1", "x", None, None), ("2", None, "no list", None)}


def test_wide_refuses_too_many_columns(records):
    with pytest.raises(ValueError, match="flattened keys"):
        sinks.wide_columns(records({"a": 1, "b": 2, "c": 3}), max_columns=2)


ODD = [
    {"a": 1, "a:b": "x", 'q"uo\\te': [1, {"z,": None}, [2, "]"]], "l": [], "m": ["{", "\\"], "n": [None], "o": {}},
    {"a": {"b": {"c": {"d": {"e": [{"f": 1}, 2]}}}}, "é\u0001": '":\u0001', "l": [{}], "m": [[]]},
    [{"r": 1}, "s"], "text", 5, None, True,
]


@pytest.mark.parametrize("style", [paths.INDEXED, paths.OBJECTS, paths.WALK])
def test_shapes_keep_all_paths(records, style):
    df = records(*[json.dumps(x) for x in ODD]).select("v")
    whole = paths.leaves(df, style).filter(F.col("state") != "json")
    assert {r.path for r in paths.distinct_paths(df, style).collect()} == {r.path for r in whole.select("path").collect()}
    boxes = {(r.path, r.state) for r in paths.leaves(df, style).select("path", "state").collect()}
    assert {(r.path, r.state) for r in paths.leaves(paths.shapes(df), style).select("path", "state").collect()} == boxes


def test_records_of_one_shape_meet_before_they_are_opened(records):
    df = records(*[{"k": i, "t": [{"n": i * 0.5, "s": str(i)}, {"n": None, "s": "x"}]} for i in range(50)])
    assert paths.shapes(df.select("v")).count() == 1
    assert paths.shapes(records("[]", "[1]", "[1,2]", "{}", '{"a":[]}', '{"a":1}').select("v")).count() == 6


def test_leaves_without_containers(records):
    deep = {"x": 1}
    for _ in range(8):
        deep = {"d": [deep, "e"]}
    df = records(deep, {"m": [1, {"q": [2, []]}], "e": {}, "l": []}, '"s"')
    seen = Counter((r.path, r.t) for r in paths.leaves(df.select("v"), paths.WALK).filter("state <> 'json'").select("path", F.to_json("v").alias("t")).collect())
    bare = paths.leaves(df.select("v"), paths.WALK, containers=False).select("path", F.to_json("v").alias("t")).collect()
    assert Counter((r.path, r.t) for r in bare) == seen


def test_leaves_below_a_prefix(records):
    df = records({"t": [{"op": "A"}, {"op": "B"}], "t_op": "C", "x": 1, "tx": {"op": 2}, "u": {"t_": 3}}).select("v")
    assert {r.path for r in paths.leaves(df, prefix="t_").collect()} == {"t_0_op", "t_1_op", "t_op"}
    assert {r.path for r in paths.leaves(df).collect()} == {"t_0_op", "t_1_op", "t_op", "x", "tx_op", "u_t_"}
