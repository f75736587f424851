import hashlib

import pytest

from feedloom.operators import lines
from feedloom.operators.criteria import Criterion, filter_feed, parse_keywords
from feedloom.sources import feeds

FEED = [
    {"ip": "1.1.1.1", "tunnels": [{"type": "VPN", "n": 5}, {"type": "PROXY", "n": 7}], "risk": "LOW", "score": 10},
    {"ip": "2.2.2.2", "tunnels": [{"type": "TOR", "in": {"type": "X"}}], "risk": None, "score": 50.5},
    {"ip": "3.3.3.3", "risk": " none ", "score": "77", "as": {"org_name": "Acme"}, "on": True},
    {"ip": "4.4.4.4", "tunnels": [], "risk": "  ", "score": "n/a", "ports": [80, None, "ssh"], "as_org": {"name": "Acme"}},
    "not json", "[1, 2]", '"text"',
]


@pytest.fixture
def hits(records):
    feed = records(*FEED)

    def run(*criteria, overall="AND"):
        return [r.id + 1 for r in filter_feed(feed, list(criteria), overall).orderBy("id").collect()]

    return run


@pytest.mark.parametrize("key, keywords, want", [
    ("risk", ["low"], [1]),
    ("risk", ["=empty"], [2, 3, 4]),
    ("risk", ["!=empty"], [1]),
    ("risk", ["!low"], [2, 3, 4]),
    ("nowhere", ["=empty"], [1, 2, 3, 4]),
    ("nowhere", ["!x"], [1, 2, 3, 4]),
    ("nowhere", ["x"], []),
    ("score", [">10"], [2, 3]),
    ("score", [">= 10"], [1, 2, 3]),
    ("score", ["<50"], [1]),
    ("score", ["<=50.5"], [1, 2]),
    ("score", ["10"], [1]),
    ("score", ["=77"], [3]),
    ("score", ["!10"], [2, 3, 4]),
    ("score", ["7.7.7"], []),
    ("on", ["true"], [3]),
    ("ports", ["80,none,ssh"], [4]),
    ("as_org_name", ["acme"], [3, 4]),
    ("tunnels_type", ["vpn"], [1]),
    ("tunnels_type", ["tor", "x"], [2]),
    ("tunnels_type", ["!vpn"], [2, 3, 4]),
    ("tunnels_type", ["=empty"], [3, 4]),
    ("tunnels_n", [">6"], []),
    ("tunnels_0_type", ["vpn"], [1]),
    ("tunnels_1_type", ["proxy"], [1]),
    (None, ["2.2.2.2"], [2]),
    (None, ["acme"], [3, 4]),
    (None, ["!acme"], [1, 2]),
    (None, ["5"], []),
])
def test_single_keyword(hits, key, keywords, want):
    assert hits(Criterion(key, keywords)) == want


def test_any_element(hits):
    assert hits(Criterion("tunnels_n", [">6"], any_element=True)) == [1]
    assert hits(Criterion("tunnels_n", ["!>6"], any_element=True)) == [2, 3, 4]
    assert hits(Criterion("tunnels_n", ["=empty"], any_element=True)) == [2, 3, 4]


def test_keyword_and_criterion_combination(hits):
    assert hits(Criterion("tunnels_type", ["vpn", "tor"], "OR")) == [1, 2]
    assert hits(Criterion("tunnels_type", ["vpn", "proxy"])) == [1]
    assert hits(Criterion("score", [">20"]), Criterion("risk", ["=empty"])) == [2, 3]
    assert hits(Criterion("score", ["<20"]), Criterion(None, ["acme"]), overall="OR") == [1, 3, 4]
    assert hits(Criterion("risk", [], "OR")) == []
    assert hits(Criterion("risk", [], "AND")) == [1, 2, 3, 4]


def test_negation_splits_the_records(hits):
    both = hits(Criterion("score", [">20"])) + hits(Criterion("score", ["!>20"]))
    assert sorted(both) == [1, 2, 3, 4]


def test_wildcard_on_any_list(records):
    feed = records({"hops": [{"at": "a"}, {"at": "b"}]}, {"hops": [{"at": "c"}]})
    assert [r.id for r in filter_feed(feed, [Criterion("hops_at", ["b"], wildcard=True)]).collect()] == [0]


def test_key_with_many_readings(records):
    feed = records({"a": {"b_c": {"d": {"e": {"f_g": "hit"}}}}}, {"a_b_c_d_e_f_g": "hit"}, {"a": 1})
    got = filter_feed(feed, [Criterion("a_b_c_d_e_f_g", ["hit"])])
    assert sorted(r.id for r in got.collect()) == [0, 1]


def test_parse_keywords():
    assert parse_keywords(" VPN, ,Tor,") == ["vpn", "tor"]


def test_invalid_combination():
    with pytest.raises(ValueError):
        Criterion("a", ["b"], "XOR")


def test_line_patterns_and_twins(records):
    feed = records('{"country":"KP","services":["TROJAN"]}', '{"country":"kpx","services":["TROJAN","VPN"]}', '{"a":"Malware"}')
    assert [r.id for r in lines.line_filter(feed, lines.MALICIOUS).orderBy("id").collect()] == [0, 1, 2]
    assert [r.id for r in lines.line_filter(feed, lines.COUNTRY_KP).orderBy("id").collect()] == [0, 1]
    assert [r.id for r in lines.line_filter(feed, lines.ONLY_TROJAN).collect()] == [0]
    assert [r.id for r in feed.filter(lines.country_starts("KP")).orderBy("id").collect()] == [0, 1]
    assert [r.id for r in feed.filter(lines.only_service("trojan")).collect()] == [0]
    row = lines.match_counts(feed, {"bad": lines.MALICIOUS, "home": lines.RESIDENTIAL}).first()
    assert (row.lines, row.bad, row.home) == (3, 3, 0)


def test_random_lines(records):
    feed = records(*[{"n": i} for i in range(50)])
    by = {"key": ["id"]}
    drawn = [r.id for r in lines.random_lines(feed, 10, seed=1, **by).collect()]
    assert len(set(drawn)) == 10
    # The same seed draws the same rows from any layout; a larger draw holds the smaller one; other seeds differ.
    again = {r.id for r in lines.random_lines(feed.repartition(7, "raw"), 10, seed=1, **by).collect()}
    larger = {r.id for r in lines.random_lines(feed, 25, seed=1, **by).collect()}
    other = {r.id for r in lines.random_lines(feed, 10, seed=2, **by).collect()}
    assert again == set(drawn) and set(drawn) < larger and other != again
    assert lines.random_lines(feed, 80, **by).select("id").distinct().count() == 50
    assert lines.random_lines(feed, 0, **by).count() == 0 and lines.random_lines(feed.filter("false"), 5, **by).count() == 0
    wanted = sorted(range(50), key=lambda i: (int(hashlib.md5(f"1|{i}".encode()).hexdigest()[:15], 16), i))[:10]
    assert set(drawn) == set(wanted)


def test_first_lines_by_position(spark, tmp_path):
    """Lines of several files over many splits; only the last split that is needed is ordered."""
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k:03}\n" for k in range(200)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        feed = feeds.read_lines(spark, str(tmp_path))
        every = [f"{name}{k:03}" for name in "abc" for k in range(200)]
        for n in (0, 1, 39, 40, 41, 333, 600, 900):
            assert sorted(r.raw for r in lines.first_lines(feed, n).collect()) == every[:n]
        assert lines.first_lines(feed.filter("false"), 5).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
