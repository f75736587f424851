import itertools
import math

import pytest
from pyspark.sql import functions as F

from feedloom.llm import urlfilter

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


@pytest.mark.parametrize("url,host,path,rule", [
    ("http://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/"),
    ("https://x.org", "x.org", "", None), ("https://x.org?a/b", "x.org", "", None), ("https://x.com/fr/#://", "x.com", "/fr/", "com/fr/"),
    ("x.org/a", "", "", None), (None, "", "", None), ("", "", "", None), ("a://b://c/d", "b:", "//c/d", None), ("://com/de/", "com", "/de/", "com/de/"),
])
def test_parse_and_rules(spark, url, host, path, rule):
    h, p = urlfilter.host_and_path(F.col("url"))
    df = spark.createDataFrame([(url,)], "url string").select(h.alias("h"), p.alias("p"))
    row = df.select("h", "p", urlfilter.matching_rule(F.col("h"), F.col("p"), RULES).alias("r")).first()
    assert (row["h"], row["p"], row["r"] and row["r"]["rule"]) == (host, path, rule)


def test_viterbi_against_all_splits():
    known = {w: math.log(n / 100) for w, n in {"the": 40, "them": 5, "men": 20, "me": 10, "n": 3, "theme": 2}.items()}
    unknown = math.log(1 / 100)
    label = "themen"
    score = lambda ws: sum(known.get(w, unknown - len(w) * math.log(26)) for w in ws)
    splits = []
    for cuts in itertools.product((0, 1), repeat=len(label) - 1):
        places = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(label)]
        splits.append([label[a:b] for a, b in zip(places, places[1:])])
    assert score(urlfilter._viterbi(label, known, unknown)) == pytest.approx(max(map(score, splits)))


def test_naive_bayes_against_python(spark):
    rows = [("block", "win"), ("block", "win"), ("allow", "news"), ("allow", "win"), ("allow", "home")]
    verdicts = spark.createDataFrame([("block", 2), ("allow", 3)], "verdict string, n bigint")
    weights, prior = urlfilter.naive_bayes(spark.createDataFrame(rows, "verdict string, token string"), verdicts)
    got = {r["token"]: r["weight"] for r in weights.collect()}
    assert prior == pytest.approx(math.log(3 / 4))
    assert got["win"] == pytest.approx(math.log((3 / (2 + 4)) / (2 / (3 + 4))))
    assert got["news"] == pytest.approx(math.log((1 / 6) / (2 / 7)))


def test_spam_names_are_learnt(spark):
    title = "<title>casino win the free bets news home garden</title>"
    rows = [(k, f"http://{'casinowin' if k % 2 else 'homegarden'}{k}.com/{'de' if k % 2 else 'fr'}/{k}", title) for k in range(40)]
    rows += [(100, "http://freecasinowin.net/en/1", title), (101, "http://newshomegarden.net/en/1", None), (102, None, title), (102, None, title)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in urlfilter.judge_urls(df, RULES).collect()}
    assert got[100]["verdict"] == "block" and got[101]["verdict"] == "allow" and got[102]["host"] == ""
    assert urlfilter.judge_urls(df, RULES).count() == len(rows)
    assert urlfilter.judge_urls(df.filter("false"), RULES).count() == 0


def test_long_labels_and_extra_columns(spark):
    rows = [(1, "http://" + "a" * 70 + ".net/x", None, "h", "t"), (2, "http://-._/", "", "h", "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, token string")
    assert {r["verdict"] for r in urlfilter.judge_urls(df, RULES).collect()} == {"allow"}
