"""URL filters: rules by host and path, and a naive Bayes verdict on segmented names for urls that no rule fits.

Host names run words together. A unigram model of the titles of all pages and a Viterbi search split every distinct host label
into its most likely words. A multinomial naive Bayes model over host words and path tokens learns from the urls that a rule
decides and judges the rest. Everything is done once per distinct url.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.llm.common import ascii_lower, prepare, stored

MAX_WORD = 24
# Host labels have at most 63 characters by the DNS rules; what is longer is left whole.
MAX_LABEL = 63
SHORT_WORD = 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for null and for texts without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (
        ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, else null. A rule is (`host/path`, verdict); it fits its host and all
    subdomains if the path starts with the rule's."""
    result = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        result = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(result)
    return result


def word_counts(texts: Column, df: DataFrame) -> DataFrame:
    """(word, n): words of letters in lower case, counted over all rows."""
    words = F.explode(F.regexp_extract_all(F.lower(texts), F.lit(r"(\p{L}+)")))
    return df.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def title_of(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)


def _viterbi(label: str, known: dict[str, float], unknown: float) -> list[str]:
    """Most likely split of a label. A word that is not known costs `unknown` and log 26 for each further character."""
    best, cut = [0.0], [0]
    for end in range(1, len(label) + 1):
        score, start = max(
            (best[s] + known.get(label[s:end], unknown - (end - s) * math.log(26)), s) for s in range(max(0, end - MAX_WORD), end)
        )
        best.append(score)
        cut.append(start)
    words, end = [], len(label)
    while end:
        words.append(label[cut[end] : end])
        end = cut[end]
    return words[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words): the words of every distinct label. `counts` is (word, n); words under three letters need to be frequent
    (a hundredth of a percent) to count as known. Only the substrings of a label that are known words reach its group, so a group
    holds at most MAX_LABEL x MAX_WORD rows. Empty labels and nulls give no rows; longer labels stay whole."""
    total = float(max(counts.agg(F.sum("n")).first()[0] or 0, 1))
    weights = counts.filter((F.length("word") >= SHORT_WORD) | (F.col("n") * 10_000 >= total)).select(
        "word", F.log(F.col("n") / total).alias("weight"), F.lit(-math.log(total)).alias("unknown")
    )
    short = labels.select("label").filter(F.col("label") != "").distinct()
    fitting = short.filter(F.length("label") <= MAX_LABEL)
    start = F.sequence(F.lit(1), F.length("label"))
    pieces = (
        fitting.select("label", F.explode(start).alias("i"))
        .select("label", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("label") - F.col("i") + 1))).alias("k"))
        .select("label", F.substring("label", F.col("i"), F.col("k")).alias("word")).distinct()
    )
    known = pieces.join(weights, "word", "left")

    def split(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["weight"].notna()]
        unknown = float(own["unknown"].iloc[0]) if len(own) else -10.0
        label = group["label"].iloc[0]
        return pd.DataFrame({"label": [label], "words": [_viterbi(label, dict(zip(own["word"], own["weight"])), unknown)]})

    found = known.groupBy("label").applyInPandas(split, "label string, words array<string>")
    return found.union(short.filter(F.length("label") > MAX_LABEL).select("label", F.array("label")))


def path_tokens(path: Column) -> Column:
    """Tokens of a path in lower case; numbers count by their length."""
    raw = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(raw, lambda t: F.when(t.rlike(r"^\d+$"), F.concat(F.lit("#"), F.length(t))).otherwise(t))


def naive_bayes(tokens: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, float]:
    """Weights (token, weight) and the prior: log odds of block against allow, with one added to every count.

    `tokens` is (verdict, token) and `verdicts` is (verdict, n) with the urls of each verdict; the latter is two rows at most.
    """
    urls = {r["verdict"]: r["n"] for r in verdicts.collect()}
    prior = math.log((urls.get("block", 0) + 1) / (urls.get("allow", 0) + 1))
    block, allow = (F.sum((F.col("verdict") == v).cast("bigint")) for v in ("block", "allow"))
    counts = stored(tokens.groupBy("token").agg(block.alias("block"), allow.alias("allow")), "token-counts")
    size = counts.agg(F.count("*").alias("v"), F.sum("block").alias("b"), F.sum("allow").alias("a")).first()
    base = math.log(((size["a"] or 0) + size["v"] + 1) / ((size["b"] or 0) + size["v"] + 1))
    weights = counts.select(
        F.col("token"), (F.log((F.col("block") + 1) / (F.col("allow") + 1)) + base).alias("weight")
    )
    return weights, prior


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_odds) for every row: the verdict is that of the longest rule that fits, else
    that of the naive Bayes model (block if its log odds are above 0).

    A null url has an empty host and path and gets the prior's verdict, as a url without any known token does. Rows that share
    an id or a url are all judged; an empty table gives no rows.
    """
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    urls = (
        pages.select(F.col(url_col).alias("url")).distinct().select("url", bound(host=host, path=path))
        .select("*", bound(fit=matching_rule(F.col("host"), F.col("path"), rules)))
        .select("url", "host", "path", "fit.rule", "fit.verdict")
    )
    urls = stored(urls, "urls")
    labels = urls.select("host").distinct().select("host", F.posexplode(F.split("host", r"[^\p{L}\p{N}]+")).alias("at", "label"))
    labels = labels.filter("label <> ''")
    words = stored(
        segment(labels, stored(word_counts(title_of(F.col(html_col)), pages), "title-words")), "host-words"
    )
    host_tokens = labels.join(words, "label").select("host", F.explode("words").alias("word")).groupBy("host").agg(
        F.collect_list("word").alias("host_words")  # bounded by the length of a host name
    )
    tokens = stored(
        urls.join(host_tokens, "host", "left").select(
            "url", "verdict",
            F.explode(F.concat(F.coalesce("host_words", F.array().cast("array<string>")), path_tokens(F.col("path")))).alias("token"),
        ),
        "url-tokens",
    )
    learnt = tokens.filter("verdict is not null")
    weights, prior = naive_bayes(learnt, urls.filter("verdict is not null").groupBy("verdict").agg(F.count("*").alias("n")))
    odds = (
        tokens.filter("verdict is null").join(stored(weights, "token-weights"), "token")
        .groupBy("url").agg(F.sum("weight").alias("odds"))
    )
    judged = stored(
        urls.join(odds, "url", "left").select(
            "url", "host", "path", "rule",
            F.coalesce("verdict", F.when(F.coalesce("odds", F.lit(0.0)) + prior > 0, "block").otherwise("allow")).alias("verdict"),
            F.when(F.col("rule").isNull(), F.coalesce("odds", F.lit(0.0)) + prior).alias("block_odds"),
        ),
        "judged-urls",
    )
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    return rows.join(judged, rows["url"].eqNullSafe(judged["url"]), "left").select(
        "page_id", "host", "path", "rule", "verdict", "block_odds"
    )
