"""The criteria language: keyword, numeric and emptiness tests compiled to one boolean Column."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field as dc_field
from functools import partial, reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.sqltext import as_array, as_object, field, literal, stripped
from feedloom.functions.text import strip
from feedloom.functions.values import NUMBER_PATTERN, leaf_text
from feedloom.operators.paths import candidate_paths, checked_text, direct_leaf, entry_text, has_object, subtree_sql

# Fixed value: the list whose members are always searched together.
WILDCARD_ROOT = "tunnels"
# Texts that stand for "no value".
ABSENT = ["none", "null"]
_ABSENT_SQL = ", ".join(map(literal, ABSENT))

_NUMERIC = re.compile(r"([<>]?=?)\s*(-?\d+(?:\.\d+)?)")
_COMPARE = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    "": lambda a, b: a == b,
}


@dataclass(frozen=True)
class Criterion:
    """Keywords tested on one flattened key, or on the whole line when `key` is None.

    match: AND / OR over the keywords. wildcard: search `root_sub` in every member of the list
    `root` (always on for the fixed wildcard root). any_element: test the members one by one
    instead of their comma-joined text, which lets numeric keywords work on several members.
    """

    key: str | None
    keywords: list[str] = dc_field(default_factory=list)
    match: str = "AND"
    wildcard: bool = False
    any_element: bool = False

    def __post_init__(self):
        if self.match not in ("AND", "OR"):
            raise ValueError(f"match must be AND or OR, not {self.match!r}")


def parse_keywords(text: str) -> list[str]:
    """Comma-separated user text to keywords: lower case, blanks dropped."""
    return [k.strip().lower() for k in text.split(",") if k.strip()]


def _roots(key: str, v: str) -> list[tuple[str, str]]:
    """Top-level members the flattened key may start in: `a_b` is `a` -> `b`, or a member named `a_b`."""
    parts = key.split("_")
    names = ["_".join(parts[: i + 1]) for i in range(len(parts))]
    return [(name, field(v, name)) for name in names if name]


def _keyed_value(key: str, v: str) -> Column:
    """Text of one flattened key, read at the places the key may stand for.

    Keys with very many readings open the members on their path instead.
    """
    places = candidate_paths(key)
    if places is None:
        on_path = f"(n.path = {literal(key)} or startswith({literal(key)}, concat(n.path, '_')))"
        hits = f"filter({subtree_sql(_roots(key, v), on_path)}, h -> h.path = {literal(key)})"
        texts = f"transform({hits}, h -> {entry_text('h')})"
    else:
        # In member order, so that the last reading present is the one that counts.
        texts = []
        for member, run in groupby(places, lambda p: not p.endswith('"]')):
            if member:
                texts.append(f"array({', '.join(checked_text(*direct_leaf(v, p), True) for p in run)})")
            else:
                plain = ", ".join(direct_leaf(v, p)[0] for p in run)
                texts.append(f"transform(array({plain}), x -> {checked_text('x', 'null', False)})")
        texts = texts[0] if len(texts) == 1 else f"concat({', '.join(texts)})"
    texts = f"filter(transform({texts}, t -> lower({stripped('t')})), t -> t not in ({_ABSENT_SQL}))"
    return F.expr(f"try_element_at({texts}, -1)")


def _wildcard_values(key: str, v: str) -> Column:
    """Texts of all flattened keys `root_..._sub`; NULL when no such key exists.

    A list of objects without further objects inside is read directly, anything else is flattened.
    """
    root, _, sub = key.partition("_")
    suffix = literal("_" + sub)
    tree = subtree_sql([(root, field(v, root))], None)
    hit = f"startswith(h.path, {literal(root + '_')}) and endswith(h.path, {suffix})"
    general = f"transform(filter({tree}, h -> {hit}), h -> {entry_text('h')})"
    members = as_array(field(v, root))
    nested = f"exists(map_values({as_object('m')}), x -> {as_object('x')} is not null or coalesce({has_object('x')}, false))"
    simple = f"forall(l, m -> {as_object('m')} is not null and not {nested})"
    named = f"endswith(concat('_', cast(i as string), '_', k), {suffix})"
    direct = f"flatten(transform(l, (m, i) -> map_values(map_filter({as_object('m')}, (k, x) -> {named}))))"
    direct = f"transform({direct}, x -> {leaf_text('x')})"
    texts = f"transform(array({members}), l -> if(coalesce({simple}, false), {direct}, {general}))[0]"
    keep = f"filter(t, x -> x is not null and lower({stripped('x')}) not in ({_ABSENT_SQL}))"
    return F.expr(f"transform(array({texts}), t -> if(size(t) = 0, null, {keep}))[0]")


def _test(text: Column, word: str) -> Column:
    """One keyword without its negation against one text; a missing or empty text is only empty."""
    blank = F.coalesce(strip(text), F.lit("")) == ""
    numeric = _NUMERIC.fullmatch(word)
    if word == "=empty":
        return blank
    if word == "!=empty":
        return ~blank
    if numeric:
        # Guarded cast: only plain decimal text is a number.
        number = F.when(strip(text).rlike(NUMBER_PATTERN), strip(text).try_cast("double"))
        hit = _COMPARE[numeric.group(1)](number, F.lit(float(numeric.group(2))))
    else:
        hit = F.contains(F.lower(text), F.lit(word)) & (text != "")
    return F.coalesce(hit, F.lit(False))


def _keyword(keyword: str, apply: Callable[[str], Column]) -> Column:
    """Apply a keyword, turning a leading `!` into negation: what is missing satisfies a negated keyword."""
    if keyword.startswith("!") and keyword != "!=empty":
        return ~apply(keyword[1:])
    return apply(keyword)


def _combine(tests: list[Column], match: str) -> Column:
    if match == "AND":
        return reduce(lambda a, b: a & b, tests, F.lit(True))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _criterion(c: Criterion, v: str, raw: str) -> Column:
    words = [k.lower() for k in c.keywords]

    def on_text(text: Column) -> Column:
        return _combine([_keyword(w, partial(_test, text)) for w in words], c.match)

    if not c.key:
        return on_text(F.lower(F.col(raw)))
    # A one-element array binds the text once, so that each keyword does not open the record again.
    if not (c.wildcard or c.key.startswith(WILDCARD_ROOT + "_")):
        return F.exists(F.array(_keyed_value(c.key, v)), on_text)
    values = _wildcard_values(c.key, v)
    if not c.any_element:
        return F.exists(F.array(F.array_join(values, ",")), on_text)
    # A record without values is tested once, as missing.
    missing = F.array(F.lit(None).cast("string"))
    members = F.transform(F.array(values), lambda t: F.when(F.size(t) > 0, t).otherwise(missing))

    def on_members(texts: Column) -> Column:
        def any_member(word: str) -> Column:
            test = F.forall if word == "=empty" else F.exists
            return test(texts, lambda m: _test(m, word))

        return _combine([_keyword(w, any_member) for w in words], c.match)

    return F.exists(members, on_members)


def compile_criteria(criteria: list[Criterion], overall: str = "AND", v: str = "v", raw: str = "raw") -> Column:
    """Criteria as one boolean Column over a parsed feed; lines that are not objects never match."""
    if overall not in ("AND", "OR"):
        raise ValueError(f"overall must be AND or OR, not {overall!r}")
    is_record = F.col(v).isNotNull() & strip(F.col(raw)).startswith("{")
    return is_record & F.coalesce(_combine([_criterion(c, v, raw) for c in criteria], overall), F.lit(False))


def filter_feed(df: DataFrame, criteria: list[Criterion], overall: str = "AND") -> DataFrame:
    """Matching lines of a parsed feed; no criteria keep everything."""
    return df.filter(compile_criteria(criteria, overall)) if criteria else df
