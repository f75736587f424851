"""Key paths of nested records.

Nested values are opened level by level with `variant_explode_outer`: generators in one stage, no
shuffle and no action. The first LEVELS levels cover ordinary feeds; a row that is still open after
them is finished by a row-local higher-order loop, so depth is not limited. A record deeper than
`max_depth` raises instead of losing values.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.bind import bound
from feedloom.functions.sqltext import PLAIN_KEY, as_array, as_object, literal
from feedloom.functions.text import strip
from feedloom.functions.values import CONTAINER, STRING, json_text, kind, leaf_text, number_text, scalar_text, scalar_type

LEVELS = 3
MAX_DEPTH = 64

INDEXED, OBJECTS, WALK = "indexed", "objects", "walk"

# States of a row while paths are opened. `leaf` is final, `member` is a final list member that
# prints as JSON, `json` a recorded container. When walking, a `field` is recorded unless it is a list, an `item` always, the
# `root` only if it is a scalar; recorded containers are opened as well.
OPEN, LEAF, MEMBER, FIELD, ITEM, ROOT = "open", "leaf", "member", "field", "item", "root"


def _entry(path: str, v: str, state: str) -> str:
    return f"struct({path} as path, {v} as v, {state} as state)"


def has_object(v: str) -> str:
    return f"exists({as_array(v)}, x -> {as_object('x')} is not null)"


def _joined(parent: str, sep: str, name: str) -> str:
    return f"if({parent} = '', {name}, concat({parent}, '{sep}', {name}))"


def _open_indexed(prune: str | None) -> str:
    """Underscore paths; a list without objects is one leaf, any other list is indexed."""
    children = (
        f"transform(map_entries({as_object('e.v')}), c -> "
        + _entry(_joined("e.path", "_", "c.key"), "c.value", f"'{OPEN}'")
        + ")"
    )
    members = (
        f"if({has_object('e.v')}, transform({as_array('e.v')}, (x, i) -> "
        + _entry("concat(e.path, '_', cast(i as string))", "x", f"if({as_object('x')} is null, '{MEMBER}', '{OPEN}')")
        + "), null)"
    )
    if prune:
        children = f"filter({children}, n -> {prune})"
        members = f"filter({members}, n -> {prune})"
    return f"coalesce({children}, {members}, array({_entry('e.path', 'e.v', repr(LEAF))}))"


def _open_objects() -> str:
    """Dotted paths through objects only; lists and empty objects are leaves."""
    obj = as_object("e.v")
    children = f"if(size({obj}) > 0, transform(map_entries({obj}), c -> "
    children += _entry(_joined("e.path", ".", "c.key"), "c.value", f"'{OPEN}'") + "), null)"
    return f"coalesce({children}, array({_entry('e.path', 'e.v', repr(LEAF))}))"


def _open_walk() -> str:
    """Dotted paths with list members under the list's own path."""
    obj, arr = as_object("e.v"), as_array("e.v")
    self_leaf, itself = _entry("e.path", "e.v", f"'{LEAF}'"), _entry("e.path", "e.v", f"'{CONTAINER}'")
    fields = f"concat(if(e.state = '{ROOT}', array(), array({itself})), transform(map_entries({obj}), c -> "
    fields += _entry(_joined("e.path", ".", "c.key"), "c.value", f"'{FIELD}'") + "))"
    items = f"concat(if(e.state = '{ITEM}', array({itself}), array()), transform({arr}, x -> "
    items += _entry("e.path", "x", f"'{ITEM}'") + "))"
    return f"coalesce({fields}, {items}, array({self_leaf}))"


_OPEN_BY_STYLE = {INDEXED: lambda: _open_indexed(None), OBJECTS: _open_objects, WALK: _open_walk}


_FINAL = f"('{LEAF}', '{MEMBER}', '{CONTAINER}')"


def _loop(start: str, opened: str, max_depth: int) -> str:
    step = (
        f"transform(array(flatten(transform(acc.es, e -> if(e.state in {_FINAL}, array(e), {opened})))), "
        f"n -> struct(n as es, exists(n, x -> x.state not in {_FINAL}) as more))[0]"
    )
    finish = (
        "r -> if(r.more, raise_error("
        f"'record nested deeper than {max_depth} levels; pass a larger max_depth'), r.es)"
    )
    return (
        f"aggregate(sequence(1, {max_depth + 1}), struct({start} as es, true as more), "
        f"(acc, i) -> if(acc.more, {step}, acc), {finish})"
    )


def subtree_sql(roots: list[tuple[str, str]], prune: str | None, max_depth: int = MAX_DEPTH) -> str:
    """SQL text: indexed entries below the given (path, VARIANT expression) roots only."""
    start = ", ".join(_entry(literal(path), v, f"'{OPEN}'") for path, v in roots)
    return _loop(f"filter(array({start}), s -> s.v is not null)", _open_indexed(prune), max_depth)


def entries_sql(v: str, max_depth: int = MAX_DEPTH) -> str:
    """SQL text: indexed entries of a whole record, for use inside one row."""
    return _loop(f"array({_entry(repr(str()), v, repr(OPEN))})", _open_indexed(None), max_depth)


def entry_text(e: str) -> str:
    """SQL text: text of an entry or leaf row; a list inside a mixed list prints as JSON."""
    return f"if({e}.state = '{MEMBER}', {scalar_text(f'{e}.v')}, {leaf_text(f'{e}.v')})"


def candidate_paths(key: str, limit: int = 32) -> list[str] | None:
    """VARIANT paths that an underscore key may stand for, or None if there are more than `limit`.

    Every underscore may separate two members or belong to a name; digits may be a list index.
    """
    found = [[]]
    parts = key.split("_")
    if not all(PLAIN_KEY.fullmatch(p) for p in parts):
        return None
    for i, part in enumerate(parts):
        grown = []
        for steps in found:
            if i and isinstance(steps[-1], str):
                grown.append([*steps[:-1], f"{steps[-1]}_{part}"])
            grown.append([*steps, part])
            if i and part.isdigit() and str(int(part)) == part:
                grown.append([*steps, int(part)])
        found = grown
        if len(found) > limit:
            return None
    places = ["$" + "".join(f"[{s}]" if isinstance(s, int) else f'["{s}"]' for s in steps) for steps in found]
    return sorted(places, key=reading_order)


def reading_order(place: str) -> list[tuple]:
    """Sort key of a VARIANT path: the order in which a record with its members in name order is read."""
    steps = re.findall(r'\["([^"]*)"\]|\[(\d+)\]', place)
    return [(1, 0, name) if name else (0, int(index or 0), "") for name, index in steps]


def direct_leaf(v: str, path: str) -> tuple[str, str]:
    """SQL text: (value, parent list or null) at a VARIANT path, for `checked_text`."""
    value = f"try_variant_get({v}, '{path}', 'variant')"
    if not re.search(r"\[\d+\]$", path):
        return value, "null"
    return value, f"try_variant_get({v}, '{path[: path.rindex('[')]}', 'array<variant>')"


def checked_text(x: str, parent: str, is_member: bool) -> str:
    """SQL text: leaf text of a directly read value, NULL where flattening would not end there."""
    if is_member:
        mixed = f"exists({parent}, m -> {as_object('m')} is not null)"
        return f"if({as_object(x)} is null and {mixed}, {scalar_text(x)}, null)"
    return f"case when {as_object(x)} is not null or {has_object(x)} then null else {leaf_text(x)} end"


def _level(df: DataFrame, style: str, keep: list[str], places: bool, containers: bool) -> DataFrame:
    """Open every row that is still open by one level; all other rows pass through."""
    obj, arr = f"{as_object('_v')} is not null", f"{as_array('_v')} is not null"
    if style == WALK:
        opens = f"_state not in {_FINAL} and ({obj} or {arr})"
        if containers:
            # A recorded container goes on twice: once as itself, once to be opened.
            recorded = f"_state = '{ITEM}' and ({obj} or {arr}) or _state = '{FIELD}' and {obj}"
            df = df.select("*", F.expr(f"explode(if({recorded}, array(true, false), array(false)))").alias("_self"))
            opens = f"not _self and {opens}"
    elif style == OBJECTS:
        opens = f"_state = '{OPEN}' and size({as_object('_v')}) > 0"
    else:
        opens = f"_state = '{OPEN}' and ({obj} or {arr} and {has_object('_v')})"
    # A value is opened or passed on; the members of an opened one do not carry it along.
    df = df.withColumn("_opens", F.expr(f"coalesce({opens}, false)"))
    df = df.withColumns({"_w": F.expr("if(_opens, _v, null)"), "_v": F.expr("if(_opens, null, _v)")})
    inner = df.sparkSession.tvf.variant_explode_outer(F.col("_w").outer()).alias("_t")
    # An opened container without members ends here.
    rows = df.lateralJoin(inner).filter("_t.pos is not null or not _opens")
    child = "_t.pos is not null"
    if style == WALK:
        path = f"if(_t.key is null, _path, {_joined('_path', '.', '_t.key')})"
        state = f"if(_t.key is null, '{ITEM}', '{FIELD}')"
        ended = "_path"
        final = f"case when _state in {_FINAL} then _state {f"when _self then '{CONTAINER}'" if containers else ''} else '{LEAF}' end"
    else:
        sep = "." if style == OBJECTS else "_"
        path = _joined("_path", sep, "coalesce(_t.key, cast(_t.pos as string))")
        state = f"if(_t.key is null and {as_object('_t.value')} is null, '{MEMBER}', '{OPEN}')"
        ended = "_path"
        final = f"if(_state = '{MEMBER}', _state, '{LEAF}')"
    place = "concat(_place, if(_t.key is null, concat('[', _t.pos, ']'), concat('[\"', _t.key, '\"]')))"
    return rows.select(
        *keep,
        *([F.expr(f"if({child}, {place}, _place)").alias("_place")] if places else []),
        F.expr(f"if({child}, {path}, {ended})").alias("_path"),
        F.expr(f"if({child}, _t.value, _v)").alias("_v"),
        F.expr(f"if({child}, {state}, {final})").alias("_state"),
    )


def leaves(
    df: DataFrame, style: str = INDEXED, v: str = "v", max_depth: int = MAX_DEPTH, places: bool = False, containers: bool = True,
    prefix: str | None = None,
) -> DataFrame:
    """One row per leaf: the other columns of `df`, then `path`, `v` (VARIANT) and `state`.

    places: also give `place`, the VARIANT path the leaf was read at, NULL below LEVELS.

    indexed: underscore paths, list indexes as path parts. objects: dotted paths, lists are leaves.
    prefix: only leaves whose path may start with it; others are dropped on the way where their path tells.

    walk: dotted paths, every container and value recorded, list members under the list's path. Without `containers`, values only.
    """
    keep = [c for c in df.columns if c != v]
    first = ROOT if style == WALK else OPEN
    # The walk counts the members of a top-level list as records of their own.
    root = F.explode(F.expr(f"coalesce({as_array(v)}, array({v}))")) if style == WALK else F.col(v)
    rows = df.select(*keep, F.lit("").alias("_path"), root.alias("_v"), F.lit(first).alias("_state"))
    if places:
        rows = rows.withColumn("_place", F.lit("$"))
    rows = rows.filter(F.col("_v").isNotNull() if style == WALK else F.expr(f"{as_object('_v')} is not null"))
    for _ in range(min(LEVELS, max_depth)):
        rows = _level(rows, style, keep, places, containers)
        if prefix:
            rows = rows.filter(F.col("_path").startswith(prefix) | F.lit(prefix).startswith(F.col("_path")))
    deeper = _loop(f"array({_entry('_path', '_v', '_state')})", _OPEN_BY_STYLE[style](), max(max_depth - LEVELS, 0))
    scalar = f"{as_object('_v')} is null and {as_array('_v')} is null"
    itself = _entry("_path", "_v", f"if(_state in {_FINAL}, _state, '{LEAF}')")
    done = f"(_state in {_FINAL} or {scalar})"
    place = [F.expr(f"if({done}, _place, null)").alias("place")] if places else []
    if not containers:
        deeper = f"filter({deeper}, e -> e.state <> '{CONTAINER}')"
    rows = rows.select(*keep, *place, F.expr(f"inline(if({done}, array({itself}), {deeper}))").alias("path", "v", "state"))
    return rows.withColumn("path", F.expr("if(path = '', '<root>', path)")) if style == WALK else rows


# A member name, or a scalar, of canonical JSON text.
_NAME_OR_SCALAR = r'("[^"\\]*+(?:\\.[^"\\]*+)*+":)|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"\[\]{},:]++'
# Stands behind names and for scalars; JSON texts never hold control characters.
_HERE = "\x01"


def shapes(df: DataFrame, v: str = "v") -> DataFrame:
    """(v): the records with null in place of every scalar, each such record once.

    Paths, places and kinds of container depend on nothing else, and most feeds have few shapes. They are met before the shuffle, as
    texts with one mark behind each name and one for each scalar; only the texts that are left are parsed again.
    """
    text = F.regexp_replace(F.to_json(v), _NAME_OR_SCALAR, f"$1{_HERE}")
    rows = df.select(text.alias("shape")).distinct()
    named = F.replace(F.col("shape"), F.lit(f'":{_HERE}'), F.lit('":'))
    return rows.select(bound(**{v: F.try_parse_json(F.replace(named, F.lit(_HERE), F.lit("null")))}))


def distinct_paths(df: DataFrame, style: str = INDEXED, v: str = "v", max_depth: int = MAX_DEPTH) -> DataFrame:
    """(path): every path of the leaves once, containers that a walk records left out."""
    return leaves(shapes(df, v), style, v, max_depth, containers=False).select("path").distinct()


def typed_values(seen: DataFrame) -> DataFrame:
    """(path, type, value) of rows of the walk, the other columns kept."""
    keep = [c for c in seen.columns if c not in ("path", "v", "state")]
    rows = seen.select(*keep, "path", "state", "v", F.to_json("v").alias("json"))
    type_ = F.when(F.col("state") == CONTAINER, F.lit(CONTAINER)).otherwise(kind(F.col("json")))
    rows = rows.select(*keep, "path", type_.alias("type"), F.coalesce(F.expr(json_text("v", "json")), F.lit("null")).alias("text"))
    value = F.when(F.col("type") == "number", number_text(F.col("text"))).otherwise(F.col("text"))
    return rows.select(*keep, "path", "type", value.alias("value"))


def observations(df: DataFrame, v: str = "v", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Every value seen in every record as (path, type, value); list members count under the list's path."""
    return typed_values(leaves(df, WALK, v, max_depth))


def leaf_value() -> Column:
    """Text of a row of `leaves`."""
    return F.expr(f"if(state = '{MEMBER}', {scalar_text('v')}, {leaf_text('v')})")


def suggested_key(path: Column) -> Column:
    """Filterable key of a flattened path: the first list index is dropped."""
    return F.regexp_replace(path, r"^(.+?)_\d+_(.+)$", "$1_$2")


def key_suggestions(df: DataFrame, v: str = "v", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Distinct filterable keys of the given records."""
    keys = distinct_paths(df, INDEXED, v, max_depth)
    return keys.select(suggested_key(F.col("path")).alias("key")).distinct()


def value_samples(df: DataFrame, key: str, v: str = "v", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Distinct values of one suggested key; comma-joined text is split.

    A key `root_sub` stands for all flattened keys that start `root_` and end `_sub`.
    """
    root, _, sub = key.partition("_")
    found = leaves(df.select(v), INDEXED, v, max_depth, prefix=root + "_" if root and sub else key)
    path = F.col("path")
    hit = (path.startswith(root + "_") & path.endswith("_" + sub)) if root and sub else path == key
    text = leaf_value()
    is_text = scalar_type("v").isin(STRING, CONTAINER)
    parts = F.when(is_text, F.split(text, ",", -1)).otherwise(F.array(text))
    return (
        found.filter(hit)
        .select(parts.alias("parts"))
        .select(F.explode("parts").alias("value"))
        .select(strip(F.col("value")).alias("value"))
        .filter(F.col("value").isNotNull())
        .distinct()
    )
