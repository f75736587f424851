"""Scalar semantics of JSON values: type, canonical text, equality, truthiness, rendering.

Most helpers take the canonical JSON text `to_json(variant)` (keys sorted, no blanks): its first
character gives the JSON type, and unlike VARIANT it can be grouped, joined and compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.sqltext import as_array, literal

# The five value types of a profile signature.
NULL, BOOL, NUMBER, STRING, CONTAINER = "null", "bool", "number", "string", "json"

# Canonical texts of the values that count as "no data".
EMPTY_TEXTS = ["null", "false", "0", "0.0", "-0.0", '""', "[]", "{}"]

# Brackets and commas of settled texts, and the characters that stand for them while a list is being settled. JSON texts
# never hold control characters.
_MARKS, _HIDDEN = "[]{},", "\\u0011\\u0012\\u0013\\u0014\\u0015"

NUMBER_PATTERN = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def kind(text: Column) -> Column:
    """Value type read off canonical text."""
    head = F.substring(text, 1, 1)
    return (
        F.when(head.isin("{", "["), F.lit(CONTAINER))
        .when(head == '"', F.lit(STRING))
        .when(head.isin("t", "f"), F.lit(BOOL))
        .when(head == "n", F.lit(NULL))
        .when(text.isNotNull(), F.lit(NUMBER))
    )


def scalar_type(v: str) -> Column:
    """Value type of a VARIANT column."""
    name = f"schema_of_variant({v})"
    return F.expr(
        f"case when {v} is null then null when {name} = 'STRING' then '{STRING}' when {name} = 'BOOLEAN' then '{BOOL}' "
        f"when {name} = 'VOID' then '{NULL}' when {name} like 'OBJECT%' or {name} like 'ARRAY%' then '{CONTAINER}' "
        f"else '{NUMBER}' end"
    )


def number_text(text: Column) -> Column:
    """One spelling per numeric value, so that 1, 1.0 and 1e0 meet."""
    real = text.try_cast("double")
    whole = (real == F.floor(real)) & (F.abs(real) < F.lit(1e18))
    return (
        F.when(text.rlike(r"^-?\d+$"), text)
        .when(whole, real.cast("bigint").cast("string"))
        .otherwise(real.cast("string"))
    )


def equality_key(text: Column) -> Column:
    """Key under which two values are equal when numbers and booleans compare by value.

    true equals 1, 1 equals 1.0, missing equals null; a string never equals a container.
    """
    return (
        F.when(text.isNull(), F.lit("null"))
        .when(text == "true", F.lit("1"))
        .when(text == "false", F.lit("0"))
        .when(kind(text) == NUMBER, number_text(text))
        .otherwise(text)
    )


def has_data(text: Column) -> Column:
    """Truthiness: null, false, zero, '' and empty containers carry no data; neither does a missing value."""
    return text.isNotNull() & ~text.isin(*EMPTY_TEXTS)


def truncated(text: Column, limit: int) -> Column:
    """Display text cut to `limit` characters; 0 keeps it whole."""
    if not limit:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("...(truncated)"))).otherwise(text)


def json_text(v: str, json: str) -> str:
    """SQL text: `try_cast(v as string)` of a VARIANT read from JSON whose canonical text is in the column `json`.

    Whole numbers and strings without escapes are read off that text, which is several times faster than the cast.
    """
    return (
        f"case when {json} rlike '^-?[0-9]++$' then {json} "
        f"when startswith({json}, '\"') and not contains({json}, '\\\\') then substring({json}, 2, length({json}) - 2) "
        f"else try_cast({v} as string) end"
    )


def scalar_text(v: str) -> str:
    """SQL text: string form of a scalar VARIANT, booleans as True/False, JSON null as NULL."""
    return (
        f"case when {v} is null or is_variant_null({v}) then cast(null as string) "
        f"when try_cast({v} as string) in ('true', 'false') and schema_of_variant({v}) = 'BOOLEAN' "
        f"then initcap(try_cast({v} as string)) else try_cast({v} as string) end"
    )


def leaf_text(v: str) -> str:
    """SQL text: string form of a flattened leaf; a list is joined by commas, its nulls print None."""
    items = f"transform({as_array(v)}, x -> coalesce({scalar_text('x')}, 'None'))"
    return f"coalesce(array_join({items}, ','), {scalar_text(v)})"


# Strings, brackets and signs, and what lies between them.
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{},:]|[^"\[\]{},:]+'
# A text whose strings hold no sign and no escape, and whose numbers are whole: it is its own list of tokens.
_SIMPLE = r'^(?:"[^"\\\[\]{},]*+"|[\[\]{},:]|-?[0-9]++(?![.eE])|null)++$'
_INNERMOST = r"[\[{][^\[\]{}]*+[\]}]"


def _hidden(x: str) -> str:
    return f"translate({x}, '{_MARKS}', '{_HIDDEN}')"


def _token(t: str) -> str:
    """SQL text: a token as it is compared: brackets in strings hidden, booleans and numbers by value."""
    real = f"try_cast({t} as double)"
    return (
        f"case when startswith({t}, '\"') then {_hidden(t)} when {t} = 'true' then '1' when {t} = 'false' then '0' "
        f"when not {t} rlike '^[-0-9]' or {t} rlike '^-?[0-9]+$' then {t} "
        f"when {real} = floor({real}) and abs({real}) < 1e18 then cast(cast({real} as bigint) as string) "
        f"else cast({real} as string) end"
    )


def bag_differs(old: str, new: str) -> Column:
    """Whether two canonical JSON lists differ whatever their order: both are their own lists of tokens, and not of the same tokens."""
    simple = " and ".join(f"{x} rlike {literal(_SIMPLE)}" for x in (old, new))
    tokens = [f"sort_array(regexp_extract_all({x}, {literal(_TOKENS)}, 0))" for x in (old, new)]
    return F.expr(f"{simple} and (length({old}) <> length({new}) or {tokens[0]} <> {tokens[1]})")


def list_members(text: str) -> Column:
    """Comparable text of each member of the canonical JSON list in SQL expression `text`; NULL for anything else.

    Order is kept; lists inside the members, at any depth, are sorted: in each step all innermost containers are settled at once, with
    their brackets hidden, until only the outer list is left. The text of the expression does not depend on the depth.
    """
    r, tokens = literal(_INNERMOST), f"regexp_extract_all({text}, {literal(_TOKENS)}, 0)"
    start = f"if({text} rlike {literal(_SIMPLE)}, {text}, array_join(transform({tokens}, t -> {_token('t')}), ''))"
    more = "substring(n, 2) rlike '[\\\\[{]'"
    members = "array_join(sort_array(split(substring(x, 2, length(x) - 2), ',')), ',')"
    settled = f"if(startswith(x, '['), concat('[', {members}, ']'), x)"
    inner = f"transform(regexp_extract_all(acc.t, {r}, 0), x -> {_hidden(settled)})"
    joined = f"array_join(zip_with(split(acc.t, {r}), {inner}, (p, x) -> concat(p, coalesce(x, ''))), '')"
    state = f"n -> struct(n as t, {more} as more)"
    step = f"(acc, i) -> if(acc.more, transform(array({joined}), {state})[0], acc)"
    # Each step closes a level, and there are no more levels than brackets.
    steps = "sequence(1, length(s) - length(translate(s, '[{', '')))"
    whole = f"transform(array({start}), s -> aggregate({steps}, transform(array(s), {state})[0], {step}, acc -> acc.t))[0]"
    shown = f"transform(split(substring(w, 2, length(w) - 2), ','), m -> translate(m, '{_HIDDEN}', '{_MARKS}'))"
    listed = f"transform(array({whole}), w -> if(w = '[]', cast(array() as array<string>), {shown}))[0]"
    return F.expr(f"if(startswith({text}, '['), {listed}, null)")
