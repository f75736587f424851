"""Small helpers for building SQL expression text."""

from __future__ import annotations

import re

BLANKS = " \t\n\r\x0b\x0c"

OBJECT_T = "map<string,variant>"
ARRAY_T = "array<variant>"

PLAIN_KEY = re.compile(r"[A-Za-z0-9_\- ]+")


def literal(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """Column name as SQL text, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def field(source: str, key: str) -> str:
    """Member `key` of the VARIANT expression `source`: NULL if missing, variant null if null."""
    if PLAIN_KEY.fullmatch(key):
        return f"try_variant_get({source}, '$[\"{key}\"]', 'variant')"
    return f"element_at(try_cast({source} as {OBJECT_T}), {literal(key)})"


def stripped(text: str) -> str:
    """SQL text without white space at both ends; plain `trim` only takes blanks."""
    return f"btrim({text}, {literal(BLANKS)})"


# Closes the list that a line is parsed in. A line that closes the list itself leaves something else in its place.
LINE_END = "feedloom:end of line"


def listed_json(text: str) -> str:
    """SQL text: VARIANT of a text as the first of two members of a list, for `only_member`."""
    return f"try_parse_json(concat('[', {text}, ',\"{LINE_END}\"]'))"


def only_member(x: str) -> str:
    """SQL text: the first member of a `listed_json`, NULL if the text was not one JSON value."""
    whole = f"try_variant_get({x}, '$[1]', 'string') = '{LINE_END}' and try_variant_get({x}, '$[2]', 'variant') is null"
    return f"if({whole}, try_variant_get({x}, '$[0]', 'variant'), null)"


def strict_json(text: str) -> str:
    """SQL text: VARIANT of a text that is one JSON value and nothing else, else NULL.

    The parser stops after the first value, so the text is parsed as the first of two members of a list.
    """
    return f"transform(array({listed_json(text)}), x -> {only_member('x')})[0]"


def as_object(source: str) -> str:
    return f"try_cast({source} as {OBJECT_T})"


def as_array(source: str) -> str:
    return f"try_cast({source} as {ARRAY_T})"
