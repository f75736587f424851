"""Small text and ratio expressions shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.sqltext import BLANKS


def strip(text: Column) -> Column:
    """Text without white space at both ends; plain `trim` only takes blanks."""
    return F.trim(text, F.lit(BLANKS))


def percent(part: Column, total: Column) -> Column:
    """part / total * 100, and 0 where the total is 0 or unknown."""
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(0.0)) * 100


def or_default(text: Column, default: str) -> Column:
    """The text, or `default` where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def request_key(ip: Column, day: Column) -> Column:
    """Identity of an (ip, day) request: case and blanks ignored, no day reads `none`."""
    day_text = F.coalesce(F.nullif(strip(day), F.lit("")), F.lit("none"))
    return F.concat_ws("|", F.lower(strip(ip)), day_text)


def has_ip(ip: Column) -> Column:
    """True where an ip is present; blank cells and the text `nan` count as absent."""
    return ip.isNotNull() & (strip(ip) != "") & (F.lower(strip(ip)) != "nan")
