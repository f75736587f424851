"""Computing a column once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(**columns: Column) -> Column:
    """Generator for `select` that computes the named columns once per row.

    Filters on a plain projection are pushed below it, where every reference computes the column
    again; they are not pushed through a generator. Use it for parses and other costly expressions.
    """
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
