"""Fill-in-the-middle documents, cut by one counted regular expression per row.

`regexp_count` gives the number n of units of a text. Two draws from 0 to n say after how many units the prefix and the middle
end; each row gets the pattern `\\A(unit{a}+)(unit{b-a}+)(rest)\\z`, and one match rearranges the text through the replacement of its
form. The counts are possessive, so a text of any length is walked once, without backtracking and without recursion.

Everything is an expression on the row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"(?:[^\n]*\n|[^\n]+)"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Markers:
    """The texts ahead of the three parts. None of them may begin inside another one, or places of parts would be ambiguous."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if len(set(self.all)) < 3 or not all(self.all):
            raise ValueError("three different markers are needed")
        if any(mark[0] in other[1:] for mark in self.all for other in self.all):
            raise ValueError("the first character of a marker may not occur inside a marker")

    @property
    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that depend on the seed and the key alone; a null key draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def _quoted(mark: str) -> str:
    """A marker as literal text of a replacement."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def rearrange(text: Column, form: Column, first: Column, second: Column, unit: str = LINE, markers: Markers = Markers()) -> Column:
    """The text in its form: `first` units are the prefix, the units up to `second` the middle. One match per row."""
    count = lambda n: F.concat(F.lit(f"({unit}{{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), count(first), count(second - first), F.lit(r"([\s\S]*)\z"))
    p, s, m = (_quoted(mark) for mark in markers.all)
    template = F.when(form == PSM, F.lit(f"{p}$1{s}$3{m}$2")).otherwise(F.lit(f"{s}$3{p}$1{m}$2"))
    return F.when(form == PLAIN, text).otherwise(F.regexp_replace(text, pattern, template))


def _parts(output: Column, form: Column, markers: Markers) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output that is not plain. Every marker occurs once."""
    after = lambda mark: F.substring_index(output, mark, -1)
    upto = lambda part, mark: F.substring_index(part, mark, 1)
    p, s, m = markers.all
    psm = form == PSM
    prefix = F.when(psm, upto(after(p), s)).otherwise(upto(after(p), m))
    suffix = F.when(psm, upto(after(s), m)).otherwise(upto(after(s), p))
    return prefix, after(m), suffix


def restore(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text from its output and form."""
    return F.when(form == PLAIN, output).otherwise(F.concat(*_parts(output, form, markers)))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7, percent: int = 100,
    spm_percent: int = 50, markers: Markers = Markers(),
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of `docs`.

    `unit` is a regular expression without groups that never matches an empty text; matched from the left its matches must cover the
    text. `percent` of the documents are cut, `spm_percent` of these get the suffix ahead of the prefix. A text that is empty or
    holds a marker stays plain, with no counts of characters. Null texts are empty, rows with a null id draw as an empty id, repeated
    rows are each answered (alike), an empty table gives no rows; extra columns are left behind.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    marked = F.contains(text, F.lit(markers.prefix)) | F.contains(text, F.lit(markers.suffix)) | F.contains(text, F.lit(markers.middle))
    form = (
        F.when((text == "") | marked | (h3 % 100 >= percent), PLAIN).when(h4 % 100 < spm_percent, SPM).otherwise(PSM)
    )
    rows = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"),
        F.regexp_count(text, F.lit(unit)).cast("bigint").alias("n"),
    )
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = rows.select("*", F.least(one, two).alias("first"), F.greatest(one, two).alias("second"))
    output = rearrange(F.col("text"), F.col("form"), F.col("first"), F.col("second"), unit, markers)
    made = cut.select("doc_id", "n", "form", output.alias("output"))
    prefix, middle, _ = _parts(F.col("output"), F.col("form"), markers)
    length = lambda part: F.when(F.col("form") != PLAIN, F.char_length(part).cast("bigint"))
    return made.select("doc_id", "n", "form", length(prefix).alias("prefix_chars"), length(middle).alias("middle_chars"), "output")
