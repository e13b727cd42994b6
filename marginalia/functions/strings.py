"""String expressions with Python text semantics (strip, splitlines, find)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip()/str.split() treat as whitespace.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The line boundaries of Python's str.splitlines(), besides "\n" itself.
OTHER_LINE_BREAKS = r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both ends (Spark's default trims spaces only)."""
    return F.trim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Split on runs of Unicode whitespace; no empty items."""
    spaced = F.translate(text, WHITESPACE[1:], " " * (len(WHITESPACE) - 1))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def universal_newlines(text: Column) -> Column:
    """`\\r\\n` and lone `\\r` become `\\n`, as when a file is opened in text mode."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def newline_only(text: Column) -> Column:
    """Turn every line boundary into `\\n`; afterwards U+001E cannot occur in the text."""
    return F.regexp_replace(text, OTHER_LINE_BREAKS, "\n")


def after(text: Column, label: str) -> Column:
    """Text after the first occurrence of `label`; NULL when it does not occur."""
    at = F.instr(text, F.lit(label))
    return F.when(at > 0, F.substr(text, at + F.lit(len(label))))


def before(text: Column, label: str) -> Column:
    """Text before the first occurrence of `label`; the whole text when it does not occur."""
    return F.substring_index(text, label, 1)


def line_field(text: Column, label: str) -> Column:
    """Rest of the line after the first `label`, stripped; '' when the label is absent."""
    return F.when(text.isNotNull(), F.coalesce(strip(before(after(text, label), "\n")), F.lit("")))


def block_field(text: Column, start: str, end: str) -> Column:
    """Text between the first `start` and the next `end`, stripped; '' when `start` is absent."""
    return F.when(text.isNotNull(), F.coalesce(strip(before(after(text, start), end)), F.lit("")))


def python_float(text: Column) -> Column:
    """DOUBLE of what Python's float() accepts, else NULL.

    A bare cast would also take Java suffixes such as `1.0d`.
    """
    bare = strip(text)
    digits = r"\d(?:_?\d)*"
    number = rf"^[+-]?(?:{digits}(?:\.(?:{digits})?)?|\.{digits})(?:[eE][+-]?{digits})?$"
    special = F.regexp_extract(F.lower(bare), r"^([+-]?)(?:inf|infinity)$", 0)
    return (
        F.when(bare.rlike(number), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))
        .when(special != "", F.when(F.startswith(bare, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .when(F.lower(bare).rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    )
