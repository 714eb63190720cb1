"""String column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that a whitespace strip removes at both ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same as a pattern: `\s` of Java patterns knows only six of them.
SPACE = f"[{WHITESPACE}]"

# What counts as a number: digits with a point and exponent at most, so `NaN` and `5d` do not.
NUMBER = r"^\s*[-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][-+]?[0-9]+)?\s*$"


def number(text: Column) -> Column:
    """The finite number a text is, else NULL."""
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def as_column(value: Column | str) -> Column:
    """A column as it is, a string as a column name."""
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str, characters: str = WHITESPACE) -> Column:
    """Remove any of `characters` at both ends (plain `trim` only knows the space)."""
    return F.btrim(as_column(value), F.lit(characters))


def strip_left(value: Column | str, characters: str = WHITESPACE) -> Column:
    return F.ltrim(as_column(value), F.lit(characters))


def strip_right(value: Column | str, characters: str = WHITESPACE) -> Column:
    return F.rtrim(as_column(value), F.lit(characters))


def swap(value: Column, old: str, new: str = "") -> Column:
    """Literal (not regex) replacement of every occurrence."""
    return F.replace(value, F.lit(old), F.lit(new))


def has(value: Column, text: str) -> Column:
    return F.contains(value, F.lit(text))


def before(value: Column, marker: str) -> Column:
    """The text before the first `marker`, or all of it."""
    return F.substring_index(value, marker, 1)


def after_last(value: Column, marker: str) -> Column:
    """The text after the last `marker`, or all of it."""
    return F.substring_index(value, marker, -1)


def after_first(value: Column, marker: str) -> Column:
    """The text after the first `marker`; NULL when there is none."""
    at = F.locate(marker, value)
    return F.when(at > 0, F.substr(value, at + F.lit(len(marker))))


def occurrences(value: Column, character: str) -> Column:
    """How often a single character occurs."""
    return F.length(value) - F.length(swap(value, character))
