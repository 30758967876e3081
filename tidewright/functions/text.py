"""Text expressions. Java's \\s is ASCII only, so white space is spelled out where Unicode matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, as the inside of a character class (Java and RE2 read it alike).
SPACE = r"\s\p{Z}\x0B\x{85}\x{1C}-\x{1F}"
#: Letters, digits and the underscore of any alphabet.
WORD = r"\p{L}\p{N}_"


def strip(c: Column) -> Column:
    """c without white space at both ends (trim() removes only blanks)."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(c: Column) -> Column:
    """True where c is null or has nothing but white space."""
    return c.isNull() | ~F.coalesce(c, F.lit("")).rlike(rf"[^{SPACE}]")


def fold(c: Column) -> Column:
    """c without regard to letter case."""
    return F.lower(F.upper(c))


def label(c: Column, default: str | None = None) -> Column:
    """c read trimmed and ignoring case; null gives the default."""
    read = F.lower(strip(c))
    return read if default is None else F.coalesce(read, F.lit(default))


def words(c: Column) -> Column:
    """Runs of letters or digits, case ignored."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
