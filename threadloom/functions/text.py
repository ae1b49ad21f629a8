"""Column expressions on text that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Unicode's White_Space property, as Java's regular expressions name it.
WHITE = r"\p{IsWhite_Space}"


def strip(col: Column | str) -> Column:
    """``col`` without Unicode white space at either end."""
    col = F.col(col) if isinstance(col, str) else col
    # Possessive and anchored by what is before it, so long inner runs cost one pass.
    return F.regexp_replace(col, rf"\A{WHITE}++|(?<!{WHITE}){WHITE}++\z", "")


def blank_to_null(col: Column | str) -> Column:
    """The stripped text, or null if nothing is left of it."""
    return F.nullif(strip(col), F.lit(""))


def is_blank(col: Column | str) -> Column:
    """True for null and for text of white space only; never null."""
    return blank_to_null(col).isNull()


def squeeze(col: Column | str) -> Column:
    """Runs of Unicode white space become one space; the ends are trimmed."""
    col = F.col(col) if isinstance(col, str) else col
    return F.btrim(F.regexp_replace(col, f"{WHITE}++", " "))
