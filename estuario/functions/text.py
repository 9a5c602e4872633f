"""Column functions on text, hashes and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning chain, in order: pattern and replacement. Java's \s leaves non-breaking spaces, hence the first step.
CLEANING = [
    (r"\p{Z}", " "),
    (r"http\S+|www\S+|pic\.twitter\.com\S+", ""),
    (r"@([A-Za-z0-9_]{1,15})", " "),
    (r"#[\p{L}\p{N}_]+", " "),
    (r"\s+", " "),
]


def clean_text(c: Column) -> Column:
    """Text without links, handles and hashtags, with single spaces; null stays null."""
    for pattern, to in CLEANING:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def is_blank(c: Column) -> Column:
    """Null or nothing but spaces."""
    return c.isNull() | (F.trim(c) == "")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def reference_kind(status_id: Column, handle: Column, is_quote: Column) -> Column:
    """reply if either reference to a parent is there, else quote if flagged, else original; a source's own type is never trusted."""
    return F.when(status_id.isNotNull() | handle.isNotNull(), "reply").when(is_quote, "quote").otherwise("original")


def pseudonym(c: Column, salt: str) -> Column:
    """'n' and ten hex digits of the salted hash; the salt comes from the configuration, never from code."""
    return F.concat(F.lit("n"), F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, 10))


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b as a rounded double; null where b is 0 or null."""
    return F.round(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), digits)
