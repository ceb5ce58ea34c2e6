"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates words, and what a name may contain.
WORD_PATTERN = r"[^ \n\t\r]+"
UNSAFE_NAME_PATTERN = r"[^A-Za-z0-9._-]+"


def words(text: Column) -> Column:
    """Whitespace-separated words, in order."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def slug(text: Column, fallback: str = "run") -> Column:
    """A name safe for paths; empty results become ``fallback``."""
    dashed = F.regexp_replace(text, UNSAFE_NAME_PATTERN, "-")
    trimmed = F.regexp_replace(dashed, r"^[-.]+|[-.]+$", "")
    return F.when(trimmed == "", F.lit(fallback)).otherwise(trimmed)


def general_number(value: Column) -> Column:
    """Six significant digits in the shortest of fixed and scientific form."""
    padded = F.format_string("%.6g", value)
    no_zeros = F.regexp_replace(padded, r"(\.\d*?)0+(e|$)", "$1$2")
    return F.regexp_replace(no_zeros, r"\.(e|$)", "$1")
