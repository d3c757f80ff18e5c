"""Patterns for Spark's engine. Text is Unicode: word characters, digits,
boundaries and case follow Unicode as in the dialect the patterns are in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern(source: str, any_case: bool = False, unicode: bool = True) -> str:
    flags = "i" * any_case + "U" * unicode
    return f"(?{flags}){source}" if flags else source


def found(text: Column, source: str, any_case: bool = False, unicode: bool = True) -> Column:
    """Whether the pattern occurs. In text of ASCII alone it does with or
    without Unicode, and is found faster without."""
    return F.regexp_like(text, F.lit(pattern(source, any_case, unicode)))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def all_found(text: Column, source: str) -> Column:
    """All matches, whole, in order."""
    return F.regexp_extract_all(text, F.lit(pattern(f"({source})")), F.lit(1))


def literal(words, sep: str = "|") -> str:
    """An alternation of words as they are."""
    return sep.join("".join(c if c.isalnum() or c in " -'" else f"\\{c}" for c in w) for w in words)
