"""Column helpers for text: regular expressions with Python meaning, word tests, stripping."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


# All characters that ``\s`` matches in a Unicode pattern.
WHITE_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with flags that give Spark's dialect the meaning it has in Python.

    Python patterns are Unicode aware and their dot excludes the newline only, so ``U`` and
    ``d`` are switched on; ``iu`` ignores case over all of Unicode.
    """
    return ("(?diuU)" if ignore_case else "(?dU)") + pattern


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """True where the pattern occurs anywhere in the text; null text gives false."""
    return F.coalesce(text.rlike(java_pattern(pattern, ignore_case)), F.lit(False))


def extract(text: Column, pattern: str, group: int) -> Column:
    """A capture group, or '' where the pattern or the group does not match.

    Turning '' into null is left to ``blank_to_null`` in a later step: done here, it would name
    the extraction twice and the expression would run twice.
    """
    return F.regexp_extract(text, java_pattern(pattern), group)


def rewrite(text: Column, pattern: str, layout: str) -> Column:
    """The layout with the groups of the first match filled in, for text that matches.

    All groups come from one run. Text around the match is dropped.
    """
    start = "" if pattern.startswith("^") else "(?s:^.*?)"
    whole = f"{start}(?:{pattern})(?s:.*)$"
    return F.regexp_replace(text, java_pattern(whole), layout)


def blank_to_null(column: Column) -> Column:
    return F.when(column != "", column)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True where the text holds at least one of the words; null text gives false."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return F.coalesce(hit, F.lit(False))


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends (SQL ``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def drop_invalid_bytes(text: Column) -> Column:
    """Remove bytes that are not UTF-8, and replacement characters, which a regular expression sees in their place.

    It runs only over lines that hold some."""
    clean = F.is_valid_utf8(text) & ~text.contains("�")
    return F.when(clean, text).otherwise(F.regexp_replace(text, "�", ""))


def flag(condition: Column) -> Column:
    """A 0/1 integer; a null condition gives 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def is_blank(text: Column) -> Column:
    return text.isNull() | (text == "")
