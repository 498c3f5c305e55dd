"""Writing-system counts and the rule-based language class."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chorus.functions.text import SPACES

DEVANAGARI = r"[\x{0900}-\x{097F}]"
LATIN = "[a-zA-Z]"

# Thresholds of the language rules.
PURE_PERCENT = 80
MIXED_PERCENT = 15
SHORTEST_TEXT = 3


def _matching_chars(text: Column, char_class: str) -> Column:
    """Characters of a class, as the length that is lost when its runs are removed."""
    rest = F.regexp_replace(text, f"{char_class}+", "")
    return (F.length(text) - F.length(rest)).cast("bigint")


def devanagari_chars(text: Column) -> Column:
    return _matching_chars(text, DEVANAGARI)


def latin_chars(text: Column) -> Column:
    return _matching_chars(text, LATIN)


def visible_chars(text: Column) -> Column:
    """Characters other than the space; tabs and line ends count."""
    return F.length(F.replace(text, F.lit(" "), F.lit(""))).cast("bigint")


def script_counts(text: Column) -> dict[str, Column]:
    devanagari, latin, total = devanagari_chars(text), latin_chars(text), visible_chars(text)
    return {"devanagari": devanagari, "english": latin,
            "other": total - devanagari - latin, "total": total}


def has_devanagari(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(DEVANAGARI)), F.lit(False))


def has_latin(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(LATIN)), F.lit(False))


def language_by_script(text: Column, devanagari: Column, latin: Column, total: Column) -> Column:
    """Language class decided by script shares; null where they do not decide.

    Shares are compared as ``100 * part >= percent * total``, in whole numbers.
    """
    short = F.coalesce(F.length(F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}]+$", "")), F.lit(0))
    reaches = lambda part, percent: part * 100 >= total * percent
    return (F.when((short < SHORTEST_TEXT) | (total == 0), "Unknown")
            .when(reaches(devanagari, MIXED_PERCENT) & reaches(latin, MIXED_PERCENT), "Code-Mixed")
            .when(reaches(devanagari, PURE_PERCENT), "Hindi")
            .when(reaches(latin, PURE_PERCENT), "English"))


def language_from_code(code: Column) -> Column:
    """Class of a detected language code: any other language counts as mixed."""
    return F.when(code == "hi", "Hindi").when(code == "en", "English").otherwise("Code-Mixed")
