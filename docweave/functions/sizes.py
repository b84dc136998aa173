"""Text sizes as plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space, as a character-class body that Java and Python read alike.
WHITESPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _count(text: Column, keep: str) -> Column:
    """How many characters are of a class: what is missing without them. Classes that name what they hold are
    matched several times faster than negated ones."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{keep}]+", ""))).cast("long")


def syllables(text: Column) -> Column:
    return _count(text, "가-힣")


def alphanumerics(text: Column) -> Column:
    return _count(text, "A-Za-z0-9")


def spaces(text: Column) -> Column:
    return _count(text, WHITESPACE)


def size_units(text: Column) -> Column:
    """Twelfths of an estimated token: 8 for a syllable, 3 for an ASCII letter, digit or whitespace character."""
    return syllables(text) * 8 + _count(text, "A-Za-z0-9" + WHITESPACE) * 3


def estimated_tokens(text: Column) -> Column:
    """syllables / 1.5 + ASCII letters and digits / 4 + whitespace / 4, rounded down, in whole-number arithmetic."""
    return F.floor(size_units(text) / 12).cast("long")
