"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_split(text: Column) -> Column:
    """Words between runs of white space, without empty words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def regex_words(text: Column) -> Column:
    """Lower-case words between non-word characters (ASCII word class), without empty words."""
    return F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")


def email_domain(address: Column) -> Column:
    """What follows the last ``@``."""
    return F.substring_index(address, "@", -1)


def has_word(text: Column, word: str) -> Column:
    """Whether the lower-case word stands between white space, punctuation not stripped."""
    return F.array_contains(F.split(F.lower(text), r"\s+"), word)


def count_word(text: Column, word: str) -> Column:
    """How often the lower-case word stands between white space."""
    return F.size(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w == word))
