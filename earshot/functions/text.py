"""Tokens and transcript normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Unicode calls a blank, as a regex class. Java's \s alone is ASCII.
BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
WORD = BLANK.replace("[", "[^", 1) + "+"

# The dose spellings that are rewritten, glued and with one blank.
GLUED_DOSES = "10|20|25|40|50|500"
SPACED_DOSES = "500|5|10|20|25|40"

# Digit words.
DIGIT_WORDS = {
    "zero": "0",
    "one": "1",
    "two": "2",
    "three": "3",
    "four": "4",
    "five": "5",
    "six": "6",
    "seven": "7",
    "eight": "8",
    "nine": "9",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda body evaluates what it captures once per element; binding the
    captured expression to a lambda variable first keeps it to one evaluation.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def tokens(c: Column) -> Column:
    """Whitespace-separated words; an empty or null text has none. Unlike a split's, this pattern is compiled once."""
    return F.regexp_extract_all(text_or_empty(c), F.lit(WORD), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of blanks become one blank; blanks at the ends go."""
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def normalize_doses(c: Column) -> Column:
    pattern = rf"(?iU)\b(?:({GLUED_DOSES})mg|({SPACED_DOSES}) mg)\b"
    return F.regexp_replace(c, pattern, r"$1$2 milligrams")


def normalize(c: Column) -> Column:
    """Dose spellings written out, then blanks squeezed."""
    return squeeze(normalize_doses(text_or_empty(c)))


def digit_words(c: Column) -> Column:
    """Digit words become digits. Texts without one are scanned once only."""
    text = text_or_empty(c)
    out = text
    for word, digit in DIGIT_WORDS.items():
        out = F.regexp_replace(out, rf"(?iU)\b{word}\b", digit)
    return F.when(text.rlike(r"(?iU)\b(?:" + "|".join(DIGIT_WORDS) + r")\b"), out).otherwise(text)
