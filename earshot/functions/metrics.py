"""Transcript-quality metrics as native expressions.

Two families: the pairwise metrics compare a reference with a hypothesis;
the target metrics look for a list of expected phrases in a hypothesis.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.text import WORD, let, text_or_empty, tokens

# Band widths tried before the full edit-distance table.
BANDS = (16, 128)


def edit_distance(a: Column, b: Column) -> Column:
    """Exact Levenshtein distance, cheap for near-equal strings.

    A banded run costs band x length and answers -1 when the distance lies
    beyond the band; only then is the next, wider one evaluated.
    """
    out = F.levenshtein(a, b)
    for band in reversed(BANDS):
        out = _unless_beyond(F.levenshtein(a, b, band), out)
    return F.when(a == b, F.lit(0)).otherwise(out)


def _unless_beyond(banded: Column, wider: Column) -> Column:
    """The banded distance, bound so that no run is repeated to look at its answer, or the wider one."""
    return let(banded, lambda d: F.when(d < 0, wider).otherwise(d))


# Shared words up to this number are spelled with one-byte code points.
SHORT_ALPHABET = 250


def _as_symbols(words: Column, shared: Column, missing: int) -> Column:
    """Spell each word as one character: its place among the shared words.

    Words without a partner on the other side never match, so one character
    per side (``missing``: 1 or 2) stands for all of them. Up to 250 shared
    words fit the first code points. A larger alphabet goes through UTF-32,
    places from the surrogate range on moved past it; beyond the last code
    point the decoding fails loudly.
    """
    short = F.array_join(F.transform(words, lambda w: F.char(F.array_position(shared, w) + 2)), "")
    if missing != 2:
        short = F.translate(short, chr(2), chr(missing))

    def code(word: Column) -> Column:
        place = F.array_position(shared, word)
        point = F.when(place == 0, F.lit(missing)).otherwise(place + 2)
        point = F.when(point >= 0xD800, point + 0x800).otherwise(point)
        return F.lpad(F.hex(point.cast("long")), 8, "0")

    wide = F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-32")
    return F.when(F.size(shared) <= SHORT_ALPHABET, short).otherwise(wide)


def word_symbols(ref_words: Column, hyp_words: Column) -> Column:
    """Both word arrays spelled as strings (``ref``, ``hyp``) of one character per word."""
    pair = F.struct(
        ref_words.alias("ref"),
        hyp_words.alias("hyp"),
        F.array_intersect(ref_words, hyp_words).alias("shared"),
    )
    return let(
        pair,
        lambda p: F.struct(
            _as_symbols(p["ref"], p["shared"], 1).alias("ref"),
            _as_symbols(p["hyp"], p["shared"], 2).alias("hyp"),
        ),
    )


def word_distance(ref_words: Column, hyp_words: Column) -> Column:
    """Levenshtein distance of two word arrays."""
    return let(word_symbols(ref_words, hyp_words), lambda s: edit_distance(s["ref"], s["hyp"]))


def wer(ref: Column, hyp: Column) -> Column:
    """Word edit distance over the number of reference words (at least 1)."""
    return word_distance(tokens(ref), tokens(hyp)) / F.greatest(F.lit(1), F.size(tokens(ref)))


def cer(ref: Column, hyp: Column) -> Column:
    """Character edit distance over the reference length (at least 1)."""
    r, h = text_or_empty(ref), text_or_empty(hyp)
    return edit_distance(r, h) / F.greatest(F.lit(1), F.length(r))


def _share_found(ref: Column, hyp: Column, items: Callable[[Column], Column], pattern: str) -> Column:
    """``items`` are the matches of ``pattern``; equal texts are only asked whether they have any."""
    share = F.size(F.array_intersect(items(ref), items(hyp))) / F.greatest(F.lit(1), F.size(F.array_distinct(items(ref))))
    equal = text_or_empty(ref) == text_or_empty(hyp)
    return F.when(equal, text_or_empty(ref).rlike(pattern).cast("double")).otherwise(share)


def keyword_accuracy(ref: Column, hyp: Column) -> Column:
    """Share of the distinct reference words that the hypothesis has too."""
    return _share_found(ref, hyp, tokens, WORD)


DIGITS = r"(?U)\d+"


def _digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(DIGITS), F.lit(0))


def numeric_accuracy(ref: Column, hyp: Column, legacy: bool = False) -> Column:
    """Share of the distinct reference numbers that the hypothesis has too.

    ``legacy`` gives the constant 0.0 that published reports carry.
    """
    if legacy:
        return F.lit(0.0)
    return _share_found(ref, hyp, _digit_runs, DIGITS)


def negation_accuracy(ref: Column, hyp: Column, legacy: bool = False) -> Column:
    """1.0 when both texts or neither hold "no ". ``legacy`` gives null."""
    if legacy:
        return F.lit(None).cast("double")
    said = F.contains(text_or_empty(ref), F.lit("no "))
    heard = F.contains(text_or_empty(hyp), F.lit("no "))
    return (said == heard).cast("double")


def _targets_found(targets: Column, text: Column, fold_target: bool) -> Column:
    def found(t: Column) -> Column:
        return F.contains(text, F.lower(t) if fold_target else t)

    hits = F.size(F.filter(targets, found))
    return F.when(F.coalesce(F.size(targets), F.lit(0)) <= 0, F.lit(1.0)).otherwise(hits / F.size(targets))


def domain_keyword_accuracy(targets: Column, hyp: Column) -> Column:
    """Share of target phrases found in the text, case folded; no targets: 1.0."""
    return let(F.lower(text_or_empty(hyp)), lambda t: _targets_found(targets, t, True))


def target_numeric_accuracy(targets: Column, hyp: Column) -> Column:
    """As the keyword form, but the target keeps its case."""
    return let(F.lower(text_or_empty(hyp)), lambda t: _targets_found(targets, t, False))


def target_negation_accuracy(targets: Column, hyp: Column) -> Column:
    return domain_keyword_accuracy(targets, hyp)


def score(ref: Column, hyp: Column, keywords: Column, numerics: Column, negations: Column) -> Column:
    """The scored record of one hypothesis."""
    return F.struct(
        wer(ref, hyp).alias("wer"),
        cer(ref, hyp).alias("cer"),
        domain_keyword_accuracy(keywords, hyp).alias("keyword_acc"),
        target_numeric_accuracy(numerics, hyp).alias("numeric_acc"),
        target_negation_accuracy(negations, hyp).alias("negation_acc"),
        text_or_empty(hyp).alias("hypothesis"),
    )
