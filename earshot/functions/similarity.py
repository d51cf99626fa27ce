"""How alike a span and a term are: by letters, by sound, by shared trigrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.text import let

# Strings up to this length fit one long as a bit vector with a bit to spare.
BIT_LENGTH = 61


def characters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def letter_masks(c: Column) -> Column:
    """The places of each character as the set bits of a long: map<character, bits>."""

    def masks(p: Column) -> Column:
        def spelled(ch: Column) -> Column:
            return F.array_join(F.transform(p["places"], lambda x: F.when(x == ch, "1").otherwise("0")), "")

        return F.map_from_arrays(
            p["distinct"], F.transform(p["distinct"], lambda ch: F.conv(spelled(ch), 2, 10).cast("long"))
        )

    places = F.reverse(characters(c))
    return let(F.struct(places.alias("places"), F.array_distinct(places).alias("distinct")), masks)


def lcs_by_masks(masks: Column, length: Column, text: Column) -> Column:
    """Longest common subsequence of ``text`` and the string of ``length`` <= 61 whose masks are given.

    The string is one bit vector; each character of the text takes a few bit operations.
    """
    ones = F.call_function("shiftleft", F.lit(1).cast("long"), length) - F.lit(1).cast("long")

    def fold(p: Column) -> Column:
        hits = F.transform(p["text"], lambda ch: F.coalesce(F.element_at(p["masks"], ch), F.lit(0).cast("long")))

        def step(v: Column, hit: Column) -> Column:
            return (v + v.bitwiseAND(hit)).bitwiseOR(v.bitwiseAND(F.bitwise_not(hit))).bitwiseAND(p["ones"])

        return p["length"] - F.bit_count(F.aggregate(hits, p["ones"], step))

    return let(
        F.struct(masks.alias("masks"), length.alias("length"), ones.alias("ones"), characters(text).alias("text")), fold
    )


def _lcs_table(a: Column, b: Column) -> Column:
    """The same by table rows, for strings too long for a bit vector."""

    def fold(p: Column) -> Column:
        width = F.size(p["b"])

        def row(previous: Column, ch: Column) -> Column:
            def cell(done: Column, j: Column) -> Column:
                same = F.element_at(p["b"], j) == ch
                value = F.when(same, F.element_at(previous, j) + 1).otherwise(
                    F.greatest(F.element_at(previous, j + 1), F.element_at(done, -1))
                )
                return F.concat(done, F.array(value))

            return F.aggregate(F.sequence(F.lit(1), width), F.array(F.lit(0)), cell)

        return F.element_at(F.aggregate(p["a"], F.array_repeat(F.lit(0), width + 1), row), -1)

    return let(F.struct(characters(a).alias("a"), characters(b).alias("b")), fold)


def lcs_length(a: Column, b: Column) -> Column:
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (
        F.when(F.length(shorter) == 0, F.lit(0))
        .when(a == b, F.length(a))
        .when(F.length(shorter) <= BIT_LENGTH, lcs_by_masks(letter_masks(shorter), F.length(shorter), longer))
        .otherwise(_lcs_table(shorter, longer))
    )


def ratio_by_masks(masks: Column, term: Column, text: Column) -> Column:
    """The ratio of a term whose masks are at hand (null when it is too long for them) and a text."""
    total = F.length(term) + F.length(text)
    return F.when(masks.isNull() | (F.length(term) == 0), ratio(term, text)).otherwise(
        2 * lcs_by_masks(masks, F.length(term), text) / total
    )


def masks_if_short(c: Column) -> Column:
    return F.when((F.length(c) > 0) & (F.length(c) <= BIT_LENGTH), letter_masks(c))


def ratio(a: Column, b: Column) -> Column:
    """2 x longest common subsequence over both lengths; two empty strings are equal."""

    def of(p: Column) -> Column:
        total = F.length(p["a"]) + F.length(p["b"])
        return F.when(total == 0, F.lit(1.0)).otherwise(2 * lcs_length(p["a"], p["b"]) / total)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """The ratio with case folded."""
    return ratio(F.lower(a), F.lower(b))


# Metaphone (Philips 1990) as ordered rewrites of a lower-case word. A finished
# code is upper case (0 is th), so later rules do not take it for a letter;
# vowels stay to the end because other rules look at them.
METAPHONE = [
    (r"[^a-z ]", ""),
    (r"(?<![a-z])(?:a(?=e)|[gkp](?=n)|w(?=r))", ""),
    (r"(?<![a-z])x", "s"),
    (r"(?<![a-z])wh", "w"),
    (r"([abd-z])\1+", "$1"),
    (r"(?<=m)b(?![a-z])", ""),
    (r"t(?=ch)", ""),
    (r"sch", "sK"),
    (r"ch|c(?=ia)", "X"),
    (r"(?<=s)c(?=[iey])", ""),
    (r"c(?=[iey])", "S"),
    (r"ck?", "K"),
    (r"dg(?=[eiy])", "J"),
    (r"d", "T"),
    (r"g(?=h[^aeiou ])", ""),
    (r"g(?=n(?:ed)?(?![a-z]))", ""),
    (r"gh", "K"),
    (r"g(?=[iey])", "J"),
    (r"g", "K"),
    (r"ph", "F"),
    (r"sh|s(?=i[oa])", "X"),
    (r"t(?=i[oa])", "X"),
    (r"th", "0"),
    (r"(?<=[aeiou])h(?![aeiou])", ""),
    (r"q", "K"),
    (r"v", "F"),
    (r"x", "KS"),
    (r"z", "S"),
    (r"[wy](?![aeiou])", ""),
    (r"(?<=[a-zA-Z0])[aeiou]", ""),
]


def metaphone(c: Column) -> Column:
    """The sound code of a word or of the words of a span, blanks kept."""
    out = F.lower(c)
    for pattern, code in METAPHONE:
        out = F.regexp_replace(out, pattern, code)
    return F.trim(F.regexp_replace(F.upper(out), " +", " "))


def code_ratio(code_a: Column, code_b: Column) -> Column:
    """The ratio of two sound codes; an empty code is like nothing."""

    def of(p: Column) -> Column:
        return F.when((p["a"] == "") | (p["b"] == ""), F.lit(0.0)).otherwise(ratio(p["a"], p["b"]))

    return let(F.struct(code_a.alias("a"), code_b.alias("b")), of)


def phonetic_ratio(a: Column, b: Column) -> Column:
    return code_ratio(metaphone(a), metaphone(b))


def trigrams(c: Column) -> Column:
    """The distinct character trigrams of a text, one blank added at each end."""

    def cut(padded: Column) -> Column:
        last = F.greatest(F.length(padded) - 2, F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(padded, i, F.lit(3))))

    return let(F.concat(F.lit(" "), F.lower(c), F.lit(" ")), cut)
