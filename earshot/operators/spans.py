"""Candidate spans of a transcript and the choice among overlapping ones."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.text import BLANK, let, squeeze, text_or_empty, tokens

MAX_WORDS = 4
MIN_LETTERS = 6
MIN_SUSPICION = 0.5

# Words that do not look suspicious.
COMMON_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "and", "or",
    "but", "with", "for", "from", "to", "of", "in", "on", "at",
    "patient", "please", "take", "taking", "needs", "need", "keep", "continue",
]


def _beside(df: DataFrame, key: str, arrays: dict[str, Column], n: int, starting: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per word: (key, start, <name>0 .. <name>n-1), each array's element beside its n - 1 followers.

    ``starting``: a test of the first array's elements; other elements make no row of their own.
    """

    def rows(p: Column) -> Column:
        words = p[next(iter(arrays))]

        def row(i: Column) -> Column:
            return F.struct(i.alias("start"), *[F.get(p[a], i + j).alias(f"{a}{j}") for a in arrays for j in range(n)])

        if starting is None:
            return F.transform(words, lambda _, i: row(i))
        places = F.array_compact(F.transform(words, lambda w, i: F.when(starting(w), i)))
        return F.transform(places, row)

    bound = F.struct(*[value.alias(name) for name, value in arrays.items()])
    return df.select(key, F.inline_outer(let(bound, rows)))


def _runs(rows: DataFrame, key: str, keep: list[Column], spans: list[Column], name: str) -> DataFrame:
    """The runs that start at each word as rows; a run that is not kept costs no string."""
    runs = [
        F.when(ok, F.struct((F.col("start") + j + 1).alias("end"), span.alias(name)))
        for j, (ok, span) in enumerate(zip(keep, spans))
    ]
    return rows.select(key, "start", F.inline(F.array(*runs))).where(F.col(name).isNotNull())


def ngrams(df: DataFrame, key: str, words: Column, n: int = MAX_WORDS, starting: Callable[[Column], Column] | None = None) -> DataFrame:
    """All runs of 1..n words of a word array as rows (key, start, end, span). No shuffle.

    Each word is first set beside its n - 1 followers; the runs are then
    joined up from plain columns, which compiles to straight code.
    ``starting``: a test of a word; only the runs that begin with such a word are made.
    """
    rows = _beside(df, key, {"w": words}, n, starting)
    keep = [F.col(f"w{j}").isNotNull() for j in range(n)]
    spans = [F.concat_ws(" ", *[f"w{i}" for i in range(j + 1)]) for j in range(n)]
    return _runs(rows, key, keep, spans, "span")


def clean_span(span: Column) -> Column:
    """Letters and blanks only."""
    return F.trim(F.regexp_replace(span, "[^a-zA-Z ]", ""))


def looks_like_error(clean: Column) -> Column:
    return F.length(F.replace(clean, F.lit(" "), F.lit(""))) >= MIN_LETTERS


def words_of(clean: Column) -> Column:
    return F.array_remove(F.split(F.lower(clean), BLANK + "+"), "")


def suspicious_score(clean: Column) -> Column:
    """Share of words that are not common; 0 for no words."""
    return let(
        words_of(clean),
        lambda ws: F.when(F.size(ws) == 0, F.lit(0.0)).otherwise(
            F.size(F.filter(ws, lambda w: ~w.isin(COMMON_WORDS))) / F.size(ws)
        ),
    )


def explode_ngrams(df: DataFrame, key: str, text: str, n: int = MAX_WORDS, starting: Callable[[Column], Column] | None = None) -> DataFrame:
    """The runs of the words of a text, or those that begin with a word that passes ``starting``."""
    return ngrams(df, key, tokens(F.col(text)), n, starting)


def word_forms(text: Column) -> Column:
    """The words of a text reduced to lower-case letters, place by place; a word without letters is empty."""
    return F.split(F.lower(F.regexp_replace(squeeze(text_or_empty(text)), "[^a-zA-Z ]", "")), " ")


@dataclass(frozen=True)
class Reach:
    """What a vocabulary asks of a span at least: per group of its terms, the trigrams they have and, per
    length of a span, the least number of those it must have to be accepted for any of them.

    ``groups``: the groups of each trigram; ``needed``: per length a number per group; ``shapes``: the least and
    the most trigrams and letters of a group's terms; ``weights``: of meaning, letters and sound in the score.
    """

    groups: dict[str, tuple[int, ...]]
    needed: tuple[tuple[int, ...], ...]
    across: int
    shapes: tuple[tuple[int, int, int, int], ...]
    weights: tuple[float, float, float]
    threshold: float

    def can(self, found: np.ndarray, forms: list[str]) -> np.ndarray:
        """Whether a form may reach the threshold for a term of each group, ``found`` of whose trigrams it has at most.

        Unlike ``needed`` this knows the form itself: its distinct trigrams bound the semantic score too.
        """
        least, most, shortest, longest = np.array(self.shapes, float).T
        length = np.array([[len(f)] for f in forms], float)
        own = np.array([[len({p[i : i + 3] for i in range(max(len(p) - 2, 1))})] for p in (f" {f} " for f in forms)], float)
        n, size = np.clip(found, least, most), np.clip(length, shortest, longest)
        semantic = np.minimum(1.0, np.minimum(np.minimum(found, n), own) / np.sqrt(own * n))
        letters = 2 * np.minimum(length, size) / (length + size)
        bound = self.weights[0] * semantic + self.weights[1] * letters + self.weights[2]
        return bound >= self.threshold - 1e-9


# A word of more trigrams than this, and a need above it, count as this many.
MOST_COUNTED = 8000
# Words tested at a time, and words a task remembers.
WORDS_AT_A_TIME, WORDS_KEPT = 50_000, 200_000
_NO_LETTER = re.compile("[^a-zA-Z]")


class _Words:
    """What a task knows of the words it has met: form, letters, whether they count, trigrams per group of terms."""

    def __init__(self, reach: Reach) -> None:
        self.reach, self.common = reach, set(COMMON_WORDS)
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.forms: list[str] = []
        self.facts = np.zeros((1024, 3 + len(self.reach.shapes)), np.int16)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.places) > WORDS_KEPT:
            self.forget()
        new = set(words) - self.places.keys()
        first = len(self.forms)
        self.places.update(zip(new, range(first, first + len(new))))
        while len(self.facts) < len(self.places):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        of, has = self.reach.groups.get, []
        for place, word in enumerate(new, first):
            form = _NO_LETTER.sub("", word).lower()
            self.forms.append(form)
            self.facts[place, :3] = min(len(form), MOST_COUNTED), form != "", form != "" and form not in self.common
            padded = f" {form} "
            has += [(place, 3 + group) for i in range(min(len(form), MOST_COUNTED)) for group in of(padded[i : i + 3], ())]
        if has:
            np.add.at(self.facts, tuple(np.array(has).T), 1)
        return np.array([self.places[w] for w in words], np.int64)


def _reached(words: list[str], left: np.ndarray, known: _Words, n: int) -> Iterator[tuple[np.ndarray, int, list[str]]]:
    """Per number of words the places and forms of the runs worth a look; ``left``: the words of the text from each place on."""
    reach = known.reach
    needed = np.minimum(np.array(reach.needed, np.int64), MOST_COUNTED).astype(np.int16)
    numbers = known.numbers(words)
    spelled = [known.forms[i] for i in numbers.tolist()]
    letters, filled, others = (known.facts[:, i][numbers].astype(np.int64) for i in range(3))
    sums = [np.zeros_like(letters) for _ in range(3)]
    for j in range(min(n, len(words))):
        size = len(words) - j
        sums = [s[:size] + f[j:] for s, f in zip(sums, (letters, filled, others))]
        ok = (left[:size] > j) & (sums[0] >= MIN_LETTERS) & (sums[2] >= MIN_SUSPICION * sums[1])
        starts = np.flatnonzero(ok)
        found = sum(known.facts[numbers[starts + i], 3:] for i in range(j + 1)) + np.int16(reach.across * j)
        enough = found >= needed[np.minimum(sums[0][starts] + j, len(needed) - 1)]
        some = enough.any(axis=1)
        starts = starts[some]
        if len(starts):
            forms = [" ".join(spelled[p : p + j + 1]).strip(" ") for p in starts.tolist()]
            likely = (enough[some] & reach.can(found[some], forms)).any(axis=1)
            yield starts[likely], j + 1, [f for f, keep in zip(forms, likely.tolist()) if keep]


def _reached_spans(df: DataFrame, key: str, text: str, n: int, reach: Reach) -> DataFrame:
    """The candidate spans within reach. Words are looked at once per task, runs are sums over their words."""
    schema = T.StructType([df.schema[key], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                           T.StructField("form", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(reach)
        for batch in batches:
            # Python parts words at the same blanks as ``tokens``.
            texts = [(t or "").split() for t in batch.column(1).to_pylist()]
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (size == 0 or size + len(texts[last]) <= WORDS_AT_A_TIME):
                    size += len(texts[last])
                    last += 1
                sizes = np.array([len(t) for t in texts[first:last]], np.int64)
                words = [w for t in texts[first:last] for w in t]
                begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
                left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
                text_of = np.repeat(np.arange(first, last), sizes)
                for places, length, spelled in _reached(words, left, known, n):
                    if len(places):
                        starts = (places - begins[places]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(text_of[places])), pa.array(starts), pa.array(starts + np.int32(length)), pa.array(spelled, pa.string())],
                            names=[key, "start", "end", "form"])
                first = last

    return df.select(key, text).mapInArrow(rows, schema)


def candidate_spans(df: DataFrame, key: str, text: str, n: int = MAX_WORDS, reach: Reach | None = None) -> DataFrame:
    """The runs worth a look in the vocabulary: (key, start, end, form), form being the lower-case clean span.

    The text is cleaned once as a whole, not run by run; letters and common
    words of a run are sums over its words, and the spelling of a run is left
    to those that are corrected in the end. ``reach`` drops runs that no term
    of the vocabulary can accept. No shuffle.
    """
    if reach:
        return _reached_spans(df, key, text, n, reach)
    rows = _beside(df, key, {"w": word_forms(F.col(text))}, n)
    keep, spans = [], []
    letters, words, others = F.lit(0), F.lit(0), F.lit(0)
    for j in range(n):
        w = F.col(f"w{j}")
        letters = letters + F.length(w)
        words = words + (w != "").cast("int")
        others = others + ((w != "") & ~w.isin(COMMON_WORDS)).cast("int")
        keep.append(w.isNotNull() & (letters >= MIN_LETTERS) & (others >= MIN_SUSPICION * words))
        spans.append(F.trim(F.concat_ws(" ", *[f"w{i}" for i in range(j + 1)])))
    return _runs(rows, key, keep, spans, "form")


def _free(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Which spans, taken in this order, overlap none taken before. Taken words are marked, so a test costs a span's own length."""
    taken, kept = bytearray(int(ends.max(initial=0))), []
    for place, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\x01" * (end - start)
            kept.append(place)
    return kept


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _accepted(starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else _free(s, e) for s, e in zip(starts, ends)], dtype="object")


def select_spans(hits: Column) -> Column:
    """The accepted ones of a transcript's hits: longest first, then leftmost, none overlapping.

    ``hits`` are structs with ``start`` and ``end``. They are ordered and picked as columns; the places to pick come
    from one pass over a transcript's spans.
    """
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct((h["start"] - h["end"]).alias("o"), h["start"].alias("s"), h.alias("h"))))
    places = _accepted(ordered["h"]["start"], ordered["h"]["end"])
    bound = F.struct(ordered["h"].alias("hits"), places.alias("places"))
    return let(bound, lambda p: F.transform(p["places"], lambda i: F.get(p["hits"], i)))


def apply_corrections(words: Column, chosen: Column) -> Column:
    """The words with each chosen span (start, end, candidate) replaced, joined by blanks."""
    covered = F.flatten(
        F.transform(
            chosen,
            lambda c: F.transform(
                F.sequence(c["start"], c["end"] - 1),
                lambda i: F.struct(i.alias("key"), F.when(i == c["start"], c["candidate"]).otherwise("").alias("value")),
            ),
        )
    )

    def replaced(p: Column) -> Column:
        return F.array_join(
            F.array_remove(
                F.transform(p["words"], lambda w, i: F.coalesce(F.element_at(p["by_place"], i), w)), ""
            ),
            " ",
        )

    pair = F.struct(words.alias("words"), F.map_from_entries(covered).alias("by_place"))
    untouched = F.array_join(words, " ")
    return F.when(F.coalesce(F.size(chosen), F.lit(0)) <= 0, untouched).otherwise(let(pair, replaced))


def highlight_spans(text: Column, corrected: Column) -> Column:
    """A text as parts in order, the first place of each corrected term marked.

    Marks are taken by position; a mark that begins before the last one's end
    still gives its own part, as a plain cut between them is left out.
    """

    def parts(p: Column) -> Column:
        markers = F.array_sort(
            F.filter(
                F.transform(
                    p["terms"],
                    lambda t, i: F.struct(
                        F.call_function("locate", F.lower(t), p["lowered"]).alias("start"),
                        i.alias("order"),
                        F.length(t).alias("length"),
                    ),
                ),
                lambda m: m["start"] > 0,
            )
        )

        def step(acc: Column, m: Column) -> Column:
            plain = F.substring(p["text"], acc["pos"], m["start"] - acc["pos"])
            mark = F.substring(p["text"], m["start"], m["length"])
            before = F.when(
                m["start"] > acc["pos"],
                F.array(F.struct(plain.alias("part"), F.lit(False).alias("highlighted"))),
            ).otherwise(_no_parts())
            return F.struct(
                (m["start"] + m["length"]).alias("pos"),
                F.concat(acc["parts"], before, F.array(F.struct(mark.alias("part"), F.lit(True).alias("highlighted")))).alias("parts"),
            )

        def finish(acc: Column) -> Column:
            rest = F.substring(p["text"], acc["pos"], F.length(p["text"]))
            return F.concat(
                acc["parts"],
                F.when(
                    acc["pos"] <= F.length(p["text"]),
                    F.array(F.struct(rest.alias("part"), F.lit(False).alias("highlighted"))),
                ).otherwise(_no_parts()),
            )

        start = F.struct(F.lit(1).alias("pos"), _no_parts().alias("parts"))
        return F.aggregate(markers, start, step, finish)

    bound = F.struct(text.alias("text"), F.lower(text).alias("lowered"), corrected.alias("terms"))
    return let(bound, parts)


def _no_parts() -> Column:
    return F.array().cast("array<struct<part:string,highlighted:boolean>>")
