"""Edit distance of very long pairs, of characters or of words.

The built-in distance costs length x length steps in one task. For the few
long pairs an Arrow UDF runs the bit-parallel form (Myers 1999, in Hyyro's
notation) on Python's long integers: one column of the table is one integer,
so a step handles 64 cells per machine word. Its symbols are any values, so
words need no alphabet to be spelled in. Short pairs reach it as nulls.
"""

from __future__ import annotations

import os
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.metrics import edit_distance

# Pairs with more table cells than this take the bit-parallel way.
LONG_PAIR_CELLS = 250_000


# Match masks of the most frequent symbols are kept up to this size; others are made when they come.
MASK_BYTES = 64_000_000


class _Masks(dict):
    """Where each symbol stands in a sequence, as the bits of an integer.

    A mask has as many bits as the sequence has symbols, so those of all
    words of a long text would take the square of its length: only places are kept for rare words.
    """

    def __init__(self, symbols: Sequence) -> None:
        super().__init__()
        self.size = len(symbols) // 8 + 1
        self.places: dict = defaultdict(list)
        for place, symbol in enumerate(symbols):
            self.places[symbol].append(place)
        often = Counter({symbol: len(places) for symbol, places in self.places.items()})
        self.kept = {symbol for symbol, _ in often.most_common(max(64, MASK_BYTES // self.size))}

    def __missing__(self, symbol: object) -> int:
        if symbol not in self.places:
            return 0
        bits = bytearray(self.size)
        for place in self.places[symbol]:
            bits[place >> 3] |= 1 << (place & 7)
        mask = int.from_bytes(bits, "little")
        if symbol in self.kept:
            self[symbol] = mask
        return mask


# Errors the first band allows for; wider ones follow.
FIRST_BAND = 256


def _banded_distance(match: _Masks, rows: int, b: Sequence, most: int) -> int | None:
    """The distance if it is ``most`` or less: the bit-parallel form on the rows around the diagonal only.

    The band (Hyyro 2003) moves down one row per symbol of ``b``, which is no longer than the other sequence.
    """
    if rows - len(b) > most:
        return None
    width = 2 * most + 2
    ones, corner, bottom = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    up, down, distance, first = (ones << (width - most - 1)) & ones, 0, most, most + 1 - width
    hopeless = 2 * most + len(b) - rows
    for place, ch in enumerate(b):
        eq = match[ch]
        eq = (eq >> first if first >= 0 else eq << -first) & ones
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & ones
        right = down | (ones ^ (diagonal | up))
        left = diagonal & up
        if place < rows - most:
            distance += not diagonal & corner
            if distance > hopeless:
                return None
        else:
            distance += bool(right & bottom) - bool(left & bottom)
            bottom >>= 1
        diagonal >>= 1
        up = left | (ones ^ (diagonal | right))
        down = diagonal & right
        first += 1
    return distance if distance <= most else None


def bit_distance(a: Sequence, b: Sequence) -> int:
    """Exact Levenshtein distance of two strings, or of two lists of words."""
    head = len(os.path.commonprefix((a, b)))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    match, band = _Masks(a), FIRST_BAND
    while 4 * band < len(a):
        found = _banded_distance(match, len(a), b, band)
        if found is not None:
            return found
        band *= 4
    rows = len(a)
    ones, last = (1 << rows) - 1, 1 << (rows - 1)
    up, down, distance = ones, 0, rows
    for ch in b:
        eq = match[ch] | down
        diagonal = ((((eq & up) + up) ^ up) | eq) & ones
        right = down | (ones & ~(up | diagonal))
        left = up & diagonal
        if right & last:
            distance += 1
        elif left & last:
            distance -= 1
        right = ((right << 1) | 1) & ones
        up = ((left << 1) & ones) | (ones & ~(right | diagonal))
        down = right & diagonal
    return distance


# Symbols of the pairs held to be compared side by side; unlike pairs of more symbols than ``NEAR_SYMBOLS`` are compared one by one.
SYMBOLS_AT_A_TIME = 8_000_000
NEAR_SYMBOLS = 1_000
# Diagonals on each side of the ends that the first band allows for: so many, and one for so many symbols.
FIRST_OFF, FIRST_SHARE = 8, 32
# Bits of the bands beside each other, and bytes of the table that says where symbols are equal.
LANE_BITS, TABLE_BYTES = 120_000, 1 << 21


def _coded(texts: list[Sequence]) -> list[np.ndarray]:
    """The symbols of texts as numbers that are equal where the symbols are, of one, two or four bytes; the two largest are free."""
    if isinstance(texts[0], str):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    else:
        symbols = pa.array(list(chain.from_iterable(texts)), pa.large_string())
        codes = symbols.dictionary_encode().indices.to_numpy()
    top = codes.max(initial=0)
    codes = codes.astype("<u1" if top < (1 << 8) - 2 else "<u2" if top < (1 << 16) - 2 else "<u4")
    ends = np.cumsum([len(t) for t in texts]).tolist()
    return [codes[start:end] for start, end in zip([0, *ends], ends)]


def _side_by_side(a: list[np.ndarray], b: list[np.ndarray], off: np.ndarray, width: int) -> np.ndarray:
    """Distances of pairs, none of ``a`` shorter than its ``b``, by paths that stay on ``width`` - 1 diagonals, ``off`` of them below the first.

    The bit-parallel band (Hyyro 2003) of all pairs in one integer, a lane of ``width`` bits for each; the top bit of a lane
    stays free for what an addition carries. A common beginning, which costs nothing, makes all ``b`` equally long.
    """
    n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    count, most, size, kind = len(a), int(m.max()), width // 8, a[0].dtype
    none, common = np.iinfo(kind).max, np.iinfo(kind).max - 1
    rows, columns = np.full((count, most + width), none, kind), np.full((most, count), common, kind)
    for lane, (x, y, start, pad) in enumerate(zip(a, b, off.tolist(), (most - m).tolist())):
        rows[lane, start : start + pad] = common
        rows[lane, start + pad : start + pad + len(x)] = x
        columns[pad:, lane] = y
    # The symbols that the bits of each column stand for.
    band = np.lib.stride_tricks.as_strided(rows, (most, count, width), (rows.strides[1], *rows.strides))
    full = (1 << (width - 1)) - 1
    ones = int.from_bytes(full.to_bytes(size, "little") * count, "little")
    lowest = int.from_bytes((b"\x01" + bytes(size - 1)) * count, "little")
    up = int.from_bytes(b"".join((full >> start << start).to_bytes(size, "little") for start in off.tolist()), "little")
    down = free = 0
    line, step = count * size, max(1, TABLE_BYTES // (count * width))
    for first in range(0, most, step):
        equal = band[first : first + step] == columns[first : first + step, :, None]
        table = np.packbits(equal.reshape(-1), bitorder="little").tobytes()
        for at in range(0, len(table), line):
            eq = int.from_bytes(table[at : at + line], "little")
            diagonal = ((((eq & up) + up) ^ up) | eq | down) & ones
            # Steps along the lowest diagonal that cost nothing, counted in each lane.
            free += diagonal & lowest
            right = down | (ones ^ (diagonal | up))
            left = diagonal & up
            diagonal = (diagonal >> 1) & ones
            up = left | (ones ^ (diagonal | right))
            down = diagonal & right

    def lanes(bits: int) -> np.ndarray:
        return np.frombuffer(bits.to_bytes(line, "little"), np.uint8).reshape(count, size)

    def steps(bits: int) -> np.ndarray:
        inside = np.arange(width) < (n - m + off)[:, None]
        return (np.unpackbits(lanes(bits), axis=1, bitorder="little").astype(bool) & inside).sum(axis=1)

    # From the lowest diagonal's value in the last column up to the last row.
    return most - lanes(free)[:, :4].copy().view("<u4")[:, 0].astype(np.int64) + steps(up) - steps(down)


def _banded(pairs: list[tuple[Sequence, Sequence]]) -> list[int]:
    """Exact distances of many pairs, none empty, in bands as wide as they need.

    A path that leaves a band ``off`` diagonals beyond those of both ends costs more than their difference and 2 ``off`` + 1, so
    what a band finds up to that is exact; what is more is an upper bound, which says how wide a band suffices (Ukkonen 1985).
    """
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in pairs]
    codes = _coded([p[side] for side in (0, 1) for p in pairs])
    a, b = codes[: len(pairs)], codes[len(pairs) :]
    n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    out, off = np.zeros(len(pairs), np.int64), FIRST_OFF + m // FIRST_SHARE
    left = np.arange(len(pairs))
    while len(left):
        need = n[left] - m[left] + 2 * off[left] + 2
        alone = (n[left] > NEAR_SYMBOLS) & (2 * need > n[left])
        for i in left[alone].tolist():
            out[i] = bit_distance(*pairs[i])
        left, need = left[~alone], np.maximum(need[~alone], 32)
        # Widths that differ by less than a quarter share a group, as do pairs of about the same length.
        part = np.maximum(8, 1 << (np.log2(need).astype(np.int64) - 2))
        widths = -(-need // part) * part
        order = np.lexsort((-m[left], widths))
        left, widths, again, at = left[order], widths[order].tolist(), [], 0
        while at < len(left):
            width, longest, end = widths[at], m[left[at]], at + 1
            while end < len(left) and (end - at) * width < LANE_BITS and widths[end] == width and m[left[end]] >= 0.85 * longest - 16:
                end += 1
            mine, at = left[at:end], end
            gap = n[mine] - m[mine]
            around = (width - 2 - gap) // 2
            found = out[mine] = _side_by_side([a[i] for i in mine], [b[i] for i in mine], around, width)
            open_ = (found > gap + 2 * around + 1) & (around < m[mine])
            off[mine] = np.minimum((found - gap) // 2 + 1, np.minimum(np.maximum(8, 4 * around), m[mine]))
            again.append(mine[open_])
        left = np.concatenate(again) if again else left[:0]
    return out.tolist()


def distances(pairs: Iterable[tuple[Sequence, Sequence]]) -> list[int]:
    """Exact Levenshtein distances of pairs of strings or of lists of words, many pairs side by side."""
    out: list[int] = []
    held: list[tuple[int, Sequence, Sequence]] = []

    def settle() -> None:
        if held:
            for (at, _, _), found in zip(held, _banded([h[1:] for h in held])):
                out[at] = found
        held.clear()

    size = 0
    for a, b in pairs:
        if a == b or not len(a) or not len(b):
            out.append(0 if a == b else max(len(a), len(b)))
            continue
        out.append(-1)
        held.append((len(out) - 1, a, b))
        size += len(a) + len(b)
        if size > SYMBOLS_AT_A_TIME:
            settle()
            size = 0
    settle()
    return out


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("words", "count", "chars")]))
def _pair_distances(a: pd.Series, b: pd.Series, words: pd.Series, chars: pd.Series) -> pd.DataFrame:
    """Distances of texts by words and by characters, each where it is asked for, and the words of the first."""
    # Baselines of one text are often equal: a pair is compared once per batch.
    pairs = list(zip(a.fillna(""), b.fillna("")))
    each = list(dict.fromkeys(pairs))
    out = pd.DataFrame({"words": [0] * len(each), "count": [0] * len(each), "chars": [0] * len(each)}, dtype="int64")
    if each and words.iloc[0]:
        # Python parts words at the same blanks as ``tokens``.
        out["count"] = [len(x.split()) for x, _ in each]
        out["words"] = distances((x.split(), y.split()) for x, y in each)
    if each and chars.iloc[0]:
        out["chars"] = distances(each)
    place = {pair: i for i, pair in enumerate(each)}
    return out.take([place[pair] for pair in pairs]).reset_index(drop=True)


# Declared volatile: evaluated once, and no filter on its result moves below it.
_pairs_once = _pair_distances.asNondeterministic()


def pair_distances(a: Column, b: Column, words: bool = True, chars: bool = True) -> Column:
    """``words``, ``count`` and ``chars`` of a pair of texts of any length."""
    return _pairs_once(a, b, F.lit(words), F.lit(chars))


@F.pandas_udf(T.DoubleType())
def _word_rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return _rates(ref, hyp, str.split)


@F.pandas_udf(T.DoubleType())
def _char_rate(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return _rates(ref, hyp, str)


def _rates(ref: pd.Series, hyp: pd.Series, parted: Callable[[str], Sequence]) -> pd.Series:
    """Distances of texts over the size of the first (at least 1); a pair is compared once per batch."""
    pairs = list(zip(ref.fillna(""), hyp.fillna("")))
    unlike = [pair for pair in dict.fromkeys(pairs) if pair[0] != pair[1]]
    told = dict(zip(unlike, distances((parted(x), parted(y)) for x, y in unlike)))
    return pd.Series([told[p] / max(1, len(parted(p[0]))) if p in told else 0.0 for p in pairs], dtype="float64")


# The forms SQL functions call: they may stand inside an aggregate, which volatile ones may not.
word_rate_udf = _word_rate
char_rate_udf = _char_rate


@F.pandas_udf(T.LongType())
def _long_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [None if x is None else bit_distance(x, y) for x, y in zip(a, b)]
    return pd.Series(out, dtype="Int64")


@F.pandas_udf(T.LongType())
def _long_word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [None if x is None else bit_distance(list(x), list(y)) for x, y in zip(a, b)]
    return pd.Series(out, dtype="Int64")


# Declared volatile so that the optimizer neither moves a filter on the result
# below the UDF nor evaluates the UDF a second time.
_once = _long_distance.asNondeterministic()
_words_once = _long_word_distance.asNondeterministic()


def long_distance(a: Column, b: Column) -> Column:
    """The distance of a long pair, null for any other."""
    is_long = F.length(a).cast("long") * F.length(b) > LONG_PAIR_CELLS
    return _once(F.when(is_long, a), F.when(is_long, b))


def long_words(a: Column, b: Column) -> Column:
    """Whether two arrays of words are a long pair."""
    return F.size(a).cast("long") * F.size(b) > LONG_PAIR_CELLS


def long_word_distance(a: Column, b: Column) -> Column:
    """The distance of a long pair of arrays of words, null for any other."""
    return _words_once(F.when(long_words(a, b), a), F.when(long_words(a, b), b))


def distance_with(long_result: Column, a: Column, b: Column) -> Column:
    """The long result where there is one, else the built-in distance."""
    return F.coalesce(long_result, edit_distance(a, b).cast("long"))
