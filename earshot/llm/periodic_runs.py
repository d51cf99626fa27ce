"""Periodic runs of words, found from the Lyndon arrays that Baier's grouping yields, and collapsed.

A run is a longest stretch of words with smallest period q that holds its period ``repeats``
times or more and has ``min_words`` words or more. Every run has a root (a stretch of one
period) that is the longest Lyndon word starting at its place, under the order of words or
under the reversed order. Both Lyndon arrays come straight from phase one of Baier's suffix sorter:
suffixes are grouped by their first word, and the groups, from the highest to the lowest, extend
the context of the nearest lower suffixes before their members; when a group is reached, the length of its
context is the length of the longest Lyndon word at its members. Each such word is extended by the
longest common extensions of its two ends, over prefix-doubling ranks, and is a run if it comes out long enough.

Sorting is spared where no run can be: within a run, every stretch of ``anchor_length`` words
has an equal one a period away (proof at that function), so stretches of the text not covered
by repeated anchors hold no word of a run. Each remaining stretch holds its runs whole.

Texts are handled one by one, whole, in the task that reads them; nothing is shuffled. A text of n words
takes memory in proportion to n, and to n log n only where it repeats itself; time is in
proportion to n log n.

Null and empty texts have no words and no run. Equal texts have equal runs (the query's damage
goes by id, and a null id is not damaged). Rows that repeat a ``doc_id`` are handled row by row; an
empty table gives no rows. Among runs of equal exponent the first start, then the smallest period is
the strongest. Only ``doc_id`` and ``text`` are read; other columns pass through ``collapse`` under any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cmp_to_key
from hashlib import sha256
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import per_row

MIN_WORDS = 24
REPEATS = 3
_MAX_ANCHOR = 8
_SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long")

Run = tuple[int, int, int]  # start, length, period


def lyndon_lengths(word: list[int], size: int) -> list[int]:
    """The length of the longest Lyndon word at each place of ``word`` (numbers below ``size``), by Baier's grouping."""
    members: list[list[int]] = [[] for _ in range(size)]
    for i, w in enumerate(word):
        members[w].append(i)
    group = list(word)
    context = [1] * size
    below = list(range(-1, size - 1))
    above = list(range(1, size + 1))
    lengths = [0] * len(word)
    # open_[i + 1] leads to the nearest place up to i whose group is still to come; 0 stands before the text.
    open_ = list(range(len(word) + 1))
    g = size - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        u = context[g]
        for i in mine:
            lengths[i] = u
            open_[i + 1] = i
        counts: dict[int, int] = {}
        for i in mine:
            root = i
            while open_[root] != root:
                root = open_[root]
            while open_[i] != root:
                open_[i], i = root, open_[i]
            if root:
                counts[root - 1] = counts.get(root - 1, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for j, n in counts.items():
            parts.setdefault((group[j], n), []).append(j)
        # The more contexts of this group follow, the higher the new group; each is placed right above its old one.
        for old, n in sorted(parts, key=lambda part: -part[1]):
            new = len(context)
            context.append(context[old] + n * u)
            members.append(parts[old, n])
            for j in parts[old, n]:
                group[j] = new
            over = above[old]
            below.append(old)
            above.append(over)
            above[old] = new
            below[over] = new  # the group being handled is above all that are split, so ``over`` exists
        g = below[g]
    return lengths


def _doubled_ranks(word: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, .. words at each place, until all of a length differ."""
    ranks = [word]
    while True:
        last, half = ranks[-1], 1 << (len(ranks) - 1)
        if len(last) <= half:
            return ranks
        pairs = last[:-half].astype(np.int64) << 32 | last[half:]
        found, rank = np.unique(pairs, return_inverse=True)
        if len(found) == len(pairs):
            return ranks
        ranks.append(rank.astype(np.int32))


def _extend(ranks: list[np.ndarray], low: np.ndarray, high: np.ndarray, back: bool) -> np.ndarray:
    """How many words agree from the places ``low`` and ``high`` on, or before them."""
    n = len(ranks[0])
    done = np.zeros(len(low), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        while True:  # the longest length may agree several times
            if back:
                fits = low - done - step >= 0
                a, b = low - done - step, high - done - step
            else:
                fits = high + done + step <= n
                a, b = low + done, high + done
            at = np.flatnonzero(fits)
            at = at[ranks[k][a[at]] == ranks[k][b[at]]]
            done[at] += step
            if k < len(ranks) - 1 or not len(at):
                break
    return done


def _runs_of_stretch(word: np.ndarray, min_words: int, repeats: int) -> set[Run]:
    """The runs of a text of numbers, by the Lyndon words of both orders."""
    distinct, word = np.unique(word, return_inverse=True)
    size, n = len(distinct), len(word)
    word = word.astype(np.int32)
    low, period = [], []
    for order in (word, size - 1 - word):
        q = np.array(lyndon_lengths(order.tolist(), size), dtype=np.int64)
        # A run goes on beyond its root, on one side at least.
        i = np.arange(n)
        after = (i + q < n) & (word[np.minimum(i + q, n - 1)] == word)
        before = (i > 0) & (word[i - 1] == word[np.minimum(i + q - 1, n - 1)])
        can = np.flatnonzero((q * repeats <= n) & (after | before))
        low.append(can)
        period.append(q[can])
    pairs = np.unique(np.concatenate(low) << 32 | np.concatenate(period))
    low, period = pairs >> 32, pairs & 0xFFFFFFFF
    if not len(low):
        return set()
    ranks = _doubled_ranks(word)
    start = low - _extend(ranks, low, low + period, back=True)
    length = low + period + _extend(ranks, low, low + period, back=False) - start
    long_enough = (length >= min_words) & (length >= repeats * period)
    return set(zip(start[long_enough].tolist(), length[long_enough].tolist(), period[long_enough].tolist()))


def anchor_length(min_words: int, repeats: int) -> int:
    """A length k for which any k words inside a run occur again, one period further or one before.

    A stretch [i, i + k) of a run [s, e) of period q occurs again at i + q if i + q + k <= e, else at
    i - q if i - q >= s. Neither holds only if e - q - k < i < s + q, which needs e - s <= 2 q + k - 2. So k is safe
    if max(min_words, repeats * q) >= 2 q + k - 1 for every q; the least difference lies at q up to ``min_words``.
    """
    least = min(max(min_words, repeats * q) - 2 * q for q in range(1, min_words + 1)) + 1
    return max(1, min(least, _MAX_ANCHOR))


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(27)


def repeated_stretches(ids: np.ndarray, min_words: int, repeats: int) -> list[tuple[int, int]]:
    """``(low, high)`` of the longest stretches covered by anchors that occur twice or more.

    Anchors are compared by hash: two that only share it make a stretch longer, never shorter.
    """
    k = anchor_length(min_words, repeats)
    if len(ids) < min_words:
        return []
    anchors, power = _mixed(ids), np.uint64(0x94D049BB133111EB)
    single, width = anchors, 1
    for _ in range(k - 1):
        anchors = anchors[:-1] * power + single[width:]
        width += 1
    order = np.sort(anchors)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(anchors, twice))
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + k, -1)
    covered = np.concatenate(([0], (np.cumsum(change[:-1]) > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(covered))
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= min_words]


def find_runs(ids: np.ndarray, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> list[Run]:
    """All runs of a text of numbers, by start and period."""
    found: set[Run] = set()
    for low, high in repeated_stretches(ids, min_words, repeats):
        found.update((s + low, n, q) for s, n, q in _runs_of_stretch(ids[low:high], min_words, repeats))
    return sorted(found, key=lambda run: (run[0], run[2]))


def strongest(runs: list[Run]) -> Run:
    """The run with the greatest exact exponent; ties go to the first start, then the smallest period."""
    def order(a: Run, b: Run) -> int:
        return b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]

    return min(runs, key=cmp_to_key(order))


def dropped_words(runs: list[Run], n: int) -> np.ndarray:
    """Which of ``n`` words a run holds behind its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII blanks


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal ones as equal numbers."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.array(list(map(number.__getitem__, words)), dtype=np.int64)


def damaged_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's damage of one document in ten: which word stands at each place, from some place on periodically."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _joined(words: list[bytes], kept: np.ndarray) -> bytes:
    return b" ".join(w for w, k in zip(words, kept.tolist()) if k)


def report(docs: DataFrame, damage: Callable[[int | None, int], np.ndarray | None] | None = damaged_places,
           min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """Number, strongest and digest of the runs of every document, and the digest of its collapsed text."""

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in source:
            words = words_of(text)
            ids = numbered(words)
            place = damage(doc_id, len(words)) if damage else None
            if place is not None:
                ids, words = ids[place], [words[i] for i in place.tolist()]
            runs = find_runs(ids, min_words, repeats)
            best, gone, left = (None,) * 4, 0, b" ".join(words)
            if runs:
                start, length, period = strongest(runs)
                best = start, length, period, 1000 * length // period
                dropped = dropped_words(runs, len(words))
                gone, left = int(dropped.sum()), _joined(words, ~dropped)
            listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
            yield (doc_id, len(runs), *best, sha256(listed).hexdigest(), sha256(left).hexdigest(), len(words), gone)

    return per_row(docs.select("doc_id", "text"), _SCHEMA, rows)


def collapse(docs: DataFrame, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """The documents with every run cut down to its first period; ``n_chars``, where there is one, follows.

    Texts without a run, null ones among them, stay as they are; the words of others are joined by one blank.
    """
    @F.pandas_udf("string")
    def collapsed(texts):
        def one(text):
            words = words_of(text)
            runs = find_runs(numbered(words), min_words, repeats)
            return _joined(words, ~dropped_words(runs, len(words))).decode("utf-8", "surrogatepass") if runs else text

        return texts.map(one, na_action="ignore")

    whole = docs.select(F.struct("*").alias("row"), collapsed("text").alias("cut"))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("cut").alias(name)
        if name == "n_chars":
            return F.when(F.col("cut") == F.col("row.text"), F.col("row")[name]).otherwise(
                F.char_length("cut")).cast(docs.schema[name].dataType).alias(name)
        return F.col("row")[name].alias(name)

    return whole.select(*(column(c) for c in docs.columns))
