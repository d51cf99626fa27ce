"""Best-fit packing by a configuration linear program over the histogram of lengths.

However many pieces there are, they have at most ``capacity`` different
lengths. The driver works on that histogram alone: a configuration is a
multiset of lengths that fits one sequence, and the program asks for the fewest configurations
that cover all counts. It is solved by multiplicative weights: every length
has a price, a knapsack by dynamic programming finds the dearest filling beside each
length, those configurations are bought for a part of what is missing (never
beyond it), and prices of lengths covered faster than the others fall. The fractional
solution is rounded down, and what is left over, a number that depends on the
number of configurations and not on the pieces, is filled best fit first.

Pieces then get their places by rank within their length: ranks come from
counts per block of pieces, so no task holds all pieces of a length, and the
table of configurations, bounded by the rounds and the capacity, says which
sequence and offset a rank has.

Null and empty texts are one piece of the end token. Pieces of equal length, ties and repeated rows among them, are
interchangeable; each row is packed once. Very long texts are tokenised whole. An empty table gives no
rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.bytepair import BytePairs, little_endian
from earshot.llm.common import per_text
from earshot.session import via_table

CAPACITY = 2048
END_ID = 0
# Rounds of multiplicative weights, the part of what is missing that a round buys, and how fast prices move.
ROUNDS = 60
STEP = 0.12
RATE = 2.0
# Parts of the fractional solution that are tried as the whole part, with all its configurations and with only
# those that fill a sequence; the plan with the fewest sequences wins.
PARTS = (1.0, 0.5)
# Pieces in a block whose ranks one window numbers, and the least number of blocks.
BLOCK_ROWS = 100_000
MIN_BLOCKS = 64

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` tokens; only the first may be shorter than the capacity."""
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids and then the end token."""

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        encoder = BytePairs.shared()
        for doc_id, text in texts:
            data = memoryview(little_endian([*encoder.ids(text or ""), END_ID]))
            start = 0
            for piece, length in enumerate(cut(len(data) // 4, capacity)):
                yield doc_id, piece, start, length, crc32(data[4 * start:4 * (start + length)])
                start += length

    return per_text(docs, ["doc_id", "text"], _PIECES, rows, 10_000)


def _fillings(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the best price of each room up to ``capacity`` and the length taken there (0: none)."""
    lengths = np.flatnonzero(prices > 0)
    values = prices[lengths]
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = upto[room]
        best[room] = best[room - 1]
        taken[room] = -1
        if k:
            worth = best[room - lengths[:k]] + values[:k]
            i = int(worth.argmax())
            if worth[i] > best[room]:
                best[room], taken[room] = worth[i], lengths[i]
    for room in range(1, capacity + 1):  # rooms that gain nothing by their last token
        if taken[room] < 0:
            taken[room] = taken[room - 1]
    return best, taken


def configuration_lp(counts: np.ndarray, rounds: int = ROUNDS, step: float = STEP,
                     rate: float = RATE) -> Counter:
    """Configurations (sorted tuples of lengths) and how often the fractional solution uses them.

    ``counts[l]`` is the number of pieces of length ``l``; the capacity is the last index.
    """
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    demand = counts[lengths].astype(float)
    at = np.zeros(capacity + 1, dtype=np.int64)
    at[lengths] = np.arange(len(lengths))
    covered = np.zeros(len(lengths))
    # The price of a length by volume is the best dual solution while sequences can be filled.
    weights = np.ones(len(lengths))
    bought: Counter = Counter()
    for _ in range(rounds):
        missing = np.maximum(demand - covered, 0)
        if not missing.any():
            break
        prices = np.zeros(capacity + 1)
        open_ = missing > 0
        prices[lengths[open_]] = (lengths * weights)[open_] / capacity
        _, taken = _fillings(prices, capacity)
        added = np.zeros(len(lengths))
        order = np.flatnonzero(open_)[::-1]
        for i in order:
            room, config = capacity - lengths[i], [int(lengths[i])]
            while taken[room] > 0:
                config.append(int(taken[room]))
                room -= taken[room]
            need = Counter(config)
            amount = min([step * missing[i], *((missing[at[x]] - added[at[x]]) / n for x, n in need.items())])
            if amount > 0:
                bought[tuple(sorted(config, reverse=True))] += amount
                for length, n in need.items():
                    added[at[length]] += amount * n
        covered += added
        weights *= np.exp(-rate * np.clip(added / demand - step, -1, 4))
        weights /= weights.max()
    return bought


def _best_fit(left: np.ndarray) -> tuple[int, ...]:
    """The largest length left, then always the largest that still fits."""
    room, config = len(left) - 1, []
    while room:
        fits = np.flatnonzero(left[:room + 1])
        if not len(fits):
            break
        length = int(fits[-1])
        n = min(int(left[length]) - config.count(length), room // length)
        if n <= 0:
            left = left.copy()
            left[length] = 0
            continue
        config += [length] * n
        room -= n * length
    return tuple(config)


def _exact_fill(left: np.ndarray) -> tuple[int, ...] | None:
    """A configuration with the largest length left that fills a sequence as far as possible, if its counts allow it."""
    capacity = len(left) - 1
    largest = int(np.flatnonzero(left)[-1])
    room = capacity - largest
    after = left.copy()
    after[largest] -= 1
    # Sums of up to three further lengths, largest first: close fits without a search over all subsets.
    have = np.flatnonzero(after[:room + 1])
    if not len(have):
        return None
    for a in have[::-1][:64]:
        rest = room - int(a)
        if rest == 0:
            return largest, int(a)
        after[a] -= 1
        if rest and after[rest] > 0:
            after[a] += 1
            return largest, int(a), rest
        small = np.flatnonzero(after[1:rest]) + 1 if rest > 1 else np.zeros(0, dtype=np.int64)
        if len(small):
            other = rest - small
            ok = (after[other] > 0) & ((other != small) | (after[small] > 1))
            if ok.any():
                b = int(small[np.flatnonzero(ok)[-1]])
                after[a] += 1
                return largest, int(a), b, rest - b
        after[a] += 1
    return None


def round_down(counts: np.ndarray, bought: Counter) -> list[tuple[tuple[int, ...], int]]:
    """Whole configurations and their numbers, which hold exactly ``counts``."""
    capacity = len(counts) - 1
    plans = [_rounded(counts, bought, part, least) for part in PARTS for least in (0, capacity)]
    return sorted(min(plans, key=lambda plan: sum(plan.values())).items())


def _rounded(counts: np.ndarray, bought: Counter, part: float, least: int) -> Counter:
    """The bought configurations that hold ``least`` tokens or more, rounded down, and best fit for what they leave."""
    left = counts.copy()
    plan: Counter = Counter()

    def use(config: tuple[int, ...], most: int) -> int:
        need = Counter(config)
        times = min([most, *(int(left[length]) // n for length, n in need.items())])
        if times > 0:
            plan[config] += times
            for length, n in need.items():
                left[length] -= n * times
        return times

    capacity = len(counts) - 1
    full = sorted(bought.items(), key=lambda x: (sum(x[0]) < capacity, -x[1], x[0]))
    for config, amount in full:
        if sum(config) >= least:
            use(config, int(part * amount))
    while left.any():
        config = _exact_fill(left)
        if config is None or not use(tuple(sorted(config, reverse=True)), 1 << 60):
            use(_best_fit(left), 1 << 60)
    return plan


class Places:
    """Where the piece of a length and rank stands: sequence and offset."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]) -> None:
        first, by_length = 0, {}
        for config, times in plan:
            offset = 0
            for length, n in sorted(Counter(config).items(), reverse=True):
                by_length.setdefault(length, []).append((n * times, n, first, offset))
                offset += n * length
            first += times
        self.sequences = first
        self.tables = {}
        for length, entries in by_length.items():
            total, n, start, offset = (np.array(x, dtype=np.int64) for x in zip(*entries))
            self.tables[length] = (np.concatenate(([0], total.cumsum())), n, start, offset)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for value in np.unique(length):
            mine = length == value
            ends, n, first, start = self.tables[int(value)]
            k = np.searchsorted(ends, rank[mine], side="right") - 1
            inside = rank[mine] - ends[k]
            sequence[mine] = first[k] + inside // n[k]
            offset[mine] = start[k] + inside % n[k] * value
        return sequence, offset


def ranked(cuts: DataFrame, n_pieces: int) -> DataFrame:
    """The written ``cuts`` with ``rank``: a number from 0 within each length, without gaps.

    Blocks go by the place of a row in its file, so rows with null or repeated ids spread like any others.
    """
    blocks = max(MIN_BLOCKS, -(-n_pieces // BLOCK_ROWS))
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    dealt = cuts.select("*", F.pmod(F.xxhash64(*place), F.lit(blocks)).cast("int").alias("block"), *(c.alias(f"at_{i}") for i, c in enumerate(place)))
    sizes = dealt.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = sizes.select("length", "block", (F.sum("n").over(
        Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("at_0", "at_1")) - 1
    return dealt.withColumn("inside", inside).join(before, ["length", "block"]).withColumn(
        "rank", F.col("before") + F.col("inside")).drop("block", "inside", "before", "at_0", "at_1")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    cuts = via_table(pieces(docs, capacity), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in cuts.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    places = Places(round_down(counts, configuration_lp(counts)))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = places.of(frame["length"].to_numpy(), frame["rank"].to_numpy())
            yield frame.assign(sequence_id=sequence, offset=offset).drop(columns="rank")

    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return ranked(cuts, int(counts.sum())).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "rank").mapInPandas(
        placed, schema)
