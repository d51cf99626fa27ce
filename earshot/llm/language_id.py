"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of up to ``ORDER`` bytes. The probability of a byte is
read in the longest context of the tree; a context passes an unseen byte to the
next shorter one with an escape probability (method C: distinct successors over all
successors plus distinct ones), down to a uniform byte. Statistics are
frozen after training, so a text's code length is an exact sum over its bytes,
and the language with the shortest code is predicted.

Trees are learned from at most ``MAX_DOCS`` documents per language, those with
the smallest hash of their id among rows outside the held-out fold with a
language. Their byte 4-grams are counted by a distributed aggregate; what reaches the
driver and the tasks is one number and its count for each different 4-gram of a language's sample. Nothing of the
sample is left out: all byte values and every context of it are in the tree.

The frozen trees are laid out for array access: languages share tables in groups of ``GROUP``. A 4-gram that the
sample of any language of the group holds has its bits for each of them in one row, found by hash; others take the
escape of their context and the bits of their last three bytes, found alike, or those of the last two, which have
a row each. A group takes about 4 x (4-grams + 2 x 3-grams + 131,072) x ``GROUP`` bytes: some 14 MB for samples of
100,000 different 4-grams, so memory grows with the number of languages and not with its square. Texts are scored
whole, in slices that carry their context over.

A text that is null or has no letter is ``und`` with score 0, and so is every
text if nothing could be learned. Equal code lengths go to the language that is first by
name. Null languages and null ids of documents teach nothing; repeated rows are
scored one by one; an empty table gives no rows. ``lang``, ``source`` and ``doc_id``
are never read when a text is scored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import fold, per_text

UNKNOWN = "und"
ORDER = 3
MAX_DOCS = 1000
# Languages whose tables are shared.
GROUP = 8
# Bytes scored at once.
SLICE = 1 << 20
# Stands for the start of a text; real bytes of this value count as 0xFF, which no text has.
START = 0


def _bytes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return np.where(data == START, np.uint8(0xFF), data)


def _grams(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Byte 4-grams with their counts, per language and text."""
    for lang, text in rows:
        data = np.concatenate((np.zeros(ORDER, np.uint8), _bytes(text or ""))).astype(np.uint32)
        if len(data) > ORDER:
            codes, n = np.unique(data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:], return_counts=True)
            yield from zip([lang] * len(codes), codes.tolist(), n.tolist())


def training_sample(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``lang, text`` of at most ``max_docs`` documents per language, outside the held-out fold."""
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), 11)
    ids = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).select(
        "doc_id", "lang", hashed.alias("h"))
    # The smallest hashes lie below a bound that follows from the number of documents; the rank decides the rest.
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    bound = F.col("h") / float(1 << 53) * F.col("n") < 1.2 * max_docs + 50
    # One row per language: broadcast, so that the rows of a frequent language stay where they are.
    few = ids.join(F.broadcast(sizes.withColumnRenamed("lang", "size_lang")), F.col("lang") == F.col("size_lang")).filter(bound)
    rank = F.expr("row_number() OVER (PARTITION BY lang ORDER BY h, doc_id)")
    chosen = few.withColumn("rank", rank).filter(F.col("rank") <= max_docs).select(F.col("doc_id").alias("chosen_id"))
    return docs.join(F.broadcast(chosen.distinct()), F.col("doc_id") == F.col("chosen_id"), "left_semi").filter(
        "lang IS NOT NULL").select("lang", "text")


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Byte 4-grams and counts of each language."""
    grams = per_text(training_sample(docs, max_docs), ["lang", "text"], "lang string, code long, n long", _grams, 50_000)
    table = grams.groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(table["lang"].to_pylist(), dtype=object)
    codes, n = table["code"].to_numpy(), table["n"].to_numpy()
    return {lang: (codes[langs == lang], n[langs == lang]) for lang in sorted(set(langs.tolist()))}


class Numbering:
    """Places of known numbers in a sorted list, by a hash table with linear probing."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes.astype(np.uint32)
        self.bits = max(4, (4 * len(codes)).bit_length())
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(len(codes), dtype=np.int32)
        at = self._hash(self.codes)
        while len(left):
            free = self.table[at] < 0
            self.table[at[free]] = left[free]  # of several that want a slot, one gets it
            lost = self.table[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 for those that are not known."""
        at = self._hash(codes)
        place = self.table[at]
        open_ = np.flatnonzero(place >= 0)
        if len(self.codes):
            open_ = open_[self.codes[place[open_]] != codes[open_]]
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            place[open_] = self.table[at[open_]]
            open_ = open_[place[open_] >= 0]
            open_ = open_[self.codes[place[open_]] != codes[open_]]
        return place


class Trees:
    """The frozen context trees of some languages."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        k = len(counts)
        four = np.unique(np.concatenate([codes for codes, _ in counts]))
        three = np.unique(np.concatenate((four >> 8, four & 0xFFFFFF)))
        self.four, self.three = Numbering(four), Numbering(three)
        self.bits4 = np.empty((len(four), k), dtype=np.float32)
        self.bits3, self.escape3 = (np.empty((len(three), k), dtype=np.float32) for _ in range(2))
        self.bits2, self.escape2 = (np.empty((1 << 16, k), dtype=np.float32) for _ in range(2))
        tails, heads = self.three.find((four & 0xFFFFFF).astype(np.uint32)), self.three.find((four >> 8).astype(np.uint32))
        for i, (codes, n) in enumerate(counts):
            p = np.full(256, 1 / 256)
            p, _ = self._order(codes, n, 0, np.arange(256), p)
            pairs = np.arange(1 << 16)
            p, _ = self._order(codes, n, 1, pairs, p[pairs & 0xFF])
            self.bits2[:, i] = -np.log2(p)
            p, escape = self._order(codes, n, 2, three, p[three & 0xFFFF])
            self.bits3[:, i], self.escape2[:, i] = -np.log2(p), -np.log2(escape)
            p, escape = self._order(codes, n, 3, four, p[tails])
            self.bits4[:, i] = -np.log2(p)
            contexts, at = np.unique(heads, return_index=True)
            self.escape3[:, i] = 0
            self.escape3[contexts, i] = -np.log2(escape[four[at] >> 8])

    @staticmethod
    def _order(codes: np.ndarray, n: np.ndarray, order: int, grams: np.ndarray, lower: np.ndarray):
        """Probabilities of ``grams`` (context and byte) of an order from those of the order below, and escapes by context."""
        own = codes & ((1 << 8 * (order + 1)) - 1)
        seen, at = np.unique(own, return_inverse=True)
        times = np.bincount(at, n, len(seen))
        contexts, of = np.unique(seen >> 8, return_inverse=True)
        whole = np.bincount(of, times, len(contexts)) + np.bincount(of, minlength=len(contexts))
        escape = _Lookup(contexts, np.bincount(of, minlength=len(contexts)) / whole if len(contexts) else whole, 1.0, order)
        place = np.searchsorted(seen, grams)
        known = place < len(seen)
        known[known] = seen[place[known]] == grams[known]
        p = escape[grams >> 8] * lower
        p[known] = (times / whole[of])[place[known]]
        return p, escape.dense() if order == 2 else escape

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each 4-gram after the other three, a column for each language."""
        place = self.four.find(codes)
        bits = self.bits4[np.maximum(place, 0)] if len(self.bits4) else np.empty((len(codes), self.bits2.shape[1]), np.float32)
        new = np.flatnonzero(place < 0)
        if len(new):
            bits[new] = self._new(codes[new])
        return bits

    def _new(self, codes: np.ndarray) -> np.ndarray:
        head, tail = self.three.find(codes >> np.uint32(8)), self.three.find(codes & np.uint32(0xFFFFFF))
        pair = codes & np.uint32(0xFFFF)
        bits = self.bits2[pair] + self.escape2[codes >> np.uint32(8) & np.uint32(0xFFFF)]
        known = tail >= 0
        bits[known] = self.bits3[tail[known]]
        known = head >= 0
        bits[known] += self.escape3[head[known]]
        return bits


class _Lookup:
    """Values of sorted keys, with one for all others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, other: float, order: int) -> None:
        self.keys, self.values, self.other, self.size = keys, values, other, 1 << 8 * order

    def __getitem__(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), self.other)
        place = np.searchsorted(self.keys, wanted)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == wanted[known]
        out[known] = self.values[place[known]]
        return out

    def dense(self) -> np.ndarray:
        return self[np.arange(self.size)]


class CodeLengths:
    """Frozen context trees of all languages, laid out for array access."""

    _shared: dict[str, CodeLengths] = {}

    @classmethod
    def shared(cls, key: str, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> CodeLengths:
        """The trees of one training, laid out once per Python worker."""
        if key not in cls._shared:
            cls._shared = {key: cls(counts)}
        return cls._shared[key]

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        self.groups = [Trees([counts[lang] for lang in self.langs[i:i + GROUP]]) for i in range(0, len(self.langs), GROUP)]

    def of(self, texts: list[str]) -> np.ndarray:
        """Code length in bits of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        n, group = 0, []
        for i, text in enumerate(texts):
            data = _bytes(text)
            for at in range(0, len(data), SLICE):
                before = data[max(at - ORDER, 0):at]
                group.append((i, np.concatenate((np.full(ORDER - len(before), START, np.uint8), before)), data[at:at + SLICE]))
                n += len(group[-1][2])
                if n >= SLICE:
                    self._add(out, group)
                    n, group = 0, []
        if group:
            self._add(out, group)
        return out

    def _add(self, out: np.ndarray, group: list[tuple]) -> None:
        data = np.concatenate([x for _, before, data in group for x in (before, data)]).astype(np.uint32)
        codes = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        ends = np.cumsum([len(before) + len(data) for _, before, data in group])
        starts = np.concatenate(([0], ends[:-1]))
        # A slice's first bytes are its context: sums start behind it and stop at the next context.
        edges = np.minimum(np.column_stack((starts, ends - ORDER)).ravel(), len(codes))
        bits = np.concatenate([trees.of(codes) for trees in self.groups], axis=1)
        bits = np.concatenate((bits, np.zeros((1, bits.shape[1]), np.float32)))
        sums = np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[::2]
        for (i, _, _), total in zip(group, sums):
            out[i] += total


def identify(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, learned from ``docs``."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(train(docs, max_docs))
    key = uuid.uuid4().hex

    def predict(texts: list[str | None]) -> list[tuple[str, float]]:
        tree = CodeLengths.shared(key, counts.value) if counts.value else None
        lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
        if tree is None:
            return [(UNKNOWN, 0.0)] * len(texts)
        bits = tree.of([t if ok else "" for t, ok in zip(texts, lettered)])
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        return [(tree.langs[b], float(x)) if ok else (UNKNOWN, 0.0) for b, x, ok in zip(best, score, lettered)]

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        size = 0
        for row in source:
            held.append(row)
            size += len(row[2] or "")
            if size >= SLICE or len(held) >= 512:
                yield from ((d, o, *p) for (d, o, _), p in zip(held, predict([t for _, _, t in held])))
                held, size = [], 0
        if held:
            yield from ((d, o, *p) for (d, o, _), p in zip(held, predict([t for _, _, t in held])))

    marked = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "text")
    return per_text(marked, ["doc_id", "held_out", "text"],
                    "doc_id long, held_out boolean, lang_pred string, score double", rows, 10_000)
