"""Token counts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

A text is the concatenation of pre-tokens: a run of blanks with the
characters up to the next blank or line end, or a line end with the characters that follow it. No
piece of the vocabulary spans such a border (``crosses_borders`` checks it when a
table is built), so the tokens of a text are the sum over its pre-tokens.

First tier: a table of the corpus's frequent pre-tokens and their lengths,
broadcast. Every task sums up what it sees in a bounded summary that drops its
rare half when full, and hands on only its most frequent entries; these few
rows per task are all that is shuffled, and at most ``TABLE_ROWS`` of them
are encoded. Second tier: each worker encodes what the table misses and remembers
it in a bounded cache. Both tiers change speed only, never a count.

Null and empty texts have no bytes and no tokens. Every row is counted by
itself, so repeated rows and ties get equal answers; an empty table gives no rows. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import per_text

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
# Rows of the broadcast table and the longest pre-token in it: its size is bounded by their product.
TABLE_ROWS = 65_536
LONGEST = 48
# Distinct pre-tokens a task sums up at once, and how many of them it hands on.
SUMMARY_ROWS = 200_000
HANDED_ON = 4_096
# Entries a worker remembers beside the table.
CACHE_ROWS = 400_000

_PRE_TOKEN = re.compile(" +[^ \n]*|\n[^ \n]*")
_BORDER = re.compile("[^▁\n][▁\n]|\n.", re.DOTALL)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text that is not empty, with the blank the tokenizer puts in front."""
    return _PRE_TOKEN.findall(" " + text)


def crosses_borders(pieces: list[str]) -> list[str]:
    """Pieces of a vocabulary that reach over a border of pre-tokens."""
    return [p for p in pieces if _BORDER.search(p)]


class PieceCounter:
    """Tokens of pre-tokens and texts by the tokenizer itself, with a worker's cache."""

    _shared: dict[str, PieceCounter] = {}

    def __init__(self, model: str) -> None:
        import public_tokenizers
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        size = self.processor.get_piece_size()
        pieces = [p for i in range(size) if not self.processor.is_control(i) and not self.processor.is_unknown(i)
                  for p in [self.processor.id_to_piece(i)]]
        # Texts are encoded whole should a vocabulary ever have pieces over a border.
        self.whole = bool(crosses_borders(pieces))
        self.cache: dict[str, int] = {}

    @classmethod
    def shared(cls, model: str = MODEL) -> PieceCounter:
        if model not in cls._shared:
            cls._shared[model] = cls(model)
        return cls._shared[model]

    def lengths(self, tokens: list[str]) -> list[int]:
        """Tokens of each pre-token as it counts inside a text."""
        # The tokenizer puts a blank in front: it stands for the first blank of a run, and is one token before a line end.
        bare = [t[1:] if t[0] == " " else t for t in tokens]
        sizes = map(len, self.processor.encode(bare, num_threads=1))
        return [1 if t == " " else n - (t[0] == "\n") for t, n in zip(tokens, sizes)]

    def count(self, text: str, table: dict[str, int]) -> int:
        if not text:
            return 0
        if self.whole or "▁" in text:  # a text's own mark would join the blanks beside it
            return len(self.processor.encode(text, num_threads=1))
        tokens = pre_tokens(text)
        found = list(map(table.get, tokens))
        if None not in found:
            return sum(found)
        missed = [t for t, n in zip(tokens, found) if n is None]
        sizes = {t: self.cache[t] for t in missed if t in self.cache}
        new = list({t for t in missed if t not in sizes})
        if new:
            if len(self.cache) + len(new) > CACHE_ROWS:
                self.cache.clear()
            fresh = dict(zip(new, self.lengths(new)))
            self.cache.update((t, n) for t, n in fresh.items() if len(t) <= LONGEST)
            sizes |= fresh
        return sum(n for n in found if n is not None) + sum(map(sizes.__getitem__, missed))


def _summaries(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The most frequent pre-tokens of one task, from a summary that never holds more than a bound."""
    seen: Counter = Counter()
    for (text,) in rows:
        if text:
            seen.update(pre_tokens(text))
            if len(seen) > SUMMARY_ROWS:
                seen = Counter(dict(seen.most_common(SUMMARY_ROWS // 2)))
    for token, n in seen.most_common(HANDED_ON):
        if len(token) <= LONGEST:
            yield token, n


def frequent_lengths(docs: DataFrame, model: str = MODEL, rows: int = TABLE_ROWS) -> dict[str, int]:
    """The table of the first tier: frequent pre-tokens of all documents and their lengths."""
    summaries = per_text(docs, ["text"], "token string, n long", _summaries, 4_096)
    top = summaries.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(rows)
    tokens = [r["token"] for r in top.select("token").collect()]  # at most ``rows``
    return dict(zip(tokens, PieceCounter.shared(model).lengths(tokens))) if tokens else {}


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, model))

    def rows(texts: Iterator[tuple]) -> Iterator[tuple]:
        counter, known = PieceCounter.shared(model), table.value
        for doc_id, text in texts:
            text = text or ""
            n = counter.count(text, known)
            yield doc_id, len(text.encode("utf-8", "surrogatepass")), n, n > limit

    return per_text(docs, ["doc_id", "text"], "doc_id long, n_bytes long, n_tokens long, over_limit boolean", rows, 10_000)
