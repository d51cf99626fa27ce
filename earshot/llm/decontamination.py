"""Benchmark decontamination: documents scanned for the word windows of test items, in DataFrame operations.

Items and documents are read as words (letters and digits of ASCII, in lower case, and
everything beyond ASCII). Every window of ``WINDOW`` consecutive words of an item is
an n-gram of the set; an item of fewer words is one window. The set, keyed by a 64-bit
hash of the words, is broadcast when its measured bytes allow it, and each document
streams its windows past it; no row leaves the scan but for hits, which are verified by
their words. Above the limit the windows' hashes meet the set by a salted shuffle join, with
the same rows.

Words inside any occurrence of a window are hit. Hits are merged per document by a sorted
window function, so no list of a document's hits is gathered to count them. What is removed
is chosen by the caller: hit spans, or whole documents.

Null and empty texts have no words; they hit nothing, and an item without words has
no window. Null ids of items are one item, written as an empty string; rows that repeat an item id
are one item with all their windows. Rows that repeat a ``doc_id`` (null among them) are told
apart by their text; equal rows get equal answers, each its own row. Very long texts are scanned
whole, word by word, and held in memory once. Empty tables, of either kind, hit nothing. Only
``doc_id`` and ``text`` and the items' ``item_id`` and ``text`` are read; other columns
pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import let
from earshot.llm.common import text_id, text_or_empty, whole_rows
from earshot.session import salted_join, via_table

WINDOW = 10
# Bytes of n-grams, with the overhead of a hash table's row, up to which the set is broadcast.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 96

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
# The same words in a text whose letters have kept their case.
_CASED_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _GAP + "+"), "")


def windows(texts: DataFrame, keys: list[str], lengths: list[int], twice: bool = False) -> DataFrame:
    """``keys, words, pos, length, h`` of every window of the given lengths; ``texts`` has ``keys`` and ``words``.

    Hashes are read straight from the array of words, inside generated code: nothing is built per window.
    ``twice`` adds ``check``, a second hash of the words.
    """
    spots = texts.select(*keys, "words", F.posexplode_outer("words").alias("pos", "word"))

    def hashes(n: int) -> list[Column]:
        mine = [F.get("words", F.col("pos") + i) for i in range(n)]
        return [F.xxhash64(F.lit(n), *mine).alias("h"), *([F.xxhash64(F.lit(-n), *mine).alias("check")] if twice else [])]

    if len(lengths) == 1:
        told = spots.select(*keys, "words", "pos", F.lit(lengths[0]).alias("length"), *hashes(lengths[0]))
    else:
        each = F.explode(F.array(*(F.struct(F.lit(n).alias("length"), *hashes(n)) for n in lengths)))
        told = spots.select(*keys, "words", "pos", each.alias("at")).select(*keys, "words", "pos", "at.*")
    return told.filter(F.col("pos") + F.col("length") <= F.size("words"))


def gram_of() -> Column:
    return F.array_join(F.slice("words", F.col("pos") + 1, F.col("length")), " ")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, h, check, gram, length`` of every window of every item, without repeats."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             words_of(text_or_empty()).alias("words"))
    told = windows(items, ["item"], list(range(1, window + 1)), twice=True)
    own = told.filter(F.col("length") == F.least(F.size("words"), F.lit(window)))
    return own.select("item", "h", "check", gram_of().alias("gram"), "length").distinct()


class TestSet:
    """The written n-grams of a benchmark, with the measure that decides how they travel."""

    __test__ = False  # not a test case

    def __init__(self, benchmark: DataFrame, window: int = WINDOW, limit: int = BROADCAST_BYTES) -> None:
        self.items = via_table(item_windows(benchmark, window), "test-items")
        self.grams = via_table(self.items.select("h", "check", "gram", "length").distinct(), "test-grams")
        size = F.sum(F.octet_length("gram") + ROW_BYTES)
        self.lengths = [r[0] for r in self.grams.select("length").distinct().orderBy("length").collect()]  # at most ``window``
        self.small = (self.grams.agg(size).first()[0] or 0) <= limit
        self.few = (self.items.agg(F.sum(F.octet_length("item") + ROW_BYTES)).first()[0] or 0) <= limit


def hits(docs: DataFrame, tests: TestSet) -> DataFrame:
    """``doc_id, text_id, pos, length, h, check`` of every window of a document that is one of the set, verified."""
    texts = docs.select("doc_id", text_id(), words_of(text_or_empty()).alias("words"))
    spots = windows(texts, ["doc_id", "text_id"], tests.lengths or [WINDOW], twice=not tests.small)
    columns = ["doc_id", "text_id", "pos", "length", "h", "check"]
    if tests.small:
        met = spots.join(F.broadcast(tests.grams.select("h", "check", "gram")), "h")
        return met.filter(gram_of() == F.col("gram")).select(*columns)
    # Words do not travel here: a window is verified by a second hash of them.
    grams = tests.grams.select("h", F.col("check").alias("gram_check"))
    return salted_join(spots.select(*columns), grams, "h", ["text_id", "pos"]).filter(
        F.col("check") == F.col("gram_check")).select(*columns)


def hit_spans(found: DataFrame) -> DataFrame:
    """``doc_id, text_id, start, stop`` of the merged stretches of hit words; ``stop`` is behind the last one."""
    at = found.groupBy("doc_id", "text_id", "pos").agg((F.col("pos") + F.max("length")).alias("stop"))
    by_place = Window.partitionBy("doc_id", "text_id").orderBy("pos")
    before = F.max("stop").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    marked = at.withColumn("new", (before.isNull() | (F.col("pos") > before)).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "text_id", "island").agg(F.min("pos").alias("start"), F.max("stop").alias("stop")).drop("island")


def items_hit(found: DataFrame, tests: TestSet) -> DataFrame:
    """``doc_id, text_id, items``: the sorted ids of the items that have a window in the document."""
    grams = found.select("doc_id", "text_id", "h", "check").distinct()
    items = tests.items.select("item", "h", F.col("check").alias("item_check"))
    if tests.few:
        met = grams.join(F.broadcast(items), "h")
    else:
        met = salted_join(grams, items, "h", ["doc_id", "text_id"])
    pairs = met.filter(F.col("check") == F.col("item_check")).select("doc_id", "text_id", "item").distinct()
    return pairs.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_list("item")).alias("items"))


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_id") == F.col("hit_text"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document."""
    tests = TestSet(benchmark, window)
    found = via_table(hits(docs.select("doc_id", "text"), tests), "hits")
    counts = hit_spans(found).groupBy("doc_id", "text_id").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"))
    told = counts.join(items_hit(found, tests).withColumnRenamed("doc_id", "item_doc").withColumnRenamed("text_id", "item_text"),
                       F.col("doc_id").eqNullSafe(F.col("item_doc")) & (F.col("text_id") == F.col("item_text")))
    hit = told.select(F.col("doc_id").alias("hit_id"), F.col("text_id").alias("hit_text"), "n_hit", "items")
    rows = docs.select("doc_id", text_id(), F.size(words_of(text_or_empty())).cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    return rows.join(hit, _same_row(), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), none).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the words of the spans; what follows a word, up to the next one, goes with it."""
    head = F.regexp_extract(text, f"^{_CASED_GAP}*+", 0)

    def kept(pieces: Column) -> Column:
        def between(span: Column, i: Column) -> Column:
            since = F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0))
            return F.array_join(F.slice(pieces, since + 1, span["start"] - since), "")

        last = F.element_at(spans, -1)["stop"]
        rest = F.array_join(F.slice(pieces, last + 1, F.size(pieces)), "")
        return F.concat(F.array_join(F.transform(spans, between), ""), rest)

    pieces = F.regexp_extract_all(text, F.lit(f"{_CASED_WORD}++{_CASED_GAP}*+"), F.lit(0))
    return F.concat(head, let(pieces, kept))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", max_share: float = 0.0,
                  window: int = WINDOW) -> DataFrame:
    """The documents without test passages, with all their columns.

    ``spans`` cuts the hit words out (``n_chars``, where there is one, follows). ``documents``
    drops every document with more than ``max_share`` of its words hit.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove: spans or documents, not {remove!r}")
    spans = hit_spans(hits(docs.select("doc_id", "text"), TestSet(benchmark, window)))
    hit = spans.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_id").alias("hit_text")).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    met = whole_rows(docs, F.col("doc_id"), text_id()).join(hit, _same_row(), "left")
    if remove == "documents":
        n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
        share = n_hit / F.size(words_of(F.col("row.text")))
        return met.filter(F.col("spans").isNull() | (share <= max_share)).select("row.*")
    cut = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(_without(F.col("row.text"), F.col("spans")))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("cut").alias(name)
        if name == "n_chars":
            return F.when(F.col("spans").isNull(), F.col("row")[name]).otherwise(
                F.char_length("cut")).cast(docs.schema[name].dataType).alias(name)
        return F.col("row")[name].alias(name)

    return met.select("row", "spans", cut.alias("cut")).select(*(column(c) for c in docs.columns))
