"""Line dedup across documents, with keep bitmaps instead of texts.

Hashes of line keys are range-partitioned by (hash, document) with a secondary
sort by document and position. Range bounds split a hot key between documents,
so no task holds a whole one. Each partition streams its sorted runs into one
row per key (documents that hold it first here, largest document), and those
few rows meet by key. Lines that go are gathered into 64-bit words per
row; only documents that lose a line have any. Texts are read once more
at the end, where the bitmap is applied.

Null and empty texts are one empty line. Keys are compared by two 64-bit
hashes. A line that is repeated inside one document counts for one document.
Rows that repeat a ``doc_id`` count as one document, null ids
as one too, below all others; bitmaps are those of a row, by id and text, so
rows of different texts never lose each other's lines. Empty tables give empty results; only ``doc_id`` and ``text`` are
read, and other columns pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.text import let
from earshot.llm.common import text_id
from earshot.session import via_table

MIN_KEY_CHARS = 20
MIN_DOCUMENTS = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def line_hashes(docs: DataFrame, min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """``doc_id, text_id, pos, h1, h2`` of every line whose key is long enough to count."""
    lines = docs.select("doc_id", text_id(), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.filter(F.char_length("line") >= min_chars).select("doc_id", "text_id", "pos", key_of(F.col("line")).alias("key"))
    return keys.filter(F.char_length("key") >= min_chars).select(
        "doc_id", "text_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_keys(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Keys found in enough documents, with the document that keeps its lines.

    The range exchange puts all rows of one key and document into one task, in
    sorted order; the first row of each such run counts the document.
    """
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.select("h1", "h2", "doc_id", "pos").repartitionByRange(n, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    place = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos"))
    firsts = ranged.withColumn("place", place).filter(F.col("place") == 1)
    return firsts.groupBy("h1", "h2").agg(
        F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_doc")).filter(F.col("n_docs") >= min_documents)


def drop_words(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``doc_id, text_id, words``: sorted (word, bits) of the lines to drop; bit b of word w is line 64 w + b."""
    lines = via_table(line_hashes(docs, min_chars), "line-hashes")
    keys = via_table(repeated_keys(lines, min_documents), "line-keys")
    gone = lines.join(keys, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep_doc")))
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = gone.groupBy("doc_id", "text_id", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def _kept_lines(lines: Column, words: Column) -> Column:
    """``lines`` without those whose bit is set. The sparse words are laid out once for constant-time tests."""
    by_word = F.map_from_entries(words)
    dense = F.transform(F.sequence(F.lit(0), F.element_at(words, -1)["word"]),
                        lambda w: F.coalesce(F.try_element_at(by_word, w), F.lit(0).cast("long")))

    def kept(bits: Column) -> Column:
        def stays(_: Column, i: Column) -> Column:
            word = F.get(bits, F.shiftright(i, 6))
            return F.coalesce(F.getbit(word, i.bitwiseAND(63)), F.lit(0)) == 0

        return F.filter(lines, stays)

    return let(dense, kept)


def kept_texts(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``row`` (all columns as they came), ``n_lines``, ``n_dropped`` and ``kept_text``."""
    words = drop_words(docs.select("doc_id", "text"), min_chars, min_documents).select(
        F.col("doc_id").alias("drop_id"), F.col("text_id").alias("drop_text"), "words")
    rows = docs.select(F.col("doc_id").alias("row_id"), text_id(), F.struct("*").alias("row"))
    joined = rows.join(words, F.col("row_id").eqNullSafe(F.col("drop_id")) & (F.col("text_id") == F.col("drop_text")), "left")
    text = F.coalesce("row.text", F.lit(""))
    whole = F.struct(
        (F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines"),
        text.alias("kept_text"))

    def cut(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        F.array_join(_kept_lines(lines, F.col("words")), "\n").alias("kept_text"))

    dropped = F.coalesce(F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["bits"])),
                         F.lit(0).cast("long"))
    out = F.when(F.col("words").isNull(), whole).otherwise(let(lines_of(F.col("row.text")), cut))
    return joined.select("row", out.alias("out"), dropped.alias("n_dropped")).select(
        "row", "out.n_lines", "n_dropped", "out.kept_text")


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every document."""
    kept = kept_texts(docs.select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` (and ``n_chars``, where there is one) after the lines are gone."""
    kept = kept_texts(docs)

    def column(name: str) -> Column:
        if name == "text":
            return F.when(F.col("row.text").isNotNull(), F.col("kept_text")).alias(name)
        if name == "n_chars":
            return F.char_length("kept_text").cast(docs.schema[name].dataType).alias(name)
        return F.col("row")[name].alias(name)

    return kept.select(*(column(c) for c in docs.columns))
