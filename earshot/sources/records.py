"""CSV whose quoted values hold line ends, read by many tasks per file.

Whether a line end lies inside quotes depends on all quotes before it, so the built-in reader takes such a file in one
task. Here the file is read as lines, in splits as any text. A first pass counts the quotes of each split; one
row per split then says whether the split begins inside quotes (the parity of those before it). A second pass joins lines
to records inside each split, a batch of lines at a time. What a split's border cuts, at most the end of one record and the start
of another, comes from a third pass over the splits with such borders and is put together by split order. Records are parsed by the built-in parser, one by one.

One row per split (128 MB of input by default) is broadcast. A value that spans many splits is one value,
put together in one task. Doubled quotes inside quotes are two quotes and change no parity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OPTIONS = {"escape": '"'}
# Kinds of pieces: a whole record; the end of one begun before; the beginning of one; the middle of one.
WHOLE, END, BEGIN, MIDDLE = range(4)


def lines_of(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """``value, file, block``: the parts of files between separators, each with the split it is read in."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


# What a text of CSV is read as.
_lines = lines_of


def _splits(lines: DataFrame) -> DataFrame:
    """``file, block, split, head, inside, cut``: splits by number, whether one begins a file, begins inside quotes, begins or ends so."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    told = odd.select("file", "block", "odd", inside.alias("inside"))
    return told.select("file", "block", F.row_number().over(Window.orderBy("file", "block")).alias("split"), (F.col("block") == 0).alias("head"),
                       "inside", (F.col("inside") | (F.col("odd") == 1)).alias("cut"))


def _records(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.Array]]:
    """Split, place, kind and texts of the records in lines (``split, head, inside, value``), or of pieces of records.

    Quotes are counted and lines joined for a whole batch at a time. Kinds go as those of pieces; the first record of a file
    is left out where it is whole; place 0 is said of pieces with no record's end before them in their split.
    """
    split, quoted, begun, ended, head = None, False, True, False, False
    held: list[str] = []

    def rest() -> Iterator[tuple[int, int, int, pa.Array]]:
        if held:
            yield split, int(ended), BEGIN if begun else MIDDLE, pa.array(["\n".join(held)], pa.string())
        held.clear()

    for part in parts:
        of = part.column(0).to_numpy()
        borders = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for start, stop in zip(borders, borders[1:]):
            if start == stop:
                continue
            if of[start] != split:
                yield from rest()
                split, ended, head, quoted = of[start].item(), False, part.column(1)[start].as_py(), part.column(2)[start].as_py()
                begun = not quoted
            values = part.column(3).slice(start, stop - start)
            after = (np.cumsum(pc.count_substring(values, '"').to_numpy()) + quoted) % 2
            ends, quoted = np.flatnonzero(after == 0) + 1, bool(after[-1])
            if not len(ends):
                held += values.to_pylist()
                continue
            first, last = ends[0], ends[-1]
            if held or not begun or head and not ended:
                # The record that other batches or splits may have begun, or a header.
                text = pa.array(["\n".join(held + values[:first].to_pylist())], pa.string())
                if not begun or not head or ended:
                    yield split, int(ended), WHOLE if begun else END, text
                held.clear()
                begun, whole = True, ends[1:]
            else:
                first, whole = 0, ends
            ended = True
            if len(whole) == last - first:
                yield split, 1, WHOLE, values[first:last]
            elif len(whole):
                bounds = pa.array(np.concatenate([[first], whole]) - first, pa.int32())
                yield split, 1, WHOLE, pc.binary_join(pa.ListArray.from_arrays(bounds, values[first:last]), "\n")
            held += values[last:].to_pylist()
    yield from rest()


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, kind, texts in _records(parts):
        if kind == WHOLE and len(texts):
            yield pa.RecordBatch.from_arrays([texts], names=["text"])


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for split, place, kind, texts in _records(parts):
        if kind != WHOLE:
            columns = [pa.array([split], pa.int32()), pa.array([place], pa.int64()), pa.array([kind], pa.int32()), texts]
            yield pa.RecordBatch.from_arrays(columns, names=["split", "place", "kind", "text"])


def stitched(pieces: DataFrame, separator: str = "\n") -> DataFrame:
    """The records that borders of splits cut, from their pieces in order."""
    cut = pieces.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "place")
    number = F.sum((F.col("kind") == BEGIN).cast("int")).over(order)
    return cut.withColumn("record", number).groupBy("file", "record").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("block", "place", "text")))["text"], separator).alias("text"),
        F.min(F.struct("block", "place")).alias("at")).select("file", "at.block", "at.place", "text")


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of CSV files with a header, as strings; the rows of the built-in reader with ``multiLine``.

    Columns go by the names in the first file's header. Each file's header is its first record; empty lines are no records.
    """
    lines = lines_of(spark, path)
    splits = _splits(lines)
    told = ["split", "head", "inside", "value"]
    whole = lines.join(F.broadcast(splits), ["file", "block"]).select(told).mapInArrow(_whole, "text string")
    # Only splits that a record crosses into or out of are read a third time.
    cut = lines.join(F.broadcast(splits.where("cut")), ["file", "block"]).select(told).mapInArrow(
        _cut, "split int, place long, kind int, text string").join(F.broadcast(splits), "split")
    crossing = stitched(cut.select("file", "block", "place", "kind", "text")).where((F.col("block") > 0) | (F.col("place") > 0))
    names = spark.read.options(header="true", multiLine="false", **_OPTIONS).csv(path).columns
    row = ", ".join(f"`{n}` string" for n in names)
    marked = F.startswith("text", F.lit("\ufeff")) | F.endswith("text", F.lit("\r"))
    text = F.when(marked, F.regexp_replace("text", "^\ufeff|\r$", "")).otherwise(F.col("text"))
    records = whole.union(crossing.select("text")).select(text.alias("text")).where(F.trim("text") != "")
    return records.select(F.from_csv("text", row, _OPTIONS).alias("r")).select("r.*")
