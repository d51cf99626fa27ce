"""One JSON document per file, an array or an object of many entries, read by many tasks per file.

Entries are parted by commas, so files are read in splits as text between
commas. Whether a comma parts two entries depends on everything before it: on
quotes (is it inside a string) and on brackets (how deep it lies). A first
pass tells for each split what it does to both, once for a beginning inside
a string and once for one outside; one row per split then gives the state every split
begins in. A second pass joins the parts to entries inside each split, a batch of parts at a time; what a split's border cuts
comes from a third pass over the splits with such borders, is put together by split order, and entries are parsed by the built-in parser, one by one.

One row per split (128 MB of input by default) is broadcast. Files need not have line ends. A
backslash and what it escapes never lie on two sides of a comma, as a comma is not escaped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.session import via_table
from earshot.sources.records import BEGIN, END, MIDDLE, WHOLE, lines_of, stitched

_BLANK = " \t\r\n﻿"
# What each byte does to the depth of brackets, and the bytes that are looked at one by one.
_OPENS = np.zeros(256, np.int8)
_OPENS[list(b"[{")], _OPENS[list(b"]}")] = 1, -1


_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _depths(part: str) -> tuple[bool, int, int]:
    """What one part of a document does: whether it changes the side of quotes, and its brackets opened less closed.

    The brackets are counted twice, for a part that begins outside a string and for one that begins inside. Batches go through ``_Marks``.
    """
    sides = _ESCAPED.sub("", part).split('"')

    def opened(texts: list[str]) -> int:
        return sum(t.count("[") + t.count("{") - t.count("]") - t.count("}") for t in texts)

    return len(sides) % 2 == 0, opened(sides[0::2]), opened(sides[1::2])


class _Marks:
    """Quotes and brackets in the parts of a document that follow each other in one array.

    ``turns``: after how many quotes each part ends; ``at``: after how many each bracket stands, ``opens`` what it does to the
    depth, ``last`` how many brackets each part ends after.
    """

    def __init__(self, values: pa.Array) -> None:
        bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
        first, end = int(bounds[0]), int(bounds[-1])
        data = values.buffers()[2]
        data = np.frombuffer(data, np.uint8)[first:end] if data is not None else np.zeros(0, np.uint8)
        ends = bounds[1:].astype(np.int64) - first
        quotes = np.flatnonzero(data == ord('"'))
        deeper = _OPENS[data]
        slashes = np.flatnonzero(data == ord("\\"))
        if len(slashes):
            # What follows an odd number of backslashes in a part is escaped.
            part = np.searchsorted(ends, slashes, "right")
            begins = np.flatnonzero((np.diff(slashes, prepend=-2) != 1) | (np.diff(part, prepend=-1) != 0))
            length = np.diff(begins, append=len(slashes))
            after = slashes[begins] + length
            escaped = after[(length % 2 == 1) & (after < ends[part[begins]])]
            quotes = quotes[~np.isin(quotes, escaped, assume_unique=True)]
            deeper[escaped] = 0
        brackets = np.flatnonzero(deeper)
        self.turns = np.searchsorted(quotes, ends)
        self.at = np.searchsorted(quotes, brackets)
        self.opens = deeper[brackets].astype(np.int64)
        self.last = np.searchsorted(brackets, ends)

    def depth(self, inside: bool) -> np.ndarray:
        """The depth after each part, from 0, of what stands outside strings; ``inside``: whether the first part begins in one."""
        counted = np.where((self.at + inside) % 2 == 0, self.opens, 0)
        return np.concatenate([[0], np.cumsum(counted)])[self.last]


def _runs_of(parts: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches cut where the split (a column of numbers) changes, each with whether its split is a new one."""
    split = None
    for part in parts:
        of = part.column(key).to_numpy()
        borders = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for start, stop in zip(borders, borders[1:]):
            if start < stop:
                yield part.slice(start, stop - start), of[start] != split
                split = of[start]


def _splits(parts: DataFrame) -> DataFrame:
    """``file, block, split, inside, depth, cut``: splits by number, the state each begins in, whether one begins or ends inside an entry.

    Brackets are counted twice, for a split that begins outside a string and for one that begins inside.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            # Files and blocks come in runs: they are told apart by a number that changes with either.
            key = np.cumsum(_changes(batch.column(0)) | _changes(batch.column(1)))
            for run, _ in _runs_of(iter([batch.append_column("run", pa.array(key))]), 3):
                mine = (run.column(0)[0].as_py(), run.column(1)[0].as_py())
                if mine != file:
                    if file is not None:
                        yield row(file, turned, deeper)
                    file, turned, deeper = mine, 0, [0, 0]
                marks = _Marks(run.column(2))
                for begin in (0, 1):
                    deeper[begin] += int(marks.depth(bool(begin ^ turned))[-1])
                turned ^= int(marks.turns[-1]) % 2
        if file is not None:
            yield row(file, turned, deeper)

    def row(file: tuple[str, int], turned: int, deeper: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [file[0]], "block": [file[1]], "turned": [turned], "out": deeper[:1], "within": deeper[1:]})

    schema = "file string, block long, turned long, out long, within long"
    each = parts.select("file", "block", "value").mapInArrow(told, schema)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sides = each.withColumn("inside", F.coalesce(F.sum("turned").over(before), F.lit(0)) % 2 == 1)
    deeper = F.when(F.col("inside"), F.col("within")).otherwise(F.col("out"))
    state = sides.withColumn("deeper", deeper).withColumn("depth", F.coalesce(F.sum("deeper").over(before), F.lit(0)))
    # Only a split that holds whole documents has no piece of an entry for sure.
    opened = F.col("inside") | (F.col("depth") != 0) | (F.col("depth") + F.col("deeper") != 0) | (F.col("turned") == 1)
    cut = opened | F.lead("block").over(order).isNotNull()
    number = F.row_number().over(Window.orderBy("file", "block"))
    return state.withColumn("cut", cut).select("file", "block", number.alias("split"), "inside", "depth", "cut")


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value is unlike the one before."""
    same = pc.equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[False], ~same.astype(bool)])


def _entries(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, pa.Array]]:
    """Split, place, kind and texts of the entries in parts (``split, inside, depth, value``) and of the pieces at the splits' borders.

    The document's own brackets are taken off. Marks are counted and parts joined for a whole batch at a time; place 0 is said of
    pieces with no entry's end before them in their split.
    """
    split, quoted, depth, begun, ended = None, False, 0, True, False
    held: list[str] = []

    def rest() -> Iterator[tuple[int, int, int, pa.Array]]:
        if held:
            yield split, int(ended), BEGIN if begun else MIDDLE, pa.array([",".join(held)], pa.string())
        held.clear()

    for run, new in _runs_of(parts, 0):
        if new:
            yield from rest()
            split, quoted, depth = (run.column(i)[0].as_py() for i in range(3))
            begun, ended = not quoted and depth <= 1, False
        values = run.column(3)
        marks = _Marks(values)
        inside = (marks.turns + quoted) % 2 == 1
        after = marks.depth(quoted) + depth
        before = np.concatenate([[depth], after[:-1]])
        closed = (after == 0) & ~inside
        # A document's first and last part lose its brackets; there are few.
        bare = np.flatnonzero((before == 0) | closed)
        if len(bare):
            texts = values.to_pylist() if len(bare) > 64 else None
            pieces, at = [], 0
            for i in bare.tolist():
                text = texts[i] if texts else values[i].as_py()
                text = text.lstrip(_BLANK)[1:] if before[i] == 0 else text
                text = text.rstrip(_BLANK)[:-1] if closed[i] else text
                pieces += [values.slice(at, i - at), pa.array([text], pa.string())]
                at = i + 1
            values = pa.concat_arrays([*pieces, values.slice(at)])
        quoted, depth = bool(inside[-1]), int(after[-1])
        ends = np.flatnonzero(closed | ((after == 1) & ~inside)) + 1
        if not len(ends):
            held += values.to_pylist()
            continue
        first, last = 0, int(ends[-1])
        if held or not begun:
            first = int(ends[0])
            text = ",".join(held + values[:first].to_pylist())
            yield split, int(ended), WHOLE if begun else END, pa.array([text], pa.string())
            held.clear()
            ends = ends[1:]
        begun = ended = True
        if len(ends):
            bounds = pa.array(np.concatenate([[first], ends]) - first, pa.int32())
            yield split, 1, WHOLE, pc.binary_join(pa.ListArray.from_arrays(bounds, values[first:last]), ",")
        held += values[last:].to_pylist()
    yield from rest()


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, kind, texts in _entries(parts):
        if kind == WHOLE and len(texts):
            yield pa.RecordBatch.from_arrays([texts], names=["text"])


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for split, place, kind, texts in _entries(parts):
        if kind != WHOLE:
            columns = [pa.array([split], pa.int32()), pa.array([place], pa.int64()), pa.array([kind], pa.int32()), texts]
            yield pa.RecordBatch.from_arrays(columns, names=["split", "place", "kind", "text"])


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """``text``: the entries of all documents."""
    parts = lines_of(spark, path, ",")
    # Counted once for its readers: one row per split.
    splits = via_table(_splits(parts), "splits")
    told = ["split", "inside", "depth", "value"]
    whole = parts.join(F.broadcast(splits), ["file", "block"]).select(told).mapInArrow(_whole, "text string")
    # Only splits that an entry crosses into or out of are read a third time.
    cut = parts.join(F.broadcast(splits.where("cut")), ["file", "block"]).select(told).mapInArrow(
        _cut, "split int, place long, kind int, text string").join(F.broadcast(splits), "split")
    crossing = stitched(cut.select("file", "block", "place", "kind", "text"), ",")
    return whole.union(crossing.select("text")).where(F.trim("text", F.lit(_BLANK)) != "")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of JSON arrays, one array per file. An empty array has none; a record that is no object is all nulls."""
    return _texts(spark, path).select(F.from_json("text", schema).alias("r")).select("r.*")


def read_json_object(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """``key, value`` of JSON objects, one object per file. A key that comes twice in a file is given twice."""
    entry = F.concat(F.lit("{"), "text", F.lit("}"))
    keyed = T.MapType(T.StringType(), value)
    return _texts(spark, path).select(F.explode(F.from_json(entry, keyed)).alias("key", "value"))


def _written(entries: DataFrame, brackets: str, path: str) -> None:
    """Texts of entries as documents, one per partition that has any."""

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        opened = False
        for batch in batches:
            # The last entry so far waits for another one: it ends with a comma or the bracket.
            texts = held + batch.column(0).to_pylist()
            if texts and not opened:
                texts[0], opened = brackets[0] + texts[0], True
            held = texts[-1:]
            if len(texts) > 1:
                yield pa.RecordBatch.from_pydict({"value": [t + "," for t in texts[:-1]]})
        if held:
            yield pa.RecordBatch.from_pydict({"value": [held[0] + brackets[1]]})

    entries.mapInArrow(document, "value string").write.mode("overwrite").text(path)


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """Records as JSON arrays, one array and file per partition that has rows."""
    _written(rows.select(F.to_json(F.struct(*rows.columns)).alias("value")), "[]", path)


def write_json_objects(rows: DataFrame, key: str, path: str) -> None:
    """Records as JSON objects by their key, one object and file per partition that has rows."""
    told = F.to_json(F.create_map(F.col(key), F.struct(*[c for c in rows.columns if c != key])))
    _written(rows.select(F.substring(told, F.lit(2), F.length(told) - 2).alias("value")), "{}", path)
