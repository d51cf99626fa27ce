"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows handed to Python at once; their texts are held in memory together.
BATCH_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_id() -> Column:
    """``text_id``: the hash that tells rows apart that share a ``doc_id``."""
    return F.xxhash64(text_or_empty()).alias("text_id")


def per_text(docs: DataFrame, columns: list[str], schema: str,
             rows: Callable[[Iterator[tuple]], Iterator[tuple]], batch: int = BATCH_ROWS) -> DataFrame:
    """Run ``rows`` over the selected columns of each partition, in Arrow batches.

    ``rows`` takes an iterator of tuples and yields tuples of ``schema``; what
    it keeps between rows lives as long as the task. Output goes out in frames
    of ``batch`` rows.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = (row for part in parts for row in zip(*(part[c] for c in columns)))
        out: list[tuple] = []
        for row in rows(source):
            out.append(row)
            if len(out) >= batch:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return docs.select(*columns).mapInPandas(frames, schema)


def fold(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 4. Fold 2 is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)), F.lit(0)).cast("int")


def fold_of(doc_id: int) -> int:
    return crc32(str(doc_id).encode()) % 4


def whole_rows(docs: DataFrame, *keys: Column) -> DataFrame:
    """Every row as one column ``row`` beside the given keys, so that no name can clash."""
    return docs.select(F.struct("*").alias("row"), *keys)


def per_row(df: DataFrame, schema: str, rows: Callable[[Iterator[tuple]], Iterator[tuple]], batch: int = 4096) -> DataFrame:
    """Like ``per_text`` over all columns of ``df``, through Arrow values: nulls stay ``None`` and integers exact."""
    types = to_arrow_schema(T.StructType.fromDDL(schema))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns)))
        todo = rows(source)
        while out := list(islice(todo, batch)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)

    return df.mapInArrow(batches, schema)
