"""Files in: predictions, samples, truth, vocabularies, gate training rows, indexes. Files out: reports."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot import schemas
from earshot.sources import documents
from earshot.sources.records import read_quoted_csv

# Rows of a JSON file whose names are looked at before the read.
NAMES_FROM_ROWS = 100
# Rows of a compressed file.
PACKED_ROWS = 500_000
# A quoted text may go over several lines. Files of this kind that are small by nature are read whole.
_CSV = {"header": "true", "escape": '"', "multiLine": "true"}
# Written texts keep their blanks, and an empty text stays apart from null.
_CSV_OUT = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": '""'}


def read_predictions(spark: SparkSession, path: str, schema: T.StructType = schemas.PREDICTIONS) -> DataFrame:
    """Prediction rows from ``.csv`` (with header) or ``.json`` (one object per line).

    Columns are matched by name. Any other ending is refused; a missing path
    is reported by Spark, which knows every file system the session reaches.
    """
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "csv":
        found = read_quoted_csv(spark, path)
        required = [f.name for f in schema.fields]
        validate_columns(found, required)
        return found.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    if ending == "json":
        # The names in the file decide what is missing; a schema alone would fill it with nulls. Only if the first rows
        # lack a name are all of them read for it.
        names = [f.name for f in schema.fields]
        if set(names) - _names_of(spark.read.text(path).limit(NAMES_FROM_ROWS).collect()):
            validate_columns(spark.read.option("primitivesAsString", True).json(path), names)
        return spark.read.schema(schema).json(path)
    raise ValueError(f"unsupported input file type: .{ending}")


def _names_of(rows: list) -> set[str]:
    """The names that the JSON objects of some lines have; lines that are none have none."""
    names: set[str] = set()
    for row in rows:
        try:
            told = json.loads(row[0])
        except ValueError:
            continue
        names |= set(told) if isinstance(told, dict) else set()
    return names


def validate_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    """Fail on an input without rows; reads no more than it takes to see one."""
    if df.isEmpty():
        raise ValueError("the input has no rows")
    return df


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark samples: JSON arrays of records, one per file, read in splits."""
    return documents.read_json_array(spark, path, schemas.SAMPLES)


def read_truth(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Ground truth: JSON objects keyed by sample id, one object per file, read in splits, or one per line."""
    if whole_file:
        entries = documents.read_json_object(spark, path, schemas.TRUTH_VALUE)
    else:
        keyed = spark.read.text(path).select(F.from_json("value", schemas.TRUTH_DOCUMENT).alias("doc"))
        entries = keyed.select(F.explode("doc"))
    return entries.select(F.col("key").alias("sample_id"), "value.*")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """One term per line, trimmed; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where(F.col("term") != "")


def read_gate_training(spark: SparkSession, path: str) -> DataFrame:
    """Gate training rows from CSV; a byte-order mark before the header is skipped."""
    return spark.read.schema(schemas.GATE_TRAINING).options(**_CSV).csv(path)


def read_index_document(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Indexes of parallel arrays, one document per file or per line, as rows (term, embedding)."""
    documents = spark.read.schema(schemas.INDEX_DOCUMENT).option("multiLine", whole_file).json(path)
    return documents.select(F.inline(F.arrays_zip("terms", "embeddings"))).select(
        F.col("terms").alias("term"), F.col("embeddings").alias("embedding")
    )


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small aggregated report as one CSV file."""
    report.coalesce(1).write.mode("overwrite").options(**_CSV_OUT).csv(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Any number of rows as CSV, one file per partition."""
    rows.write.mode("overwrite").options(**_CSV_OUT).csv(path)


def write_packed_rows(rows: DataFrame, path: str, most: int = PACKED_ROWS) -> None:
    """Any number of rows as compressed CSV. Such a file is read by one task, so none has more than ``most`` rows."""
    rows.write.mode("overwrite").options(**_CSV_OUT, compression="gzip", maxRecordsPerFile=most).csv(path)


def write_records(records: DataFrame, path: str) -> None:
    """Nested records as JSON lines."""
    records.write.mode("overwrite").json(path)
