"""Rows behind the watermark as a table of their own, beside those on time.

The built-in watermark drops late rows and only counts them. Here each batch
is written whole, every row marked: a row is late when its time is not after
the latest time of all batches before, less the delay. That border is one row
written per batch, so a repeated or resumed batch finds the one it had and
overwrites its rows with the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

_BORDER = "seen timestamp"


def _seen_before(spark: SparkSession, out: str, number: int) -> Column:
    """The latest time of all batches before this one, null for the first."""
    row = spark.read.schema(_BORDER).parquet(f"{out}/border/batch={number - 1}").first() if number else None
    return F.lit(row["seen"] if row else None).cast("timestamp")


def split_late(stream: DataFrame, out: str, delay: str, closes: Column | None = None) -> StreamingQuery:
    """Write all rows of a stream at hand below ``out``, marked late or on time; run again, it goes on with what is new.

    ``closes`` is the time at which a row's group is over, such as its window's
    end; without it that is the row's own ``ts``. A row without a time is on time.
    """
    spark = stream.sparkSession
    over = F.col("ts") if closes is None else closes

    def write(batch: DataFrame, number: int) -> None:
        before = _seen_before(spark, out, number)
        late = F.coalesce(over <= before - F.expr(f"INTERVAL {delay}"), F.lit(False))
        rows = f"{out}/rows/batch={number}"
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(rows)
        latest = spark.read.schema(_marked(stream.schema)).parquet(rows).agg(F.max("ts").alias("ts"))
        border = latest.select(F.greatest(F.col("ts"), before).cast("timestamp").alias("seen"))
        border.write.mode("overwrite").parquet(f"{out}/border/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )


def _marked(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("late", T.BooleanType())])


def marked_rows(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All rows written so far with ``late`` and the number of their ``batch``; each input row once."""
    told = T.StructType([*_marked(schema).fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(told).parquet(f"{out}/rows")


def late_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Rows on time and late by key."""
    return rows.groupBy(*by).agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"))
