"""Live sessions: chunk streams in, running and closed transcripts out.

State is keyed by session and held in the state store, so it survives a lost
executor. The keep-the-newest-sessions rule of a single process does not
distribute; here a session's state expires after an idle time of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from earshot.operators import sessions as B
from earshot.session import fresh_path

RUNNING = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("session_raw_transcript", T.StringType()),
        T.StructField("session_corrected_transcript", T.StringType()),
    ]
)
_STATE = T.StructType([T.StructField("raw", T.StringType()), T.StructField("normalized", T.StringType())])


def read_chunks(spark: SparkSession, folder: str, files: str, schema: T.StructType, per_batch: int | None = None) -> DataFrame:
    """A stream over the matching parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def running_transcripts(ingested: DataFrame, idle_minutes: int = 60, delay: str = "10 minutes") -> DataFrame:
    """With every chunk the session's transcripts so far, chunks of one batch by place.

    The state of a session is its two transcripts; it is dropped when the
    watermark passes the last chunk by ``idle_minutes``.
    """

    def extend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        raw, normalized = state.get if state.exists else (None, None)
        chunks = pd.concat(list(batches)).sort_values(["chunk_index", "ts"], kind="stable")
        rows = []
        for place, text, cleaned in zip(chunks["chunk_index"], chunks["text"], chunks["normalized_text"]):
            raw = text if raw is None else f"{raw} {text}"
            normalized = cleaned if normalized is None else f"{normalized} {cleaned}"
            rows.append((key[0], place, raw, normalized))
        state.update((raw, normalized))
        last = int(chunks["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_minutes * 60_000)
        yield pd.DataFrame(rows, columns=RUNNING.names)

    narrow = ingested.select("session_id", F.col("chunk_index").cast("long"), "ts", "text", "normalized_text")
    return (
        narrow.withWatermark("ts", delay)
        .groupBy("session_id")
        .applyInPandasWithState(extend, RUNNING, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


# Stands after every chunk of a finished table, and is still a time that pandas holds in nanoseconds.
END_OF_TIME = "2261-01-01 00:00:00"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ended(chunks: DataFrame, folder: str) -> DataFrame:
    """The end mark behind the written slices of a table, and the stream over all of them."""
    spark = chunks.sparkSession
    mark = [F.lit(END_OF_TIME).cast(f.dataType) if f.name == "ts" else F.lit(None).cast(f.dataType) for f in chunks.schema]
    spark.range(1, numPartitions=1).select(*(c.alias(f.name) for c, f in zip(mark, chunks.schema))).write.mode("append").parquet(folder)
    return read_chunks(spark, folder, "*.parquet", chunks.schema, max(1, chunks.rdd.getNumPartitions()))


def staged(chunks: DataFrame, slices: int = 4, dealt_by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """A stream over a finished table, in batches that follow its time, and the delay its watermark needs.

    The table is written in slices of time, one after the other, and then an end
    mark without a session, which lets every window and session close. Files
    of one slice may come in any order; no row is older than a slice's length.
    With ``dealt_by`` rows are dealt to the slices by a hash of these columns
    instead, in no order of time, and the delay is all the time there is.
    """
    spark = chunks.sparkSession
    folder = fresh_path(spark, "staged")
    low, high = chunks.agg(F.min("ts"), F.max("ts")).first()
    if dealt_by:
        for i in range(slices):
            chunks.where(F.pmod(F.xxhash64(*dealt_by), F.lit(slices)) == i).write.mode("append").parquet(folder)
        return _ended(chunks, folder), f"{int((high - low).total_seconds()) + 1 if low else 1} seconds"
    shares = [i / slices for i in range(1, slices)]
    inner = chunks.agg(F.percentile_approx("ts", shares)).first()[0] or []
    edges = sorted({t for t in (low, *inner) if t is not None})
    for begin, end in zip(edges, [*edges[1:], None]):
        part = chunks.where(F.col("ts") >= F.lit(begin))
        (part if end is None else part.where(F.col("ts") < F.lit(end))).write.mode("append").parquet(folder)
    stream = _ended(chunks, folder)
    longest = max((b - a).total_seconds() for a, b in zip(edges, [*edges[1:], high])) if edges else 0
    return stream, f"{int(longest) + 1} seconds"


def session_transcripts(ingested: DataFrame, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Each session's whole transcript once, when no chunk came for ``gap``; its state is dropped then."""
    paused = ingested.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return paused.agg(*B.transcript_columns()).drop("w")


def chunk_windows(chunks: DataFrame, seconds: int = B.CHUNK_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Closed windows; rows later than ``delay`` are dropped and counted in the query's progress."""
    return B.chunk_windows(chunks.withWatermark("ts", delay), seconds)


def idle_sessions(chunks: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions closed by a pause, each given once."""
    return B.idle_sessions(chunks.withWatermark("ts", delay), gap)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run an appending stream over all data at hand into files of the shared folder and read them.

    What belongs to the end mark, rows without a session, is left out here: a filter
    on the stream would be moved below the watermark and take the mark away.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)  # state beyond the heap
    out = fresh_path(spark, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", out + "-progress")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(out)
    return rows.where(F.col("session_id").isNotNull()) if "session_id" in rows.columns else rows


def drain_latest(stream: DataFrame, key: str, label: str) -> DataFrame:
    """Run an updating stream over all data at hand; the last version of each key.

    Each batch writes a folder named by its number, which a repeated batch
    overwrites with the same rows.
    """
    spark = stream.sparkSession
    out = fresh_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", out + "-progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    versions = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    latest = versions.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
    return latest.select("row.*")
