"""Sessions of transcript chunks in batch; the streaming forms share the projections.

A session's transcript is one value by definition, so its chunks meet in one
row; everything before that point is per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.entities import extract_entities
from earshot.functions.pii import redact_record
from earshot.functions.records import strip, summary_prompt
from earshot.functions.text import normalize, text_or_empty
from earshot.operators import correction as K
from earshot.operators import gate as G
from earshot.schemas import CORRECTION

MAX_SESSIONS = 50
CHUNK_SECONDS = 4


def ingest(chunks: DataFrame) -> DataFrame:
    """Raw chunks with their normalised text and its entities; a missing session id or place is filled in.

    Row by row, so it is the same on a table and on a stream. A missing id
    is derived from the row's place, time and text, so a second read or a re-run task gives the same one.
    """
    known = [F.col(c).cast("string") for c in ("chunk_index", "ts", "text") if c in chunks.columns]
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in known]))
    derived = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    filled = chunks.withColumns(
        {
            "session_id": F.coalesce(F.nullif(F.col("session_id").cast("string"), F.lit("")), derived),
            "chunk_index": F.coalesce(F.col("chunk_index"), F.lit(0)),
            "text": text_or_empty(F.col("text")),
        }
    )
    cleaned = filled.withColumn("normalized_text", normalize(F.col("text")))
    return cleaned.withColumn("extraction", extract_entities(F.col("normalized_text")))


def _arrival(order: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in order]


def running_transcripts(ingested: DataFrame, order: Sequence[str] = ("chunk_index",)) -> DataFrame:
    """With every chunk the session's raw and normalised transcript so far."""
    so_far = Window.partitionBy("session_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ingested.withColumns(
        {
            "session_raw_transcript": F.concat_ws(" ", F.collect_list("text").over(so_far)),
            "session_corrected_transcript": F.concat_ws(" ", F.collect_list("normalized_text").over(so_far)),
        }
    )


def _in_order(order: Sequence[str], text: str) -> Column:
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("part"))))
    return F.concat_ws(" ", F.transform(parts, lambda p: p["part"]))


def session_transcripts(ingested: DataFrame, order: Sequence[str] = ("chunk_index",)) -> DataFrame:
    """The whole transcript per session, blanks at the ends gone."""
    return ingested.groupBy("session_id").agg(*transcript_columns(order))


def transcript_columns(order: Sequence[str] = ("chunk_index",)) -> list[Column]:
    return [
        strip(_in_order(order, "normalized_text")).alias("normalized_transcript"),
        F.count(F.lit(1)).alias("chunks"),
    ]


def newest_sessions(chunks: DataFrame, arrival: str, keep: int = MAX_SESSIONS) -> DataFrame:
    """The sessions that stay when the first inserted ones are dropped beyond ``keep``."""
    first = chunks.groupBy("session_id").agg(F.min(arrival).alias("first_arrival"))
    return first.orderBy(F.desc("first_arrival"), F.desc("session_id")).limit(keep)


def chunk_windows(chunks: DataFrame, seconds: int = CHUNK_SECONDS) -> DataFrame:
    """What each session collects in consecutive windows of a few seconds."""
    return chunks.groupBy("session_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("chunks"), _in_order(("ts", "chunk_index"), "text").alias("text")
    )


def idle_sessions(chunks: DataFrame, gap: str) -> DataFrame:
    """Transcripts closed by a pause of ``gap`` without a chunk."""
    return chunks.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("chunks"), _in_order(("ts", "chunk_index"), "text").alias("text")
    )


def transcribe_files(
    transcripts: DataFrame,
    index: DataFrame,
    key: str,
    text: str,
    gate: G.Coefficients | PipelineModel | None = G.DEFAULT,
    enabled: bool = True,
) -> DataFrame:
    """Whole transcripts normalised, corrected and searched for entities."""
    cleaned = transcripts.withColumn("_normal", normalize(F.col(text)))
    done = K.correct(cleaned, index, key, "_normal", gate, enabled=enabled)
    return done.withColumn("extraction", extract_entities(F.col("corrected_text"))).drop("_normal", "digits_lost")


def finalize(
    requests: DataFrame,
    transcripts: DataFrame,
    index: DataFrame,
    gate: G.Coefficients | PipelineModel | None = G.DEFAULT,
    enabled: bool = True,
) -> DataFrame:
    """Final records of the requested sessions (session_id, audience).

    Entities come from the un-redacted text, the prompt from the redacted one.
    An unknown session gives an empty record.
    """
    asked = requests.join(transcripts.select("session_id", "normalized_transcript"), "session_id", "left")
    known = F.col("normalized_transcript").isNotNull()
    done = K.correct(asked, index, "session_id", "normalized_transcript", gate, enabled=enabled)
    redacted = done.withColumn("_redaction", redact_record(F.col("corrected_text")))
    return redacted.select(
        "session_id",
        "audience",
        F.coalesce("normalized_transcript", F.lit("")).alias("normalized_transcript"),
        F.coalesce("corrected_text", F.lit("")).alias("corrected_transcript"),
        F.coalesce("corrections", F.array().cast(T.ArrayType(CORRECTION))).alias("corrections"),
        F.when(known, extract_entities(F.col("corrected_text"))).alias("extraction"),
        F.when(known, F.col("_redaction")).alias("redaction"),
        F.when(known, summary_prompt(F.col("_redaction.redacted_text"), F.col("audience"))).alias("prompt"),
    )
