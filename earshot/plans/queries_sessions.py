"""Registered queries: sessions in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.operators import gate as G
from earshot.operators import sessions as T
from earshot.plans import corpus as C
from earshot.plans.queries_correction import heard, index, sql_corrected
from earshot.plans.queries_text import (
    _JOINED,
    _PROMPT,
    ENTITIES,
    REDACTED,
    _sql_strip,
    flat_entities,
    sql_normalize,
    sql_redact_steps,
)
from earshot.plans.registry import query
from earshot.session import fresh_path
from earshot.streaming import late, live, reorder

INGESTED = f"""{C.CHUNKS}, ingested AS (
  SELECT session_id::VARCHAR AS session_id, chunk_index, text, {sql_normalize('text')} AS normalized_text FROM chunks)"""
WHOLE = f"""{INGESTED}, whole AS (SELECT session_id, count(*) AS chunks,
  {_sql_strip("string_agg(normalized_text, ' ' ORDER BY chunk_index)")} AS normalized_transcript FROM ingested GROUP BY session_id)"""


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ingest(C.chunks(spark, sf_dir))


@query(
    "chunk_ingest",
    f"""WITH {INGESTED}, s AS (SELECT session_id, chunk_index, normalized_text AS text FROM ingested),
        {ENTITIES.format(source='s')} SELECT session_id, chunk_index, text AS normalized_text, {_JOINED}, intent, risk_flag FROM entities""",
)
def q_chunk_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingested(spark, sf_dir).select("session_id", "chunk_index", "normalized_text", "extraction")
    return flat_entities(rows, "extraction")


RUNNING = f"""WITH {INGESTED} SELECT session_id, chunk_index,
  string_agg(text, ' ') OVER w AS session_raw_transcript, string_agg(normalized_text, ' ') OVER w AS session_corrected_transcript
  FROM ingested WINDOW w AS (PARTITION BY session_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)"""


@query("session_running", RUNNING)
def q_session_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.running_transcripts(ingested(spark, sf_dir)).select(*live.RUNNING.names)


@query("session_transcript", f"WITH {WHOLE} SELECT session_id, chunks, normalized_transcript FROM whole")
def q_session_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.session_transcripts(ingested(spark, sf_dir))


# Events as chunks: the user is the session, the event's type its text.
EVENT_CHUNKS = """event_chunks AS (SELECT user_id::VARCHAR AS session_id, event_id AS chunk_index, ts, event_type AS text FROM events)"""
_STAMP = "%Y-%m-%d %H:%M:%S"


def as_chunks(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("chunk_index"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("text"),
    )


def event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_chunks(C.table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The events as a stream of several batches, and its delay."""
    return live.staged(event_chunks(spark, sf_dir))


def _stamped(windows: DataFrame) -> DataFrame:
    stamp = "yyyy-MM-dd HH:mm:ss"
    return windows.select(
        "session_id",
        F.date_format("w.start", stamp).alias("window_start"),
        F.date_format("w.end", stamp).alias("window_end"),
        "chunks",
        "text",
    )


@query(
    "session_evict",
    f"""WITH {EVENT_CHUNKS} SELECT session_id, strftime(min(ts), '{_STAMP}') AS first_arrival FROM event_chunks
        GROUP BY session_id ORDER BY min(ts) DESC, session_id DESC LIMIT 50""",
)
def q_session_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = T.newest_sessions(event_chunks(spark, sf_dir), "ts")
    return kept.select("session_id", F.date_format("first_arrival", "yyyy-MM-dd HH:mm:ss").alias("first_arrival"))


TUMBLED = f"""{EVENT_CHUNKS}, tumbled AS (
  SELECT session_id, time_bucket(INTERVAL '4 seconds', ts) AS s, count(*) AS chunks,
         string_agg(text, ' ' ORDER BY ts, chunk_index) AS text FROM event_chunks GROUP BY ALL),
windows AS (SELECT *, s + INTERVAL '4 seconds' AS e FROM tumbled)"""
PAUSED = f"""{EVENT_CHUNKS}, starts AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '6 hours' THEN 1 ELSE 0 END AS fresh
  FROM event_chunks WINDOW w AS (PARTITION BY session_id ORDER BY ts, chunk_index)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, chunk_index ROWS UNBOUNDED PRECEDING) AS n FROM starts),
windows AS (SELECT session_id, n, min(ts) AS s, max(ts) + INTERVAL '6 hours' AS e, count(*) AS chunks,
  string_agg(text, ' ' ORDER BY ts, chunk_index) AS text FROM numbered GROUP BY session_id, n)"""
_WINDOW_ROWS = f"""SELECT session_id, strftime(s, '{_STAMP}') AS window_start, strftime(e, '{_STAMP}') AS window_end, chunks, text
  FROM windows"""
GAP = "6 hours"


@query("chunk_window", f"WITH {TUMBLED} {_WINDOW_ROWS}")
def q_chunk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(T.chunk_windows(event_chunks(spark, sf_dir)))


@query("finalize_on_idle", f"WITH {PAUSED} {_WINDOW_ROWS}")
def q_finalize_on_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(T.idle_sessions(event_chunks(spark, sf_dir), GAP))


@query("stream_chunk_window", f"WITH {TUMBLED} {_WINDOW_ROWS}")
def q_stream_chunk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, delay = event_stream(spark, sf_dir)
    return _stamped(live.drain(live.chunk_windows(chunks, delay=delay), "windows"))


@query("stream_finalize_on_idle", f"WITH {PAUSED} {_WINDOW_ROWS}")
def q_stream_finalize_on_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, delay = event_stream(spark, sf_dir)
    return _stamped(live.drain(live.idle_sessions(chunks, GAP, delay), "idle"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return C.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("turn").alias("chunk_index"),
        F.timestamp_add("SECOND", (F.col("turn") * T.CHUNK_SECONDS).cast("int"), start).alias("ts"),
        C.replace_all(F.col("text"), C.CLINICAL).alias("text"),
    )


def turn_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The turns as ingested chunks in several batches, the end mark without a session kept, and the delay."""
    stream, delay = live.staged(turns(spark, sf_dir))
    mark = F.col("ts") == F.lit(live.END_OF_TIME).cast("timestamp")
    return T.ingest(stream).withColumn("session_id", F.when(~mark, F.col("session_id"))), delay


@query(
    "stream_chunk_ingest",
    f"""WITH {INGESTED}, s AS (SELECT session_id, chunk_index, normalized_text AS text FROM ingested),
        {ENTITIES.format(source='s')} SELECT session_id, chunk_index, text AS normalized_text, {_JOINED}, intent, risk_flag FROM entities""",
)
def q_stream_chunk_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live.drain(turn_stream(spark, sf_dir)[0].where("session_id IS NOT NULL"), "ingest")
    return flat_entities(rows.select("session_id", "chunk_index", "normalized_text", "extraction"), "extraction")


@query("stream_session_running", RUNNING)
def q_stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, delay = turn_stream(spark, sf_dir)
    return live.drain(live.running_transcripts(chunks.where("session_id IS NOT NULL"), delay=delay), "running")


@query("stream_session_transcript", f"WITH {WHOLE} SELECT session_id, chunks, normalized_transcript FROM whole")
def q_stream_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, delay = turn_stream(spark, sf_dir)
    return live.drain(live.session_transcripts(chunks, delay=delay), "transcripts")


@query("stream_session_reordered", RUNNING)
def q_stream_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns arrive shuffled over all batches; transcripts come out in order of places."""
    stream, delay = live.staged(turns(spark, sf_dir), dealt_by=("session_id", "chunk_index"))
    mark = F.col("ts") == F.lit(live.END_OF_TIME).cast("timestamp")
    chunks = T.ingest(stream).withColumn("session_id", F.when(~mark, F.col("session_id")))
    return live.drain(reorder.ordered_transcripts(chunks, delay=delay), "reordered")


# Events in four deliveries by time; every seventh comes one delivery late, every eleventh two.
DELIVERIES = 4
DELIVERED = f"""{EVENT_CHUNKS}, reach AS (SELECT epoch_us(min(ts)) AS low, (epoch_us(max(ts)) - epoch_us(min(ts))) // {DELIVERIES} + 1 AS step FROM event_chunks),
delivered AS (SELECT event_chunks.*, least({DELIVERIES - 1}, (epoch_us(ts) - low) // step
  + CASE WHEN chunk_index % 11 = 0 THEN 2 WHEN chunk_index % 7 = 0 THEN 1 ELSE 0 END) AS delivery FROM event_chunks, reach)"""
LATE_AFTER = "6 hours"
MARKED = f"""{DELIVERED}, latest AS (SELECT delivery, max(max(ts)) OVER (ORDER BY delivery) AS seen FROM delivered GROUP BY delivery),
marked AS (SELECT d.*, coalesce(d.ts <= (SELECT max(seen) FROM latest l WHERE l.delivery < d.delivery) - INTERVAL '{LATE_AFTER}', false) AS late
  FROM delivered d)"""


def delivered(events: DataFrame) -> DataFrame:
    """The chunks of the events with the number of the delivery they come in."""
    at = F.unix_micros("ts")
    low, high = events.agg(F.min(at), F.max(at)).first()
    step = ((high or 0) - (low or 0)) // DELIVERIES + 1
    behind = F.when(F.col("chunk_index") % 11 == 0, 2).when(F.col("chunk_index") % 7 == 0, 1).otherwise(0)
    return events.withColumn("delivery", F.least(F.lit(DELIVERIES - 1), F.floor((at - F.lit(low)) / step) + behind))


def marked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, each delivery a batch of its own, marked late or on time by a stream that goes on where it stopped."""
    chunks = delivered(event_chunks(spark, sf_dir))
    folder, out = fresh_path(spark, "deliveries"), fresh_path(spark, "marked")
    for number in range(DELIVERIES):
        chunks.where(F.col("delivery") == number).write.mode("append").parquet(folder)
        late.split_late(live.read_chunks(spark, folder, "*.parquet", chunks.schema), out, LATE_AFTER).awaitTermination()
    return late.marked_rows(spark, out, chunks.schema)


@query("stream_late_rows", f"WITH {MARKED} SELECT session_id, chunk_index, delivery, late FROM marked")
def q_stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_events(spark, sf_dir).select("session_id", "chunk_index", "delivery", "late")


@query(
    "stream_late_counts",
    f"""WITH {MARKED} SELECT session_id, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late
        FROM marked GROUP BY session_id""",
)
def q_stream_late_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.late_counts(marked_events(spark, sf_dir), "session_id")


# Final records: every user of the events asks for the session of that number, known or not.
REQUESTS = """requests AS (SELECT DISTINCT user_id::VARCHAR AS session_id,
  CASE WHEN user_id % 2 = 0 THEN 'patient' ELSE 'clinician' END AS audience FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    audience = F.when(F.col("user_id") % 2 == 0, "patient").otherwise("clinician")
    return C.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"), audience.alias("audience")
    ).distinct()


_STEPS, _ = sql_redact_steps("asked", "session_id")
_COUNTS = " + ".join(f"len(hits{i})" for i in range(7))
_PROMPT_SQL = _sql_strip(
    f"concat(CASE WHEN a.audience = 'patient' THEN '{_PROMPT['patient']}' ELSE '{_PROMPT['clinician']}' END, r.text)"
)


def _flat_final(done: DataFrame) -> DataFrame:
    hits = F.aggregate("redaction.redactions", F.lit(0), lambda acc, e: acc + e["count"])
    return done.select(
        "session_id", "audience", "normalized_transcript", "corrected_transcript",
        F.col("extraction.intent").alias("intent"),
        F.array_join("extraction.medications", "|").alias("medications"),
        F.col("redaction.redacted_text").alias("redacted_text"),
        hits.alias("redactions"),
        "prompt",
    )


@query(
    "finalize_session",
    f"""WITH {WHOLE}, {REQUESTS}, joined AS (SELECT session_id, audience, normalized_transcript FROM requests LEFT JOIN whole USING (session_id)),
        asked AS (SELECT session_id, normalized_transcript AS text FROM joined),
        {_STEPS}, {ENTITIES.format(source='asked')}
        SELECT a.session_id, a.audience, coalesce(a.normalized_transcript, '') AS normalized_transcript,
          coalesce(a.normalized_transcript, '') AS corrected_transcript,
          CASE WHEN a.normalized_transcript IS NOT NULL THEN e.intent END AS intent,
          CASE WHEN a.normalized_transcript IS NOT NULL THEN array_to_string(e.medications, '|') END AS medications,
          r.text AS redacted_text, {_COUNTS} AS redactions,
          CASE WHEN a.normalized_transcript IS NOT NULL THEN {_PROMPT_SQL} END AS prompt
        FROM joined a JOIN entities e USING (session_id) JOIN {REDACTED} r USING (session_id)""",
)
def q_finalize_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = T.session_transcripts(ingested(spark, sf_dir))
    return _flat_final(T.finalize(requests(spark, sf_dir), transcripts, index(spark), enabled=False))


def _misheard_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = C.chunks(spark, sf_dir).withColumn("text", C.replace_all(F.col("text"), C.RAW_ERRORS))
    return T.session_transcripts(T.ingest(heard))


# The transcripts of the asked sessions as the raw system hears them, corrected by the gate.
_HEARD = C.CHUNKS.replace(C.sql_replace_all("text", C.CLINICAL), C.sql_replace_all(C.sql_replace_all("text", C.CLINICAL), C.RAW_ERRORS), 1)
_HEARD_SESSIONS = f"""{WHOLE.replace(C.CHUNKS, _HEARD, 1)}, {REQUESTS}, known AS (SELECT session_id AS doc_id, coalesce(normalized_transcript, '') AS text
  FROM requests JOIN whole USING (session_id))"""


@query(
    "finalize_session_corrected",
    f"""WITH {sql_corrected(True, 'known', _HEARD_SESSIONS)},
        joined AS (SELECT requests.session_id, audience, normalized_transcript, rewritten.text AS corrected
          FROM requests LEFT JOIN whole USING (session_id) LEFT JOIN rewritten ON rewritten.doc_id = requests.session_id),
        asked AS (SELECT session_id, corrected AS text FROM joined),
        {_STEPS}, {ENTITIES.format(source='asked')}
        SELECT a.session_id, a.audience, coalesce(a.normalized_transcript, '') AS normalized_transcript,
          coalesce(a.corrected, '') AS corrected_transcript,
          CASE WHEN a.normalized_transcript IS NOT NULL THEN e.intent END AS intent,
          CASE WHEN a.normalized_transcript IS NOT NULL THEN array_to_string(e.medications, '|') END AS medications,
          r.text AS redacted_text, {_COUNTS} AS redactions,
          CASE WHEN a.normalized_transcript IS NOT NULL THEN {_PROMPT_SQL} END AS prompt
        FROM joined a JOIN entities e USING (session_id) JOIN {REDACTED} r USING (session_id)""",
)
def q_finalize_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_final(
        T.finalize(requests(spark, sf_dir), _misheard_transcripts(spark, sf_dir), index(spark), G.DEFAULT)
    )


@query(
    "file_transcribe",
    f"""WITH {C.MISHEARD}, n AS (SELECT doc_id, {sql_normalize('text')} AS text FROM misheard), {ENTITIES.format(source='n')}
        SELECT doc_id, text AS corrected_text, {_JOINED}, intent, risk_flag FROM entities""",
)
def q_file_transcribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.misheard(spark, sf_dir).select("doc_id", "text")
    done = T.transcribe_files(docs, index(spark), "doc_id", "text", enabled=False)
    return flat_entities(done.select("doc_id", "corrected_text", "extraction"), "extraction")


_NORMAL = f"{C.MISHEARD}, normal AS (SELECT doc_id, {sql_normalize('text')} AS text FROM misheard)"


@query(
    "file_transcribe_corrected",
    f"""WITH {sql_corrected(True, 'normal', _NORMAL)}, {ENTITIES.format(source='rewritten')}
        SELECT doc_id, text AS corrected_text, {_JOINED}, intent, risk_flag FROM entities""",
)
def q_file_transcribe_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = T.transcribe_files(heard(spark, sf_dir), index(spark), "doc_id", "text", G.DEFAULT)
    return flat_entities(done.select("doc_id", "corrected_text", "extraction"), "extraction")
