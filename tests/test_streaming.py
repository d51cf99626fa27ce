import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from earshot import schemas
from earshot.operators import sessions as T
from earshot.session import fresh_path
from earshot.streaming import late, live, reorder
from earshot.streaming.reorder import Chunk, releasable

START = dt.datetime(2024, 1, 1)


def chunk(place, at=0):
    return Chunk(place, at, "t", "t")


def test_chunks_wait_for_those_before_them():
    assert releasable([chunk(0), chunk(1), chunk(3, 5_000_000)], 0, 0) == 2
    assert releasable([chunk(3, 5_000_000)], 2, 4_999) == 0
    assert releasable([chunk(3, 5_000_000), chunk(4, 6_000_000)], 2, 5_000) == 2
    assert releasable([chunk(1), chunk(1), chunk(2)], 1, 0) == 3
    assert releasable([], 0, 0) == 0


def sessions(gaps):
    rng = random.Random(3)
    rows = []
    for s in range(12):
        places = [i for i in range(rng.randrange(1, 14)) if not (gaps and rng.random() < 0.25)]
        rows += [(f"s{s}", i, START + dt.timedelta(seconds=60 * s + 4 * i), f"word{i} no  fever") for i in places]
    return rows


@pytest.mark.parametrize("gaps", [False, True])
def test_shuffled_arrival_equals_the_batch_form(spark, gaps):
    rows = spark.createDataFrame(sessions(gaps), schemas.CHUNKS)
    want = {tuple(r) for r in T.running_transcripts(T.ingest(rows)).select(*live.RUNNING.names).collect()}
    stream, delay = live.staged(rows, 3, dealt_by=("session_id", "chunk_index"))
    mark = F.col("ts") == F.lit(live.END_OF_TIME).cast("timestamp")
    ingested = T.ingest(stream).withColumn("session_id", F.when(~mark, F.col("session_id")))
    got = live.drain(reorder.ordered_transcripts(ingested, delay=delay), "t-ordered").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_odd_chunks_and_idle_sessions(spark):
    """Null places and texts, repeated rows, and a session that comes back after its state was dropped."""
    folder = fresh_path(spark, "t-odd")
    deliveries = [
        [("a", None, START, None), ("a", 2, START + dt.timedelta(seconds=8), "third"), ("a", 2, START + dt.timedelta(seconds=8), "third")],
        [("a", 1, START + dt.timedelta(seconds=4), "second")],
        [("b", 0, START + dt.timedelta(hours=5), "other")],
        [("a", 0, START + dt.timedelta(hours=6), "again")],
    ]
    out = fresh_path(spark, "t-odd-out")
    for part in deliveries:
        spark.createDataFrame(part, schemas.CHUNKS).coalesce(1).write.mode("append").parquet(folder)
        stream = live.read_chunks(spark, folder, "*.parquet", schemas.CHUNKS).withColumn("normalized_text", F.col("text"))
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STATE_STORE)
        told = reorder.ordered_transcripts(stream, idle_minutes=60, delay="1 minute")
        query = told.writeStream.format("parquet").option("checkpointLocation", out + "-progress").trigger(availableNow=True).start(out)
        query.awaitTermination()
    got = sorted((r["session_id"], r["chunk_index"], r["session_raw_transcript"]) for r in spark.read.parquet(out).collect())
    assert got == [
        ("a", 0, ""), ("a", 0, "again"), ("a", 1, " second"), ("a", 2, " second third"), ("a", 2, " second third third"), ("b", 0, "other"),
    ]


def test_late_rows_are_all_there(spark):
    """Deliveries one by one, each a batch: late are exactly those behind the latest time of earlier ones less the delay."""
    rng = random.Random(5)
    deliveries = [
        [(f"s{rng.randrange(3)}", n * 100 + i, START + dt.timedelta(minutes=30 * n - rng.randrange(90)), "x") for i in range(40)] for n in range(4)
    ]
    deliveries[2].append(("s0", 999, None, None))
    folder, out = fresh_path(spark, "t-late"), fresh_path(spark, "t-late-out")
    want, seen = {}, None
    for part in deliveries:
        for _, i, ts, _ in part:
            want[i] = seen is not None and ts is not None and ts <= seen - dt.timedelta(minutes=20)
        seen = max([t for *_, t, _ in part if t] + ([seen] if seen else []))
        spark.createDataFrame(part, schemas.CHUNKS).repartition(2).write.mode("append").parquet(folder)
        late.split_late(live.read_chunks(spark, folder, "*.parquet", schemas.CHUNKS), out, "20 minutes").awaitTermination()
    rows = late.marked_rows(spark, out, schemas.CHUNKS)
    assert {r["chunk_index"]: r["late"] for r in rows.collect()} == want and rows.count() == len(want)
    assert 0 < sum(want.values()) < len(want)
    assert sum(r["on_time"] + r["late"] for r in late.late_counts(rows, "session_id").collect()) == len(want)
    late.split_late(live.read_chunks(spark, folder, "*.parquet", schemas.CHUNKS), out, "20 minutes").awaitTermination()
    assert rows.count() == len(want)


def test_a_window_still_open_takes_late_rows(spark):
    folder, out = fresh_path(spark, "t-open"), fresh_path(spark, "t-open-out")
    closes = F.window("ts", "1 hour")["end"]
    for minutes in (50, 5):
        rows = spark.createDataFrame([("a", minutes, START + dt.timedelta(minutes=minutes), "x")], schemas.CHUNKS)
        rows.write.mode("append").parquet(folder)
        late.split_late(live.read_chunks(spark, folder, "*.parquet", schemas.CHUNKS), out, "10 minutes", closes).awaitTermination()
    assert [r["late"] for r in late.marked_rows(spark, out, schemas.CHUNKS).collect()] == [False, False]
