"""Running transcripts in the order of places, whatever order the chunks arrive in.

Each session is one key of a state machine: its transcripts so far, the next
place expected, and the chunks that came before their turn. A chunk is given
out when its place is the next one, or when the watermark has passed its time:
places follow time within a session, so nothing that belongs before it can
come any more. One timer per session is set for the first waiting chunk or,
when none waits, for the end of the idle time, which drops the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from earshot.streaming.live import RUNNING

TRANSCRIPTS = "raw string, normalized string, next_place long, last_ms long"
WAITING_KEY = "place long, at long, nth long"
WAITING = "text string, cleaned string"
# Transcripts grow with every chunk, so what is given out at once is bounded by its characters.
OUT_CHARACTERS = 4_000_000


class Chunk(NamedTuple):
    """A chunk in the order it is given out: by place, then time in microseconds, then text."""

    place: int
    at: int
    text: str
    cleaned: str


def releasable(waiting: list[Chunk], next_place: int, watermark_ms: int) -> int:
    """How many of the sorted chunks may be given out: up to the first that has to wait for another."""
    for n, chunk in enumerate(waiting):
        if chunk.place > next_place and chunk.at > watermark_ms * 1000:
            return n
        next_place = max(next_place, chunk.place + 1)
    return len(waiting)


class InPlaceOrder(StatefulProcessor):
    """The state machine of one session; ``idle_ms`` after its last chunk its state is dropped."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", TRANSCRIPTS)
        self.waiting = handle.getMapState("waiting", WAITING_KEY, WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = [
            Chunk(int(place), int(at), text, cleaned)
            for frame in rows
            for place, at, text, cleaned in zip(frame["chunk_index"], frame["at"], frame["text"], frame["normalized_text"])
        ]
        yield from self._advance(key, came, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _advance(self, key: Any, came: list[Chunk], watermark_ms: int) -> Iterator[pd.DataFrame]:
        stored = {tuple(k): Chunk(k[0], k[1], *v) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}
        raw, normalized, next_place, last_ms = self.told.get() if self.told.exists() else (None, None, 0, 0)
        last_ms = max([last_ms, *(c.at // 1000 for c in came)])
        waiting = sorted([*stored.values(), *came])
        ready = releasable(waiting, next_place, watermark_ms)
        rows, size = [], 0
        for chunk in waiting[:ready]:
            raw = chunk.text if raw is None else f"{raw} {chunk.text}"
            normalized = chunk.cleaned if normalized is None else f"{normalized} {chunk.cleaned}"
            next_place = max(next_place, chunk.place + 1)
            rows.append((key[0], chunk.place, raw, normalized))
            size += len(raw) + len(normalized)
            if size > OUT_CHARACTERS:
                yield pd.DataFrame(rows, columns=RUNNING.names)
                rows, size = [], 0
        self._keep(stored, waiting[ready:])
        self._set_timer(waiting[ready:], last_ms, watermark_ms, (raw, normalized, next_place, last_ms))
        if rows:
            yield pd.DataFrame(rows, columns=RUNNING.names)

    def _keep(self, stored: dict[tuple, Chunk], left: list[Chunk]) -> None:
        """Write what came and waits, remove what was given out; equal place and time are numbered apart."""
        keys: dict[tuple, Chunk] = {}
        for chunk in left:
            nth = 0
            while (chunk.place, chunk.at, nth) in keys:
                nth += 1
            keys[(chunk.place, chunk.at, nth)] = chunk
        for gone in stored.keys() - keys.keys():
            self.waiting.removeKey(gone)
        for at, chunk in keys.items():
            if stored.get(at) != chunk:
                self.waiting.updateValue(at, (chunk.text, chunk.cleaned))

    def _set_timer(self, left: list[Chunk], last_ms: int, watermark_ms: int, told: tuple) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        ends = last_ms + self.idle_ms
        if not left and watermark_ms >= ends:
            self.told.clear()
            return
        self.told.update(told)
        due = left[0].at // 1000 + 1 if left else ends
        self.handle.registerTimer(max(due, watermark_ms + 1))


def ordered_transcripts(ingested: DataFrame, idle_minutes: int = 60, delay: str = "10 minutes") -> DataFrame:
    """With every chunk the session's transcripts up to its place, each chunk given once, in order of places.

    Equal to the batch form ordered by place and time as long as places follow
    time and no chunk is later than ``delay``. Places count from 0: up to the
    first gap chunks are given at once, behind it when the watermark has passed
    them. A place that comes again after its turn is added where it arrives. A
    null place is 0, null texts are empty. Chunks behind the watermark are left out; ``late.split_late`` gives them.
    """
    narrow = ingested.select(
        "session_id",
        F.coalesce(F.col("chunk_index").cast("long"), F.lit(0)).alias("chunk_index"),
        "ts",
        F.unix_micros("ts").alias("at"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "normalized_text")),
    )
    return (
        narrow.withWatermark("ts", delay)
        .groupBy("session_id")
        .transformWithStateInPandas(InPlaceOrder(idle_minutes * 60_000), RUNNING, "Append", "EventTime")
    )
