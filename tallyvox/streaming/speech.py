"""Incremental voice segments and roles of a stream.

Marks of a voice detector arrive as (recording, idx, start_ms, end_ms): a whole segment, an open
start (end -1) or a late end (start -1). The state, a typed value, holds a start that waits for its end.
Energies arrive as (recording, idx, rms); the state holds a list of the last WINDOW positive energies and a value with the last role.

Rows of a recording that arrive together are taken in order of idx. One whose idx isn't above the last one taken is dropped; the state counts them, and
with `counted` each trigger that dropped any gives a row with the recording's count so far as `dropped` (null in other rows) and nulls besides. With idle_ms, a
recording's state is let go after that time without rows, by the processing time or by the event time `clock`, which has a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyvox.streaming.state import clocked, mode_of, on_disk, watch

WINDOW, LEAST = 128, 3


def paired(start: int, end: int, pending: int | None) -> tuple[int | None, tuple[int, int] | None]:
    """The pending start after a mark, and the segment that it completes, if any."""
    if end < 0:
        return start, None
    if start >= 0:
        return None, (start, end)
    return None, (pending, end) if pending is not None else None


class Ordered(StatefulProcessor):
    """Rows of a recording in order of idx; what a row gives is up to the kind of stream. `head` begins with the last idx and the count of dropped rows."""

    head_schema, columns, width = "", (), 0

    def __init__(self, idle_ms: int | None, event_time: bool, counted: bool):
        self.idle_ms, self.event_time, self.counted = idle_ms, event_time, counted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", f"last_idx bigint, dropped bigint, {self.head_schema}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, latest = [], 0
        for part in rows:
            latest = max(latest, int(part["clock"].max()))
            waiting += [r for r in zip(*(part[c].tolist() for c in self.columns)) if not pd.isna(r[0])]
        last_idx, dropped, *held = self.head.get() if self.head.exists() else (None, 0, *self.fresh())
        state, out, before = self.opened(held), [], dropped
        for idx, *row in sorted(waiting):
            if last_idx is not None and idx <= last_idx:
                dropped += 1
                continue
            last_idx = int(idx)
            out += [(key[0], *r) for r in self.taken(state, last_idx, *row)]
        self.head.update((last_idx, dropped, *self.closed(state)))
        if self.idle_ms is not None:
            watch(self.handle, (latest if self.event_time else timerValues.getCurrentProcessingTimeInMs()) + self.idle_ms)
        if self.counted:
            out = [(*r, None) for r in out] + ([(key[0], *[None] * self.width, dropped)] if dropped > before else [])
        yield pd.DataFrame(out, columns=[*self.names(), *["dropped"] * self.counted], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.let_go()
        yield pd.DataFrame([], columns=[*self.names(), *["dropped"] * self.counted], dtype=object)

    def let_go(self) -> None:
        self.head.clear()


class Pairing(Ordered):
    head_schema, columns, width = "pending bigint", ("idx", "start_ms", "end_ms"), 2

    def __init__(self, min_speech_ms: int, *timing):
        super().__init__(*timing)
        self.min_speech_ms = min_speech_ms

    def names(self) -> list[str]:
        return ["recording", "start_ms", "end_ms"]

    def fresh(self) -> list:
        return [None]

    def opened(self, held: list) -> list:
        return held

    def taken(self, state: list, idx: int, start: int, end: int) -> list[tuple]:
        state[0], segment = paired(int(start), int(end), state[0])
        return [segment] if segment and segment[1] - segment[0] >= self.min_speech_ms else []

    def closed(self, state: list) -> list:
        return state


def stream_of(rows: DataFrame, processor: Ordered, schema: str, clock: str | None) -> DataFrame:
    on_disk(rows.sparkSession)
    known = clocked(rows, ["recording", *processor.columns], clock).withColumn("recording", F.col("recording").cast("string"))
    return known.groupBy("recording").transformWithStateInPandas(processor, schema + (", dropped bigint" if processor.counted else ""), "append", mode_of(processor.idle_ms, clock))


def segments_stream(marks: DataFrame, min_speech_ms: int = 300, idle_ms: int | None = None, clock: str | None = None, counted: bool = False) -> DataFrame:
    """recording, start_ms, end_ms of the segments that marks complete; shorter ones are dropped."""
    return stream_of(marks, Pairing(min_speech_ms, idle_ms, clock is not None, counted), "recording string, start_ms bigint, end_ms bigint", clock)


def observed(rms: float, recent: list[float], last: str | None, near_field: float) -> tuple[str, float, float, str]:
    """Role, confidence, ratio and source of one energy; recent is changed."""
    if rms > 0:
        recent.append(rms)
        del recent[:-WINDOW]
    if len(recent) < LEAST:
        return "UNKNOWN", 0.0, 0.0, "warmup"
    middle = median(recent)
    ratio = rms / middle if middle > 0 else 0.0
    if ratio >= near_field:
        return "OPERATOR", min(1.0, ratio / near_field * 0.6), ratio, "energy"
    if ratio <= 1 / near_field:
        return "CALLER", 0.6, ratio, "energy"
    if last == "CALLER":
        return "OPERATOR", 0.5, ratio, "prior"
    return "UNKNOWN", 0.3, ratio, "energy"


class Roles(Ordered):
    head_schema, columns, width = "last string", ("idx", "rms"), 6

    def __init__(self, near_field: float, *timing):
        super().__init__(*timing)
        self.near_field = near_field

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "rms double")

    def names(self) -> list[str]:
        return [c.split()[0] for c in ROLES.split(", ")]

    def fresh(self) -> list:
        return [None]

    def opened(self, held: list) -> list:
        return [held[0], [x for (x,) in self.recent.get()] if self.recent.exists() else []]

    def taken(self, state: list, idx: int, rms: float) -> list[tuple]:
        found = observed(float(rms), state[1], state[0], self.near_field)
        state[0] = found[0]
        return [(idx, rms, *found)]

    def closed(self, state: list) -> list:
        if state[1]:
            self.recent.put([(x,) for x in state[1]])
        return state[:1]

    def let_go(self) -> None:
        super().let_go()
        self.recent.clear()


ROLES = "recording string, idx bigint, rms double, role string, confidence double, ratio double, source string"


def roles_stream(energies: DataFrame, near_field: float = 1.6, idle_ms: int | None = None, clock: str | None = None, counted: bool = False) -> DataFrame:
    """recording, idx, rms, role, confidence, ratio, source; rows of a batch are taken in order of idx. A null rms counts as silence."""
    known = energies.withColumn("rms", F.coalesce(F.col("rms").cast("double"), F.lit(0.0)))
    return stream_of(known, Roles(near_field, idle_ms, clock is not None, counted), ROLES, clock)
