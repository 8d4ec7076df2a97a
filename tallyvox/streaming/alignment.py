"""Sequential alignment of a stream of utterances, state keyed by ticket.

The state of a ticket is typed: a value with the pointer, the last idx, the last call and the count of dropped rows, and a list of the items' records. A
timer, set anew whenever rows of the ticket arrive, finishes a ticket that has been idle for idle_ms: its pending items become unconfirmed
and its records are let go. A row with the role END finishes it at once.

The rows of a ticket that arrive together are taken in order of idx. A row whose idx isn't above the last one taken (one that comes too late, or twice), or
whose ticket is finished, is dropped: it gives an event of the kind DROPPED, whose message has the ticket's count of them so far, and changes nothing
else. A row without an idx only makes the ticket known. All state is in the checkpoint, so a restarted query goes on where it stopped.

Without idle_ms there are no timers. Idleness is measured by the processing time, or by the event time of a column with a watermark: then results don't depend on when rows arrive. Rows behind the
watermark don't reach the state; Spark drops and counts them itself (numRowsDroppedByWatermark). Rows go in and out singly: most tickets have few in a trigger, and a data frame for each costs more than the fold. By processing time a query runs until it is stopped: its triggers look for idle tickets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyvox.operators.alignment import EVENTS, Progress, Record, finished, started, taken
from tallyvox.settings import Settings
from tallyvox.streaming.state import clocked, mode_of, on_disk, watch

END = "END"
HEAD = "pointer int, last_idx bigint, call_seq int, call_verdict string, dropped bigint, done boolean"
RECORD = "seq int, state string, called boolean, attempts int, score double, heard string, reasons array<string>, conflicts array<string>"
COLUMNS = ["ticket_id", "items", "idx", "role", "text", "heard", "matches"]
DROPPED = "乱序或迟到，未计入（累计 {} 条）"


def bare(ticket: str, idx: int, kind: str, role: str, heard: str, seq: int | None, pointer: int, message: str = "") -> dict:
    """An event without a match."""
    none = {"score": None, "verdict": None, "skipped": [], "is_alert": False, "reasons": [], "conflicts": [], "sentence_similarity": None, "slots": []}
    return {"ticket_id": ticket, "idx": idx, "kind": kind, "role": role, "heard": heard, "seq": seq, "pointer": pointer, "message": message, **none}


class Aligner(StatefulProcessor):
    """Events of one ticket from the rows of each trigger."""

    def __init__(self, settings: Settings, idle_ms: int | None, event_time: bool, keep_ms: int | None):
        self.settings, self.idle_ms, self.event_time, self.keep_ms = settings, idle_ms, event_time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD, self.keep_ms)
        self.records = handle.getListState("records", RECORD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ticket, waiting, items, latest = key[0], [], None, 0
        for row in rows:
            items = row["items"] if items is None else items
            latest = max(latest, row["clock"])
            if row["idx"] is not None:
                waiting.append(tuple(row[c] for c in COLUMNS[2:]))
        progress, dropped, done = self.restored(items)
        events = []
        for idx, role, text, heard, matches in sorted(waiting, key=lambda r: r[0]):
            if done or idx <= progress.last_idx:
                dropped += 1
                events.append(bare(ticket, int(idx), "DROPPED", role or "UNKNOWN", text or "", None, progress.pointer, DROPPED.format(dropped)))
            elif role == END:
                progress.last_idx, done = int(idx) - 1, True
                events += self.closed(ticket, progress)
            else:
                events += taken(progress, ticket, int(idx), role, text, heard, matches, self.settings)
        self.keep(progress, dropped, done)
        if self.idle_ms is not None:
            watch(self.handle, None if done else (latest if self.event_time else timerValues.getCurrentProcessingTimeInMs()) + self.idle_ms)
        yield from (Row(**e) for e in events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        progress, dropped, done = self.restored([])
        events = [] if done else self.closed(key[0], progress)
        self.keep(progress, dropped, True)
        yield from (Row(**e) for e in events)

    def closed(self, ticket: str, progress: Progress) -> list[dict]:
        """The events of items that are unconfirmed now that the ticket is finished."""
        pending = [r for r in progress.records if r.state == "PENDING"]
        finished(progress)
        return [bare(ticket, progress.last_idx + 1, "UNCONFIRMED", END, "", r.seq, progress.pointer) for r in pending]

    def restored(self, items) -> tuple[Progress, int, bool]:
        head = self.head.get()
        if head is None:
            return started(items), 0, False
        pointer, last_idx, seq, verdict, dropped, done = head
        records = [Record(seq, state, called, attempts, score, heard, list(reasons), list(conflicts)) for seq, state, called, attempts, score, heard, reasons, conflicts in (self.records.get() if self.records.exists() else ())]
        return Progress(records, pointer, None if seq is None else (seq, verdict), last_idx), dropped, done

    def keep(self, progress: Progress, dropped: int, done: bool) -> None:
        call = progress.last_call or (None, None)
        self.head.update((progress.pointer, progress.last_idx, *call, dropped, done))
        if done or not progress.records:
            self.records.clear()
        else:
            self.records.put([astuple(r) for r in progress.records])


def aligned_stream(rows: DataFrame, settings: Settings | None = None, idle_ms: int | None = None, clock: str | None = None, keep_ms: int | None = None) -> DataFrame:
    """The events of a stream of rows such as alignment.prepared() gives (scored per batch or upstream).

    idle_ms: after how long an idle ticket is finished. clock: a timestamp column with a watermark for it; without one, the processing time counts. keep_ms: for how long after its last change what is left
    of a finished ticket is kept, so that its late rows are known (processing time only); without it, always. The session's state store is set to RocksDB.
    """
    mode = mode_of(idle_ms, clock)
    if keep_ms is not None and mode != "ProcessingTime":
        raise ValueError("state expires by processing time only")
    on_disk(rows.sparkSession)
    return clocked(rows, COLUMNS, clock).groupBy("ticket_id").transformWithState(Aligner(settings or Settings(), idle_ms, clock is not None, keep_ms), EVENTS, "append", mode)
