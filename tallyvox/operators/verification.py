"""Whole recordings against their tickets: transcripts, roles, alignment and reports, for any number of tickets at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.functions.text import normalise
from tallyvox.operators import alignment, speech
from tallyvox.operators.matching import Matcher
from tallyvox.settings import Settings
from tallyvox.sources import reports


class Run(NamedTuple):
    """segments with roles and transcripts, events, states and documents (ticket_id, metadata, summary, segments, items, alerts)."""

    segments: DataFrame
    events: DataFrame
    states: DataFrame
    documents: DataFrame
    held: tuple[DataFrame, ...]

    def release(self) -> None:
        """Lets go of what was held on the executors' disks."""
        for df in self.held:
            df.unpersist()


def heard(segments: DataFrame, transcriber, settings: Settings | None = None) -> DataFrame:
    """segments (ticket_id, idx, start_ms, end_ms, rms, wave, ...) with transcript and role; the wave goes no further than the transcriber."""
    said = speech.transcribed(segments, transcriber).drop("wave")
    near = (settings or Settings()).near_field
    return speech.temporal_prior(speech.role_bands(said, ("ticket_id",), near), ("ticket_id",))


def verified(segments: DataFrame, tickets: DataFrame, items: DataFrame, matcher: Matcher, settings: Settings | None = None) -> Run:
    """segments: as heard() gives them; tickets: as reports.documents() takes them; items: ticket_id, seq, pos, raw, norm.

    Transcripts come from a model and scores from Python, so both are computed once and held on disk until release();
    what a lost executor held is computed again. A ticket without segments has a report all the same.
    """
    settings = settings or matcher.settings
    said = segments.persist(StorageLevel.DISK_ONLY)
    utterances = said.select("ticket_id", "idx", "role", "text", normalise(F.col("text")).alias("heard"))
    both = alignment.events_and_states(alignment.prepared(utterances, items, matcher), settings).persist(StorageLevel.DISK_ONLY)
    events = both.filter("event is not null").select("event.*")
    states = both.filter("state is not null").select("state.*")
    rows = reports.segment_rows(events, said)
    documents = reports.documents(tickets, said, rows, alignment.report(states, events, items))
    return Run(said, events, states, documents, (both, said))
