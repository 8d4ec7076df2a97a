"""Sequential alignment: utterances in order against a ticket's items, folded into events and item states.

One pure transition function serves batch (applyInPandas by ticket) and streaming (keyed
state by ticket). Candidates are scored beforehand in parallel; the fold only chooses among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvox.operators.matching import Matcher, candidates, scored_pairs
from tallyvox.settings import Settings

DONE = ("VERIFIED", "FLAGGED")
ALERTS = ("FAILED", "SKIP_WARNING", "FLAGGED")
EVENTS = "ticket_id string, idx bigint, kind string, role string, heard string, seq int, score double, verdict string, message string, skipped array<int>, is_alert boolean, pointer int, reasons array<string>, conflicts array<string>, sentence_similarity double, slots array<struct<name:string,expected:string,outcome:string,score:double,required:boolean,conflicting_value:string>>"
SLOT_FIELDS = ("name", "expected", "outcome", "score", "required", "conflicting_value")
STATES = "ticket_id string, seq int, pos int, state string, called boolean, attempts int, score double, heard string, reasons array<string>, conflicts array<string>"


@dataclass
class Record:
    seq: int
    state: str = "PENDING"
    called: bool = False
    attempts: int = 0
    score: float | None = None
    heard: str | None = None
    reasons: list[str] = field(default_factory=list)
    conflicts: list[str] = field(default_factory=list)


@dataclass
class Progress:
    """A ticket's state: its records in order, the pointer, and the last call (seq, verdict)."""

    records: list[Record]
    pointer: int = 0
    last_call: tuple[int, str] | None = None
    last_idx: int = -1

    def place(self, seq: int) -> int:
        """The first position of a seq."""
        return next(i for i, r in enumerate(self.records) if r.seq == seq)

    def dump(self) -> dict:
        return asdict(self)

    @staticmethod
    def restored(d: Mapping) -> Progress:
        return Progress([Record(**r) for r in d["records"]], d["pointer"], tuple(d["last_call"]) if d["last_call"] else None, d["last_idx"])


def step(progress: Progress, text: str, role: str, match_of: Callable[[int], dict | None], settings: Settings) -> dict:
    """Take one utterance in: changes progress and returns the event.

    match_of gives the match of the item at a position: score, verdict, reasons, conflicts, the normalised text heard, and if known sentence_similarity and slots.
    """
    records, n = progress.records, len(progress.records)

    def event(kind: str, message: str, pos: int | None = None, match: dict | None = None, skipped: Iterable[int] = (), reasons: list[str] | None = None) -> dict:
        m = match or {}
        return {
            "kind": kind, "role": role, "heard": text, "seq": None if pos is None else records[pos].seq, "score": m.get("score"), "verdict": m.get("verdict"), "message": message,
            "skipped": list(skipped), "is_alert": kind in ALERTS, "pointer": progress.pointer, "reasons": m.get("reasons", []) if reasons is None else reasons, "conflicts": m.get("conflicts", []),
            "sentence_similarity": m.get("sentence_similarity"), "slots": m.get("slots", []),
        }

    window = range(max(0, progress.pointer - settings.lookback), min(n, progress.pointer + settings.lookahead + 1))
    if not text.strip() or not window:
        return event("CHATTER", "空文本或操作票已走完")
    scored = [(p, m) for p in window if (m := match_of(p)) is not None]
    best = max(scored, key=lambda x: (x[1]["score"], -x[0]), default=None)
    if best is None or best[1]["score"] < settings.chatter:
        top = f"{best[1]['score']:.2f}" if best else "n/a"
        return event("CHATTER", f"对窗口内各条都打不高分(最高{top})，判为无关语音", match=best and best[1])
    match = best[1]
    seq = records[best[0]].seq
    pos = progress.place(seq)
    record, reasons = records[pos], list(match["reasons"])

    def remember() -> None:
        record.score, record.heard, record.reasons, record.conflicts = match["score"], match["heard"], reasons, match["conflicts"]

    if role == "CALLER":
        record.called = True
        if settings.role_aware:
            progress.last_call = (seq, match["verdict"])
            return event("CALL", "唱票已发出", pos, match)
    record.attempts += 1
    if match["score"] > (-1 if record.score is None else record.score):
        remember()
    verdict, why = match["verdict"], "；".join(reasons)

    if record.state in DONE:
        if verdict == "FAIL" and match["conflicts"]:
            record.state = "FAILED"
            remember()
            return event("FAILED", "已完成条目出现矛盾复述：" + why, pos, match)
        better = record.state == "FLAGGED" and verdict == "PASS"
        record.state = "VERIFIED" if better else record.state
        return event("REPEAT", "重复复述，灰区上调为通过" if better else "重复复述已完成的条目", pos, match)
    if record.state == "FAILED":
        if verdict != "PASS":
            return event("FAILED", "疑似说错条目的后续复述仍未通过：" + (why or "得分不足"), pos, match)
        record.state = "VERIFIED"
        remember()
        return event("REPEAT", "后续清晰复述将疑似说错纠正为通过", pos, match)

    if verdict == "REVIEW" and settings.corroborate and not match["conflicts"] and progress.last_call == (seq, "PASS"):
        verdict = "PASS"
        reasons.append("唱票人已清晰念出同一条，灰区上调为通过")
        why = "；".join(reasons)
    current = records[progress.pointer].seq if progress.pointer < n else None
    passed = [r for r in records if current is not None and current <= r.seq < seq and r.state == "PENDING"]
    record.state = {"FAIL": "FAILED", "PASS": "VERIFIED"}.get(verdict, "FLAGGED")
    skipped = [r.seq for r in passed]
    for s in skipped:
        records[progress.place(s)].state = "UNCONFIRMED"
    progress.pointer = pos + 1
    if verdict == "FAIL":
        return event("FAILED", "复述与票面不符：" + (why or "整体相似度过低"), pos, match, skipped, reasons)
    if skipped:
        return event("SKIP_WARNING", f"疑似跳项：第 {', '.join(map(str, skipped))} 条没有复述记录", pos, match, skipped, reasons)
    if verdict == "PASS":
        return event("VERIFIED", "一致", pos, match, (), reasons)
    return event("FLAGGED", "灰区，需人工复核：" + (why or "得分处于灰区"), pos, match, (), reasons)


def finished(progress: Progress) -> None:
    """At the end of a recording, items still pending are unconfirmed."""
    for r in progress.records:
        r.state = "UNCONFIRMED" if r.state == "PENDING" else r.state


def prepared(utterances: DataFrame, items: DataFrame, matcher: Matcher) -> DataFrame:
    """One row per utterance with the matches of all its ticket's items, in order of position.

    utterances: ticket_id, idx, role, text, heard (normalised); items: ticket_id, seq, pos, norm.
    Tickets without utterances keep a row with a null idx; those are many small groups, none of which grows with the data.
    """
    pairs = candidates(utterances, items)
    scored = scored_pairs(pairs, matcher)
    conflict = F.transform(F.filter("match.outcomes", lambda o: o["outcome"] == "CONFLICT"), lambda o: F.concat(o["name"], F.lit(": 票面「"), o["value"], F.lit("」但复述为「"), o["heard"], F.lit("」")))
    slots = F.transform("match.outcomes", lambda o: F.struct(o["name"].alias("name"), o["value"].alias("expected"), o["outcome"].alias("outcome"), F.round(o["score"], 4).alias("score"), o["required"].alias("required"), o["heard"].alias("conflicting_value")))
    one = F.struct("pos", F.col("match.score").alias("score"), F.col("match.verdict").alias("verdict"), F.col("match.reasons").alias("reasons"), conflict.alias("conflicts"), F.col("match.sentence_similarity").alias("sentence_similarity"), slots.alias("slots"))
    matches = scored.groupBy("ticket_id", "idx").agg(F.array_sort(F.collect_list(one)).alias("matches"))
    said = utterances.join(matches, ["ticket_id", "idx"], "left")
    tickets = items.groupBy("ticket_id").agg(F.array_sort(F.collect_list(F.struct("pos", "seq"))).alias("items"))
    return tickets.join(said, "ticket_id", "left").select("ticket_id", "items", "idx", "role", "text", "heard", "matches")


def looked_up(matches, heard: str | None) -> Callable[[int], dict | None]:
    found = {m["pos"]: m for m in (matches if matches is not None else [])}

    def match_of(pos: int) -> dict | None:
        m = found.get(pos)
        if m is None:
            return None
        more = m if isinstance(m, Mapping) else m.asDict()
        slots = more.get("slots")
        slots = [{k: s[k] for k in SLOT_FIELDS} for s in ([] if slots is None else slots)]
        return {"score": float(m["score"]), "verdict": m["verdict"], "reasons": list(m["reasons"]), "conflicts": list(m["conflicts"]), "heard": heard, "sentence_similarity": more.get("sentence_similarity"), "slots": slots}

    return match_of


def started(items) -> Progress:
    return Progress([Record(int(i["seq"])) for i in sorted(items, key=lambda i: i["pos"])])


def taken(progress: Progress, ticket: str, idx, role: str | None, text: str | None, heard: str | None, matches, settings: Settings) -> list[dict]:
    """The event of one utterance; none for an idx that is missing or not above the last one seen."""
    if idx is None or idx <= progress.last_idx:
        return []
    progress.last_idx = int(idx)
    e = step(progress, text or "", role or "UNKNOWN", looked_up(matches, heard), settings)
    return [{"ticket_id": ticket, "idx": int(idx), **e, "pointer": progress.pointer}]


def folded(rows: pd.DataFrame, settings: Settings, progress: Progress | None = None) -> tuple[Progress, list[dict]]:
    """Rows of one ticket in order of idx."""
    progress, events = progress or started(rows["items"].iloc[0]), []
    rows = rows.dropna(subset=["idx"]).sort_values("idx", kind="stable")
    for row in zip(*(rows[c].tolist() for c in ("ticket_id", "idx", "role", "text", "heard", "matches"))):
        events += taken(progress, *row, settings)
    return progress, events


def frame(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")], dtype=object)


def in_order(rows: DataFrame, schema: str, settings: Settings, each: Callable[[list[dict]], list[dict]], last: Callable[[str, Progress], list[dict]]) -> DataFrame:
    """The fold over all tickets: each ticket's rows stream through one task in order of idx, so no ticket is held whole.

    each turns the events of an utterance into rows, last a ticket's final progress.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ticket, progress = None, None
        for batch in batches:
            out: list[dict] = []
            names, items = batch.column(0).to_pylist(), batch.column(1)
            for i, row in enumerate(zip(names, *(batch.column(c).to_pylist() for c in range(2, 7)))):
                if progress is None or row[0] != ticket:
                    out += last(ticket, progress) if progress else []
                    ticket, progress = row[0], started(items[i].as_py())
                out += each(taken(progress, *row, settings))
            yield pa.RecordBatch.from_pylist(out, kind)
        if progress:
            yield pa.RecordBatch.from_pylist(last(ticket, progress), kind)

    ordered = rows.select("ticket_id", "items", "idx", "role", "text", "heard", "matches").repartition("ticket_id").sortWithinPartitions("ticket_id", "idx")
    return ordered.mapInArrow(run, schema)


def aligned(rows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The events of each ticket. rows: as prepared() gives them."""
    return in_order(rows, EVENTS, settings or Settings(), lambda events: events, lambda ticket, progress: [])


def final(ticket: str, progress: Progress) -> list[dict]:
    finished(progress)
    return [{"ticket_id": ticket, "pos": i, **asdict(r)} for i, r in enumerate(progress.records)]


def item_states(rows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The final state of each item of each ticket."""
    return in_order(rows, STATES, settings or Settings(), lambda events: [], final)


def events_and_states(rows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Both in one pass: each row has either an `event` or a `state`."""
    schema = f"event struct<{EVENTS}>, state struct<{STATES}>"
    return in_order(rows, schema, settings or Settings(), lambda events: [{"event": e, "state": None} for e in events], lambda ticket, progress: [{"event": None, "state": s} for s in final(ticket, progress)])


def state_counts(states: DataFrame) -> DataFrame:
    """How many items of a ticket are in each state that occurs."""
    return states.groupBy("ticket_id", "state").agg(F.count(F.lit(1)).alias("n"))


def report(states: DataFrame, events: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per ticket: total_items, state_counts (in the order in which states first occur), items and alerts, in order.

    texts: the tickets' items (ticket_id, pos, raw), for the items' `text`; null without it.
    """
    if texts is None:
        states = states.withColumn("text", F.lit(None).cast("string"))
    else:
        states = states.join(texts.select("ticket_id", "pos", F.col("raw").alias("text")), ["ticket_id", "pos"], "left")
    items = states.groupBy("ticket_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.array_sort(F.collect_list(F.struct("pos", "seq", "text", "state", "called", "attempts", F.round("score", 4).alias("score"), "heard", "reasons", "conflicts"))).alias("items"),
    )
    counted = states.groupBy("ticket_id", "state").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("first", "state", "n"))), lambda x: F.struct(x["state"], x["n"]))
    counts = counted.groupBy("ticket_id").agg(F.map_from_entries(entries).alias("state_counts"))
    alerts = events.filter("is_alert").groupBy("ticket_id").agg(F.array_sort(F.collect_list(F.struct("idx", "kind", "seq", "message", "heard"))).alias("alerts"))
    return items.join(counts, "ticket_id").join(alerts, "ticket_id", "left").withColumn("alerts", F.coalesce("alerts", F.array()))


def described(events: DataFrame) -> DataFrame:
    """Events with a line for people."""
    head = F.concat(F.lit("["), F.col("kind"), F.lit("]"), F.when(F.col("seq").isNotNull(), F.concat(F.lit(" #"), F.col("seq").cast("string"))).otherwise(""))
    return events.withColumn("line", F.concat_ws(" ", head, "message"))
