import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyvox.functions.phonetic import encoder_for
from tallyvox.functions.plain import normalised
from tallyvox.operators import alignment as A
from tallyvox.operators.matching import Matcher
from tallyvox.operators.slots import Extractor
from tallyvox.plans import fixtures
from tallyvox.settings import Settings
from tallyvox.streaming.alignment import END, Aligner, aligned_stream

T = fixtures.TICKET


@pytest.fixture(scope="module")
def matcher(spark):
    return Matcher(Extractor(normalised), encoder_for(spark))


def fold(matcher, said, settings=None):
    settings, progress, events = settings or Settings(), A.Progress([A.Record(i + 1) for i in range(len(T))]), []
    for text, role in said:
        heard = normalised(text)

        def match_of(pos, heard=heard):
            m = matcher.match(normalised(T[pos]), heard)
            return {**m, "heard": heard, "conflicts": [o["name"] for o in m["outcomes"] if o["outcome"] == "CONFLICT"]}

        events.append(A.step(progress, text, role, match_of, settings))
    return progress, events


def kinds(events):
    return [e["kind"] for e in events]


def test_a_caller_alone_advances(matcher):
    p, e = fold(matcher, [(T[0], "CALLER"), (T[0], "OPERATOR"), (T[1], "CALLER")])
    assert kinds(e) == ["VERIFIED", "REPEAT", "VERIFIED"] and p.pointer == 2 and p.records[0].called and p.records[0].attempts == 2


def test_repeat_upgrades_and_never_downgrades(matcher):
    p, e = fold(matcher, [("拉开桥100开关", "CALLER"), (T[2], "OPERATOR"), ("拉开桥100开关", "OPERATOR")], Settings(lookahead=2))
    assert kinds(e)[0] in ("SKIP_WARNING", "FLAGGED") and kinds(e)[1:] == ["REPEAT", "REPEAT"] and p.records[2].state == "VERIFIED"


def test_chatter_and_blank(matcher):
    p, e = fold(matcher, [("今天天气真好啊", "OPERATOR"), ("  ", "CALLER")])
    assert kinds(e) == ["CHATTER", "CHATTER"] and p.pointer == 0


def test_skipped_items_are_named(matcher):
    p, e = fold(matcher, [(T[2], "OPERATOR")])
    assert e[0]["kind"] == "SKIP_WARNING" and e[0]["skipped"] == [1, 2] and [r.state for r in p.records[:3]] == ["UNCONFIRMED", "UNCONFIRMED", "VERIFIED"]


@pytest.mark.parametrize("role", ["CALLER", "OPERATOR", "UNKNOWN"])
def test_wrong_direction_fails(matcher, role):
    p, e = fold(matcher, [(T[0], "CALLER"), (T[4], role)], Settings(lookahead=0))
    assert e[1]["kind"] == "FAILED" and p.pointer == 2 and e[1]["is_alert"]


def test_contradiction_after_pass_and_recovery(matcher):
    s = Settings(lookahead=0)
    p, e = fold(matcher, [(T[0], "CALLER"), (T[1], "CALLER"), (T[4], "OPERATOR"), (T[4], "OPERATOR"), (T[1], "OPERATOR")], s)
    assert kinds(e) == ["VERIFIED", "VERIFIED", "FAILED", "FAILED", "REPEAT"] and p.records[1].state == "VERIFIED" and p.pointer == 2


def test_finish(matcher):
    p, _ = fold(matcher, [(T[0], "CALLER")])
    A.finished(p)
    assert [r.state for r in p.records] == ["VERIFIED"] + ["UNCONFIRMED"] * 8


def test_role_aware(matcher):
    s = Settings(role_aware=True)
    p, e = fold(matcher, [(T[0], "CALLER"), (T[0], "UNKNOWN")], s)
    assert kinds(e) == ["CALL", "VERIFIED"] and p.pointer == 1
    p, e = fold(matcher, [(T[2], "CALLER"), ("拉开桥100开关", "OPERATOR")], s)
    assert e[1]["kind"] == "SKIP_WARNING" and p.records[2].state == "VERIFIED"  # the call makes up for what was left out
    p, e = fold(matcher, [(T[2], "CALLER"), ("拉开桥100开关", "OPERATOR")], Settings(role_aware=True, corroborate=False))
    assert p.records[2].state == "FLAGGED"


def rows(spark, matcher, said):
    return A.prepared(fixtures.utterances(spark, said), fixtures.ticket_items(spark), matcher)


def test_full_pass_in_batch_and_stream(spark, matcher, tmp_path):
    said = [(t, r) for t in T for r in ("CALLER", "OPERATOR")]
    table = rows(spark, matcher, said)
    table.write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    events = A.aligned(table).orderBy("idx").collect()
    assert [e.kind for e in events] == ["VERIFIED", "REPEAT"] * 9
    states = A.item_states(table)
    assert {r.state for r in states.collect()} == {"VERIFIED"}
    report = A.report(states, A.aligned(table)).first()
    assert report.state_counts == {"VERIFIED": 9} and report.alerts == [] and report.total_items == 9

    end = table.limit(1).selectExpr("ticket_id", "items", "99L AS idx", f"'{END}' AS role", "'' AS text", "'' AS heard", "matches")
    end.coalesce(1).write.parquet(f"{tmp_path}/end")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1)
    for k, source in enumerate(("in", "end")):
        q = aligned_stream(stream.parquet(f"{tmp_path}/{source}")).writeStream.format("memory").queryName(f"events{k}").option("checkpointLocation", f"{tmp_path}/c{k}").trigger(availableNow=True).start()
        q.awaitTermination()
    key = lambda r: (r.idx, r.kind, r.seq, r.pointer)
    assert sorted(map(key, spark.table("events0").collect())) == sorted(map(key, events))
    assert [r.kind for r in spark.table("events1").collect()] == ["UNCONFIRMED"] * 9


def timed(table, tmp_path, name, files):
    """The rows of a table by idx, so many of them in each of several files, with an event time of a second an idx; read as a stream, a file a trigger."""
    rows = table.withColumn("at", F.timestamp_seconds(F.col("idx") + 1))
    for i, low, high in files:
        rows.filter(F.col("idx").between(low, high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}").withWatermark("at", "0 seconds")


def run(events, tmp_path, name):
    q = events.writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start()
    if not q.awaitTermination(100):
        q.stop()
        raise AssertionError("the stream doesn't end")
    return events.sparkSession.read.schema(A.EVENTS).parquet(f"{tmp_path}/{name}-out").collect()


def test_ticket_without_utterances(spark, matcher):
    table = rows(spark, matcher, [])
    assert A.aligned(table).count() == 0 and {r.state for r in A.item_states(table).collect()} == {"UNCONFIRMED"}


def generated(spark, tmp_path, tickets=12, said=15, seed=6):
    """Tickets of made-up items and matches, with all verdicts and roles, as prepared() gives them."""
    draw, data = random.Random(seed), []
    for t in range(tickets):
        n = draw.randint(0, 7)
        items = [(p, p + 1) for p in range(n)]
        for idx in range(draw.randint(0, said)):
            matches = []
            for p in range(n):
                verdict = draw.choice(["PASS", "REVIEW", "FAIL"])
                matches.append((p, round(draw.random(), 3), verdict, ["why"] if verdict == "FAIL" else [], ["x"] if verdict == "FAIL" else [], 0.5, []))
            data.append((f"t{t}", items, idx, draw.choice(["CALLER", "OPERATOR", None]), draw.choice(["said", " "]), "heard", matches))
    schema = "ticket_id string, items array<struct<pos:int,seq:int>>, idx bigint, role string, text string, heard string, matches array<struct<pos:int,score:double,verdict:string,reasons:array<string>,conflicts:array<string>,sentence_similarity:double,slots:array<struct<name:string,expected:string,outcome:string,score:double,required:boolean,conflicting_value:string>>>>"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/generated")
    return spark.read.parquet(f"{tmp_path}/generated"), schema


def by_row(events):
    return sorted(map(str, events))


@pytest.mark.parametrize("aware", [False, True])
def test_stream_gives_the_events_of_the_batch(spark, tmp_path, aware):
    table, _ = generated(spark, tmp_path)
    s = Settings(role_aware=aware, chatter=0.2)
    stream = timed(table, tmp_path, "s", [(0, 0, 4), (1, 5, 9), (2, 10, 99)])
    got = run(aligned_stream(stream, s, idle_ms=10_000_000, clock="at"), tmp_path, "s")
    assert by_row(got) == by_row(A.aligned(table, s).collect())


def test_idle_tickets_are_finished_by_a_timer_and_late_rows_counted(spark, tmp_path):
    table, schema = generated(spark, tmp_path)
    s = Settings(chatter=0.2)
    first = [r for r in table.collect() if r.idx < 5]
    again = [r for r in first if r.ticket_id in ("t1", "t2") and r.idx < 2]
    clock = ("clock", [], 10_000, "UNKNOWN", " ", "", [])
    ended = [("t3", [], 50, END, "", "", []), ("t3", [], 51, "OPERATOR", "said", "", [])]
    after = [("t4", [], 20_000, "OPERATOR", "said", "", [])]
    path, kept = f"{tmp_path}/r", []
    for rows in (first, again + ended, [clock], after):
        spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.col("idx") + 1)).coalesce(1).write.mode("append").parquet(path)
        # each run is a restart from the checkpoint
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).withWatermark("at", "100 seconds")
        kept.append(run(aligned_stream(stream, s, idle_ms=600_000, clock="at"), tmp_path, "r"))
    events = [e for e in kept[-1] if e.ticket_id != "clock"]
    held = spark.createDataFrame(first, schema)
    told = [e for e in events if e.kind not in ("DROPPED", "UNCONFIRMED")]
    assert by_row(told) == by_row(A.aligned(held, s).collect())
    late = sorted((e.ticket_id, e.idx, e.message) for e in events if e.kind == "DROPPED")
    want = [("t3", 51, 1)] + [(t, i, i + 1) for t in ("t1", "t2") for i in range(2) if any(r.ticket_id == t and r.idx == i for r in again)]
    want += [("t4", 20_000, 1)] if any(r.ticket_id == "t4" for r in first) else []
    assert late == sorted((t, i, f"乱序或迟到，未计入（累计 {n} 条）") for t, i, n in want)
    # a timer or END turns what is pending into unconfirmed items: the states of the batch say the same
    given = {(e.ticket_id, e.seq) for e in events if e.kind == "UNCONFIRMED"} | {(e.ticket_id, q) for e in told for q in e.skipped}
    assert {(r.ticket_id, r.seq) for r in A.item_states(held, s).filter("state = 'UNCONFIRMED'").collect()} <= given
    assert not [e for e in kept[1] if e.kind == "UNCONFIRMED" and e.ticket_id != "t3"]  # not idle for long enough yet


def test_idle_by_processing_time(spark, tmp_path):
    table, schema = generated(spark, tmp_path, tickets=3)
    path = f"{tmp_path}/p"
    table.filter("idx = 0").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    q = aligned_stream(stream, Settings(chatter=0.2), idle_ms=1000).writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/pc").trigger(processingTime="500 milliseconds").start()
    try:
        want = A.item_states(table.filter("idx = 0"), Settings(chatter=0.2)).filter("state = 'UNCONFIRMED'").count()
        for _ in range(60):
            got = spark.table("idle").selectExpr("sum(if(kind = 'UNCONFIRMED', 1, size(skipped)))").first()[0]
            if got == want:
                break
            time.sleep(1)
        assert got == want and want > 0
    finally:
        q.stop()


class Held:
    """One key's value or list in memory; counts how often it is asked."""

    def __init__(self):
        self.value, self.asked = None, 0

    def exists(self):
        self.asked += 1
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


def test_stream_takes_and_gives_single_rows():
    head, records, timers = Held(), Held(), []
    handle = SimpleNamespace(getValueState=lambda *a: head, getListState=lambda *a: records, listTimers=lambda: timers, deleteTimer=timers.remove, registerTimer=timers.append)
    aligner = Aligner(Settings(chatter=0.2), 1_000, True, None)
    aligner.init(handle)
    items = [{"pos": p, "seq": p + 1} for p in range(2)]
    matches = lambda p: [{"pos": p, "score": 0.9, "verdict": "PASS", "reasons": [], "conflicts": []}]
    row = lambda idx, p: Row(ticket_id="a", items=items, idx=idx, role="OPERATOR", text="x", heard="x", matches=matches(p), clock=idx * 10)
    events = list(aligner.handleInputRows(("a",), iter([row(1, 0), Row(**row(0, 0).asDict() | {"idx": None})]), None))
    assert all(isinstance(e, Row) for e in events) and [(e.idx, e.kind, e.seq) for e in events] == [(1, "VERIFIED", 1)] and timers == [1_010]
    assert head.asked == 1  # the state is read at one go
    events = list(aligner.handleInputRows(("a",), iter([row(1, 1)]), None)) + list(aligner.handleExpiredTimer(("a",), None, None))
    assert [(e.idx, e.kind, e.seq) for e in events] == [(1, "DROPPED", None), (2, "UNCONFIRMED", 2)] and records.value is None
