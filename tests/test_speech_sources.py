import json
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyvox import settings
from tallyvox.operators import evaluation, lexicon, speech
from tallyvox.sources import audio, reports, tickets
from tallyvox.streaming import speech as S


def test_bands_and_prior_against_a_fold(spark):
    draw = random.Random(6)
    data = [(r, i, draw.choice([0.0, 0.5, 0.8, 1.0, 1.2, 1.5, 2.5, 0.3])) for r in range(6) for i in range(30)] + [(9, 0, 0.0)]
    df = spark.createDataFrame(data, "recording int, idx int, rms double")
    got = {(x.recording, x.idx): x for x in speech.temporal_prior(speech.role_bands(df)).collect()}
    for r in {d[0] for d in data}:
        own = [d[2] for d in data if d[0] == r]
        voiced = [x for x in own if x > 0]
        middle, before = (float(np.median(voiced)) if voiced else 0.0), "UNKNOWN"
        for i, x in enumerate(own):
            ratio = x / middle if middle else 0.0
            role = "UNKNOWN" if not middle or 1 / 1.6 < ratio < 1.6 else "OPERATOR" if ratio >= 1.6 else "CALLER"
            source = "energy"
            if role == "UNKNOWN" and before != "UNKNOWN":
                role = "OPERATOR" if ratio > 1 else "CALLER"
                source = "energy-lean" if role == before else "prior"
            before = role
            assert (got[r, i].role, got[r, i].source, got[r, i].ratio) == (role, source, pytest.approx(ratio))


def test_rolling_roles_equal_the_stream(spark):
    draw, recent, last, want = random.Random(7), [], None, []
    data = [(1, i, draw.choice([0.0, 0.4, 0.9, 1.0, 1.1, 3.0])) for i in range(300)]
    for _, _, x in data:
        want.append(S.observed(x, recent, last, 1.6))
        last = want[-1][0]
    got = speech.rolling_roles(spark.createDataFrame(data, "recording int, idx int, rms double")).orderBy("idx").collect()
    for r, (role, confidence, ratio, source) in zip(got, want, strict=True):
        assert (r.role, r.source) == (role, source) and r.ratio == pytest.approx(ratio) and r.confidence == pytest.approx(confidence)


def islands(voiced, n, gap):
    out, start, silent = [], None, 0
    for f in range(n):
        if f in voiced:
            start, silent = (f if start is None else start), 0
        elif start is not None:
            silent += 1
            if silent >= gap:
                out.append((start, f - silent + 1))
                start, silent = None, 0
    return out + ([(start, n)] if start is not None else [])


def test_voice_segments_against_a_loop(spark):
    draw = random.Random(8)
    data, want = [], []
    for r in range(20):
        energy = [draw.choice([0.0, 0.0, 1.0]) for _ in range(80)]
        data += [(r, f, e) for f, e in enumerate(energy)]
        least = max(float(np.median(energy)) * 0.35, 1e-4)
        spans = [(a * 30, b * 30) for a, b in islands({f for f, e in enumerate(energy) if e > least}, 80, 4) if (b - a) * 30 >= 300]
        want += [(r, *s) for s in spans or [(0, 2400)]]
    got = speech.voice_segments(spark.createDataFrame(data, "recording int, frame int, energy double"), silence_frames=4).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_marks_are_paired(spark, tmp_path):
    marks = [(1, 0, 100, -1), (1, 1, -1, 900), (1, 2, -1, 950), (1, 3, 1000, 1100), (1, 4, 2000, 2500), (2, 0, 0, -1)]
    df = spark.createDataFrame(marks, "recording string, idx int, start_ms bigint, end_ms bigint")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = S.segments_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    s.writeStream.format("memory").queryName("marks").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("marks").collect())) == [("1", 100, 900), ("1", 2000, 2500)]
    e = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate([1, 1, 1, 5, 0])], "recording string, idx bigint, rms double")
    e.coalesce(1).write.parquet(f"{tmp_path}/e")
    S.roles_stream(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")).writeStream.format("memory").queryName("roles").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert [r.role for r in spark.table("roles").orderBy("idx").collect()] == ["UNKNOWN", "UNKNOWN", "UNKNOWN", "OPERATOR", "CALLER"]


def test_streams_of_marks_and_energies_carry_state_and_count_what_they_drop(spark, tmp_path):
    draw = random.Random(4)
    energies = [(r, i, draw.choice([0.0, 1.0, 2.0, 9.0])) for r in "ab" for i in range(300)]
    want = []
    for r in "ab":
        recent, last = [], None
        for _, i, x in (e for e in energies if e[0] == r):
            last, *more = S.observed(x, recent, last, 1.6)
            want.append((r, i, x, last, *more, None))
    parts = [energies[:150] + energies[300:420], energies[100:300] + energies[420:] + energies[310:320]]  # 50 of a and 10 of b come twice
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "recording string, idx bigint, rms double").selectExpr("*", "timestamp_seconds(idx + 1) AS at", "1 AS clock")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e").withWatermark("at", "1 day")
        q = S.roles_stream(stream, idle_ms=10_000_000, clock="at", counted=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert q.awaitTermination(100)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    counts = [("a", *[None] * 6, 50), ("b", *[None] * 6, 10)]
    assert got == sorted(want + counts, key=str)
    marks = [(1, 0, 100, -1), (1, 1, -1, 900), (1, 1, -1, 950), (2, 5, 0, 400)]
    df = spark.createDataFrame(marks, "recording string, idx int, start_ms bigint, end_ms bigint")
    df.coalesce(1).write.parquet(f"{tmp_path}/m")
    q = S.segments_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/m"), counted=True).writeStream.format("memory").queryName("counted").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    assert sorted(map(tuple, spark.table("counted").collect()), key=str) == [("1", 100, 900, None), ("1", None, None, 1), ("2", 0, 400, None)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_most_apart_against_the_full_matrix(spread):
    draw = np.random.default_rng(3)
    for n, block in ((2, 3), (40, 7), (300, 32), (300, 1000)):
        centres = draw.normal(size=(3, 8))
        unit = speech.directions(centres[draw.integers(0, 3, n)] + spread * draw.normal(size=(n, 8)))
        i, j = speech.most_apart(unit, block)
        near = unit @ unit.T
        assert i < j and near[i, j] == pytest.approx(near.min(), abs=1e-12)
    ties = speech.directions(np.array([[1.0, 0], [0, 1], [1, 0], [0, 1]]))
    assert speech.most_apart(ties, 2) == (0, 1) and speech.most_apart(np.ones((3, 2)) / 2**0.5) is None and speech.most_apart(np.zeros((2, 2))) == (0, 1)


def test_two_means_against_a_plain_loop():
    draw = np.random.default_rng(5)
    for n in (4, 9, 60):
        vectors = draw.normal(size=(n, 5))
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        sims = [(float(unit[i] @ unit[j]), i, j) for i in range(n) for j in range(i + 1, n)]
        _, i, j = min(sims)
        a, b, labels = unit[i], unit[j], [0] * n
        for _ in range(20):
            new = [int(u @ b > u @ a) for u in unit]
            if new == labels:
                break
            labels = new
            sides = [[u for u, k in zip(unit, labels) if k == side] for side in (0, 1)]
            a, b = ((sum(own) / np.linalg.norm(sum(own))) if own else old for own, old in zip(sides, (a, b)))
        assert speech.two_means(vectors).tolist() == labels


def test_two_means_and_refinement(spark):
    near = np.array([[1.0, 0.1], [0.1, 1.0], [1.0, 0.0], [0.0, 1.0]])
    labels = speech.two_means(near)
    assert labels[0] == labels[2] != labels[1] == labels[3] and speech.two_means(near[:1]) is None
    rows = [("r", i, e, "UNKNOWN", 0.3, "energy", v) for i, (e, v) in enumerate(zip([3.0, 1.0, 3.0, 1.0], near.tolist()))]
    df = spark.createDataFrame(rows, "recording string, idx int, rms double, role string, confidence double, source string, voice array<double>")
    assert [r.role for r in speech.refined_by_voice(df).orderBy("idx").collect()] == ["OPERATOR", "CALLER"] * 2
    assert {r.role for r in speech.refined_by_voice(df.filter("idx < 3")).collect()} == {"UNKNOWN"}


def test_spans_and_status(spark):
    df = spark.createDataFrame([("a", [-50, 400], 1000), ("b", [10], 1000), ("c", [900, 5000], 1000), ("d", [0, 990], 1000)], "recording string, span array<int>, length_ms int")
    spans = speech.clamped(df)
    assert {(r.recording, r.start_ms, r.end_ms) for r in spans.collect()} == {("a", 0, 400), ("d", 0, 990)}
    lengths = df.select("recording", "length_ms")
    whole = speech.whole_if_none(spans.select("recording", "start_ms", "end_ms"), lengths)
    assert whole.count() == 4
    assert {r.recording: r.status for r in speech.segmenter_status(whole, lengths).collect()} == {"a": "split", "b": "whole", "c": "whole", "d": "whole"}


def test_transcriber_boundary(spark):
    class Echo:
        def load(self):
            return lambda batch: batch[["idx"]].assign(text="t", raw_text="<|t|>", infer_seconds=0.1, audio_seconds=1.0)[["text", "raw_text", "infer_seconds", "audio_seconds"]]

    got = speech.transcribed(spark.range(3).select(F.col("id").alias("idx")), Echo()).collect()
    assert [r.text for r in got] == ["t"] * 3


SHAPES = {"ticket2": {"substation": "站", "mission": "m", "id": "x", "entries": {"2": "拉开110kV桥100开关", "1": "检查"}}, "ticket10": {"1": "检查设备", "b": "合上开关"}, "ticket1": ["检查设备", "合上开关"]}


def test_ticket_shapes(spark, tmp_path):
    for name, tree in SHAPES.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(tree, ensure_ascii=False), encoding="utf-8")
    found = tickets.directory(spark, str(tmp_path))
    assert [r.ticket for r in found.orderBy("number", "ticket").collect()] == ["ticket1", "ticket2", "ticket10"]
    items = {(r.ticket, r.pos): (r.seq, r.raw) for r in tickets.items(found, "ticket").collect()}
    assert items["ticket2", 0] == (1, "检查") and items["ticket10", 1] == (2, "合上开关") and items["ticket1", 1] == (2, "合上开关")
    assert [r.raw for r in tickets.by_seq(tickets.items(found, "ticket").select("ticket", "seq", "pos", "raw", "norm"), 2).collect()].count("合上开关") == 2
    with pytest.raises(Exception, match="no ticket"):
        tickets.parsed(spark.createDataFrame([("s", "12")], "source string, text string")).collect()


def test_lexicon_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([("ticket1", "1", "检查汇控柜丹东线111-1刀闸电气位置指示确已合好"), ("ticket2", "3", "投入110kV丹东线111保护测控出口压板两只")], "ticket string, seq string, entry string")
    heads = spark.createDataFrame([("ticket1", "110kV站", "甲"), ("ticket2", "110kV站", "乙")], "ticket string, substation string, mission string")
    lex = lexicon.grouped(lexicon.all_terms(heads, entries))
    found = {(r.category, r.term): (r["count"], r.sources) for r in lex.collect()}
    assert found["substations", "110kV站"] == (2, ["ticket1", "ticket2"]) and lexicon.station(lex).first().station == "110kV站"
    assert found["devices", "丹东线111-1刀闸"] == (1, ["ticket1#1"]) and found["device_codes", "111-1"][0] == 1 and found["voltage_levels", "110kV"] == (1, ["ticket2#3"])
    assert any(c == "protection_plates" for c, _ in found)
    terms = [r.term for r in lexicon.asset_terms(lex).collect()]
    assert terms == sorted(terms, key=lambda t: (-len(t), t)) and "111-1" in terms
    tree = reports.lexicon_tree(lex, "110kV站", "s", 2, 2, lexicon.CATEGORIES)
    reports.write_lexicon(tree, terms, f"{tmp_path}/l.yaml", f"{tmp_path}/a.txt")
    assert {r.term for r in tickets.read_assets(spark, f"{tmp_path}/a.txt").collect()} and tickets.read_assets(spark, f"{tmp_path}/none.txt").count() == 0


def test_audio(spark, tmp_path):
    for name, rate, channels in (("clip3.wav", 8000, 2), ("_full.wav", 16000, 1)):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setparams((channels, 2, rate, 0, "NONE", ""))
            w.writeframes(b"".join(struct.pack("<h", 16384) * channels for _ in range(rate)))
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    (tmp_path / "x.txt").write_text("x")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in audio.decoded(files.filter("path like '%.wav'")).collect()}
    assert len(got["clip3.wav"].wave) == 16000 and got["clip3.wav"].wave[5] == pytest.approx(0.5) and got["clip3.wav"].seconds == 1.0
    assert got["bad.wav"].seconds == 0.0 and got["bad.wav"].wave is None and got["bad.wav"].status != "ok"
    found = audio.clips(audio.listing(spark, str(tmp_path)), spark.createDataFrame([("_full.wav", 9)], "name string, seq int"))
    assert {r.name: r.seq for r in found.collect()} == {"clip3.wav": 3, "_full.wav": 9, "bad.wav": None}
    assert audio.recordings(audio.listing(spark, str(tmp_path))).count() == 2
    whole, lacking = audio.pairs(spark.createDataFrame([("a", "a.json"), ("b", "b.json")], "name string, ticket_path string"), spark.createDataFrame([("a", "2.wav", 2), ("a", "1.wav", 1), ("c", "c.wav", 1)], "name string, audio_path string, rank int"))
    assert whole.first().audio_path == "1.wav" and {(r.name, r.missing) for r in lacking.collect()} == {("b", "audio"), ("c", "ticket")}


def test_reference_of_clips(spark):
    clips, items = spark.createDataFrame([("a", 1), ("b", 9), ("c", None)], "name string, seq int"), spark.createDataFrame([(1, "检查")], "seq int, raw string")
    assert {r.name: r.reference for r in evaluation.with_reference(clips, items).collect()} == {"a": "检查", "b": None, "c": None}


def test_evaluation_and_reports(spark, tmp_path):
    clips = spark.createDataFrame([("x", "拉开桥100", "拉开桥200", 2.0, 0.5, True), ("x", None, "y", 0.0, 0.0, None)], "label string, reference string, hypothesis string, audio_seconds double, infer_seconds double, aligned boolean")
    s = evaluation.summary(evaluation.evaluated(clips)).first()
    assert (s.clips, s.rtf, s.align_accuracy) == (2, 0.25, 1.0) and s.mean_cer_norm == pytest.approx(1 / 6, abs=1e-4)
    (tmp_path / "r.json").write_text(json.dumps({"ticket": "t", "total_items": 3, "state_counts": {"VERIFIED": 2}, "alerts": [{"kind": "FAILED"}]}))
    r = reports.read_reports(spark, str(tmp_path / "r.json")).first()
    assert (r.VERIFIED, r.FLAGGED, r.alerts) == (2, 0, 1)


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("aligner:\n  lookahead: 0\nverdict:\n  missing_required_action: fail\n")
    s = settings.load("c.yaml", tmp_path)
    assert s.lookahead == 0 and s.missing_fails and s.lookback == 1 and settings.dotted({"a": {"b": 1}}, "a.c", 5) == 5
    with pytest.raises(FileNotFoundError):
        settings.load("none.yaml", tmp_path)


def test_sql_functions(spark):
    from tallyvox.functions.register import register

    register(spark)
    row = spark.sql("SELECT normalize_text('幺幺零千伏') AS n, phonetic_similarity('知道', '资道') AS s, phonetic_contains('远方', '切至远方') AS c, encode_phonetic('1') AS e").first()
    assert (row.n, row.s, row.c, row.e) == ("110kv", 1.0, 1.0, ["1|yao|yi"])
    assert [r.name for r in spark.sql("SELECT * FROM extract_slots('拉开110kv桥100开关')").collect()] == ["action", "voltage", "device"]
